"""The graph of users and items as mapped files: neighbours, samples, walks and propagation without a join.

Nodes are inner ids; the id behind the last one (``n_users``, ``n_items``) is
that of unknown values and a node like any other. Tasks run over ranges of ids
and look neighbours up, so no edge is shuffled after the files are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rillstone.operators import mapped
from rillstone.operators.sampling import _drawn, _mix_numbers
from rillstone.session import parallelism


@dataclass(frozen=True)
class Bipartite:
    """Distinct (user, item), sorted by either side."""

    by_user: mapped.Flat
    by_item: mapped.Flat
    n_users: int
    n_items: int

    @classmethod
    def write(cls, pairs: DataFrame, n_users: int, n_items: int) -> Bipartite:
        """Files of distinct ``pairs`` with integers from 0 to n_users and n_items; further columns, integers, stand beside them by user."""
        kinds = {c: ("int32", 0) for c in pairs.columns}
        by_item = mapped.write_flat(pairs.select("user", "item"), ["item", "user"], {c: kinds[c] for c in ("user", "item")}, "by-item")
        return cls(mapped.write_flat(pairs, ["user", "item"], kinds, "by-user"), by_item, n_users, n_items)

    def rows(self, spark: SparkSession, tasks: int) -> DataFrame:
        """The pairs by user with their further columns, in ``tasks`` parts of equal length."""
        flat, size = self.by_user, 10_000

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    held = flat.open()
                    cuts = [flat.rows * x // tasks for x in (k, k + 1)]
                    for at in range(cuts[0], cuts[1], size):
                        yield pa.RecordBatch.from_arrays([pa.array(held[c][at : min(at + size, cuts[1])]) for c in flat.kinds], names=[*flat.kinds])

        return spark.range(0, tasks, 1, tasks).mapInArrow(run, ", ".join(f"{c} int" for c in flat.kinds))

    def size(self, side: str) -> int:
        """Nodes of a side, with the one of unknown values."""
        return (self.n_users if side == "user" else self.n_items) + 1

    def open(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the neighbours of each node of a side begin (and, one more, end), and all their neighbours."""
        held = (self.by_user if side == "user" else self.by_item).open()
        start = np.searchsorted(held[side], np.arange(self.size(side) + 1, dtype=np.int32))
        return start, held["item" if side == "user" else "user"]

    def _over(self, spark: SparkSession, side: str, of: Callable, kinds: dict[str, tuple[str, int]], name: str) -> mapped.Flat:
        """Columns of all nodes of a side by id; ``of()`` makes in a task what gives those of consecutive ids."""
        types = {c: pa.from_numpy_dtype(np.dtype(k)) for c, (k, _) in kinds.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = None
            for b in batches:
                f = f or of()
                got = f(b.column(0).to_numpy())
                cols = [pa.array(got[c].reshape(-1), types[c]) for c in kinds]
                cols = [pa.FixedSizeListArray.from_arrays(x, w).cast(pa.list_(types[c])) if w else x for x, (c, (_, w)) in zip(cols, kinds.items(), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kinds])

        sql = {"int32": "int", "float64": "double"}
        fields = ", ".join(f"{c} array<{sql[k]}>" if w else f"{c} {sql[k]}" for c, (k, w) in kinds.items())
        ids = spark.range(0, self.size(side), 1, parallelism(spark))
        return mapped.write_flat(ids.mapInArrow(run, fields), None, kinds, name)

    def sampled(self, spark: SparkSession, side: str, num: int, seed: int = 42) -> mapped.Flat:
        """The sample of ``graph.sampled_sums``: at most ``num`` neighbours of each node (``near``, padded by the other side's size), by id."""
        own, pad = (0, self.n_items) if side == "user" else (1, self.n_users)

        def of():
            start, other = self.open(side)

            def f(ids):
                deg = start[ids + 1] - start[ids]
                near, at = np.asarray(other[start[ids[0]] : start[ids[-1] + 1]]), np.repeat(np.arange(len(ids)), deg)
                first = start[ids] - start[ids[0]]
                order = np.lexsort((near, _mix_numbers(2 * ids[at] + own, 2 * near.astype(np.int64) + 1 - own, seed), at))
                order = np.sort(order[np.arange(len(at)) - first[at] < num])  # neighbours of a node ascend
                kept = np.minimum(deg, num)
                out = np.full((len(ids), num), pad, np.int32)
                out[at[order], np.arange(len(order)) - (np.cumsum(kept) - kept)[at[order]]] = near[order]
                return {"near": out}

            return f

        return self._over(spark, side, of, {"near": ("int32", num)}, f"near-{side}")

    def visited(self, spark: SparkSession, num: int, n_walks: int, length: int, seed: int = 42) -> mapped.Flat:
        """The most visited items of each item's walks, as ``graph.weighted_neighbors`` of ``graph.bipartite_walk_pairs`` from the start: ``seq, seq_len, dense`` by id."""

        def of():
            (i_start, users), (u_start, items) = self.open("item"), self.open("user")

            def pick(start, other, node, draw):
                return other[start[node] + draw % (start[node + 1] - start[node])]

            def f(ids):
                walk, now = (ids[:, None] * n_walks + np.arange(n_walks)).ravel(), np.repeat(ids, n_walks)
                goes, to = i_start[now + 1] > i_start[now], []
                walk, home, now = walk[goes], np.repeat(np.arange(len(ids)), n_walks)[goes], now[goes]  # a node without users visits none
                for step in range(length):
                    user = pick(i_start, users, now, _mix_numbers(walk, step * 2, seed))
                    now = pick(u_start, items, user, _mix_numbers(walk, step * 2 + 1, seed)).astype(np.int64)
                    to.append(now)
                home, now = np.tile(home, length), np.concatenate(to)
                other = now != ids[home]
                codes, visits = np.unique(home[other] * (self.n_items + 1) + now[other], return_counts=True)
                home, now = codes // (self.n_items + 1), codes % (self.n_items + 1)
                order = np.lexsort((now, -visits, home))
                first = np.searchsorted(home, np.arange(len(ids)))
                order = np.sort(order[np.arange(len(home)) - first[home] < num])
                home, now, visits = home[order], now[order], visits[order]
                place = np.arange(len(home)) - np.searchsorted(home, np.arange(len(ids)))[home]
                seq, dense = np.full((len(ids), num), self.n_items, np.int32), np.zeros((len(ids), num))
                seq[home, place] = now
                dense[home, place] = visits / np.bincount(home, visits, len(ids))[home]
                return {"seq": seq, "seq_len": np.maximum(np.bincount(home, minlength=len(ids)), 1).astype(np.int32), "dense": dense}

            return f

        return self._over(spark, "item", of, {"seq": ("int32", num), "seq_len": ("int32", 0), "dense": ("float64", num)}, "visited")

    def negatives(self, liked: DataFrame, num: int, seed: int = 42, tries: int = 10) -> DataFrame:
        """``user, item, label`` 1 and ``negative`` of distinct liked (user, item): as ``sampling.unconsumed_negatives`` by rows user x n_items + item."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                held = held or self.open("user")
                start, other = held
                user, item = (b.column(k).to_numpy().astype(np.int64) for k in (0, 1))
                users = np.unique(user)
                at = np.repeat(np.arange(len(users)), start[users + 1] - start[users])
                near = other[np.arange(len(at)) - np.searchsorted(at, np.arange(len(users)))[at] + start[users][at]].astype(np.int64)
                codes = (at * self.n_items + near)[near < self.n_items]
                ask = pa.RecordBatch.from_arrays([pa.array(x) for x in (user, item, np.ones(len(user), np.int32), user * self.n_items + item, user, item, np.ones(len(user)))], names=["u", "i", "side", "at", "user", "item", "label"])
                yield from _drawn(ask, users, codes, self.n_items, num, num * tries, seed)

        return liked.select("user", "item").mapInArrow(run, "user long, item long, label double, negative long")

    def propagated(self, spark: SparkSession, side: str, own: Callable, other: Callable, kind: str, after: Callable, width: int) -> mapped.Flat:
        """``v`` of each node of a side by id: ``after(ego, sum)`` of its vector and the weighted sum of its neighbours', weights of ``graph.normalized_edges`` (row: with the node itself).

        ``own()`` and ``other()`` make in a task what gives the vectors of ids.
        """
        back = "item" if side == "user" else "user"

        def of():
            start, near = self.open(side)
            far = np.diff(self.open(back)[0]) if kind == "symmetric" else None
            mine, theirs = own(), other()

            def f(ids):
                deg = start[ids + 1] - start[ids]
                nb = np.asarray(near[start[ids[0]] : start[ids[-1] + 1]])
                x, ego = theirs(nb), mine(ids)
                if far is not None:
                    x = x / np.sqrt(np.repeat(deg, deg) * far[nb])[:, None]
                total, some = np.zeros_like(ego), deg > 0
                if len(nb):
                    total[some] = np.add.reduceat(x, (start[ids] - start[ids[0]])[some], axis=0)
                return {"v": after(ego, total if far is not None else (total + ego) / (deg + 1)[:, None])}

            return f

        return self._over(spark, side, of, {"v": ("float64", width)}, f"propagated-{side}")


def by_key(key: str, flat: mapped.Flat) -> Callable:
    """To fill batches of a model in a task: the columns of ``flat`` at the ids in ``key``."""

    def made():
        held = flat.open()
        return lambda b: b | {c: x[b[key]] for c, x in held.items()}

    return made


def sampled_near(graph: Bipartite, near: dict[str, mapped.Flat], kind: str) -> Callable:
    """As ``neural.with_graph_samples``, looked up in a task: sampled neighbours of user, item and negative and their weights."""

    def made():
        held = {s: f.open()["near"] for s, f in near.items()}
        degrees = {s: np.diff(graph.open(s)[0]) for s in ("user", "item")}

        def fill(b):
            out = dict(b)
            for c, side, back in (("user", "user", "item"), ("item", "item", "user"), ("negative", "item", "user")):
                if c in b:
                    n = np.asarray(held[side][b[c]])
                    deg = degrees[side][b[c]][:, None]
                    kept = np.minimum(deg, n.shape[1])
                    real = np.arange(n.shape[1]) < kept
                    weight = 1 / np.sqrt(np.maximum(deg * degrees[back][n], 1)) if kind == "symmetric" else np.broadcast_to(1 / (deg + 1), n.shape)
                    out[f"{c}_near"], out[f"{c}_w"] = n.astype(np.int64), np.where(real, weight * (deg / np.maximum(kept, 1)), 0.0)
            return out

        return fill

    return made
