"""Most similar vectors by score-aware quantisation and four-bit table scans.

Vectors are dealt to the cells of a coarse quantiser and stored there as
four-bit codes of their residual. Codes are chosen for the score, not for the
distance: the part of the error along the vector, which shifts the scores of
just those queries that matter, weighs ``eta`` times as much as the part
across it. A query brings its tables (the products with all centres, as whole
numbers) to the codes of its nearest cells and adds table entries up, two codes
a byte; neither vectors of the collection nor products with them are needed.
A code keeps the parts of its error along and across its vector, which bound
the cosine from both sides; only codes that may reach the floor and the k-th
best are candidates, and only for these the exact vectors are fetched. Within
the probed cells the result is therefore exact. With a floor a pair counts for
both of its vectors, whichever of them probed the other's cell.

Fitted on a bounded sample (``FIT_ROWS``); the probes are chosen by the exact
neighbours, among all vectors, of at most ``PROBE_QUERIES`` of them, and with a
floor by drawn neighbours at the floor itself, the hardest, of the whole sample.
Every vector is indexed and every vector queries. Tasks look vectors up in a
mapped file, so that ids and codes are all that is shuffled. Cells grow with the root of the
number of vectors and are cut into blocks on both sides, so a crowded cell is
spread over tasks; of exact copies only the k + 1 smallest ids are indexed,
which is all that any top k can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.operators import mapped
from rillstone.operators.balance import fragment_replicate_join
from rillstone.session import materialize, small, sweep

#: Vectors that the quantisers are fitted on, at most, and of these for each coarse cell at least.
FIT_ROWS, CELL_ROWS = 32_768, 16
#: Vectors whose exact neighbours among all vectors the probes are chosen by, at most; pairs that decide, at least.
PROBE_QUERIES, PROBE_PAIRS = 1_000, 40
#: Share of the pairs drawn at the floor that one of the two must find.
DRAWN_FOUND = 0.999
#: Vectors in a block of a cell, and queries in a block against it.
DB_BLOCK, QUERY_BLOCK = 4_096, 16_384
#: Dimensions of a subspace; 16 centres each, so four bits.
SUB = 2
CENTRES = 16
#: Candidates of one block that are named one by one; of more, the query gets all of the block exactly.
NAMED = 128
#: Queries scanned at once, and exact scores of single pairs computed at once.
SCAN_QUERIES, PAIRS = 128, 131_072
#: Rounding of a unit query to half precision (or better), and of single-precision sums: no score is off by more.
HALF = 6e-4


@dataclass(frozen=True)
class Quantiser:
    """Coarse cells, residual codebooks (subspace, centre, SUB) and the weight of the parallel error."""

    cells: np.ndarray
    books: np.ndarray
    eta: float

    def assign(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` best cells of unit vectors, best first."""
        s = x @ self.cells.T
        n = min(n, s.shape[1])
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(x), 1))
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, subspaces) of the residuals by coordinate descent on the score-aware loss."""
        r = (x - self.cells[cell]).reshape(len(x), -1, SUB)
        u = x.reshape(r.shape)
        codes = np.empty(r.shape[:2], np.uint8)
        for s in range(r.shape[1]):
            codes[:, s] = ((r[:, s, None, :] - self.books[s]) ** 2).sum(2).argmin(1)
        err = r - self.books[np.arange(r.shape[1]), codes]
        along = (err * u).sum(2)
        total = along.sum(1)
        for _ in range(rounds):
            for s in range(r.shape[1]):
                e = r[:, s, None, :] - self.books[s]
                rest = (total - along[:, s])[:, None]
                part = (e * u[:, s, None, :]).sum(2)
                codes[:, s] = ((e**2).sum(2) + (self.eta - 1) * (rest + part) ** 2).argmin(1)
                along[:, s] = np.take_along_axis(part, codes[:, s, None].astype(int), 1)[:, 0]
                total = rest[:, 0] + along[:, s]
        return codes

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Look the codes up in the tables."""
        return self.cells[cell] + self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def unpack(packed: np.ndarray, subspaces: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :subspaces]


def parallel_weight(dim: int, threshold: float) -> float:
    """Weight of the parallel error for queries whose score is at least ``threshold`` times the norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _means(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from random rows."""
    c = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        half = (c * c).sum(1) / 2
        near = np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(n))
        full = np.flatnonzero(np.diff(np.r_[starts, len(x)]) > 0)
        sums = np.add.reduceat(x[order], starts[full], axis=0)
        c[full] = sums / np.diff(np.r_[starts, len(x)])[full, None]
    return c


def _unit_rows(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def coarse_cells(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """About ``n`` unit centres, whatever the size of the sample ``x``.

    More than the sample can carry are made of two levels: each first centre
    plus each of the residual centres that all of them share.
    """
    first = max(1, min(n, len(x) // CELL_ROWS))
    cells = _unit_rows(_means(x, first, rounds, rng))
    second = -(-n // first)
    if second > 1 and first > 1:
        own = np.concatenate([(x[i : i + 4096] @ cells.T).argmax(1) for i in range(0, len(x), 4096)])
        rest = _means(x - cells[own], min(second, first), rounds, rng)
        cells = _unit_rows((cells[:, None] + rest[None]).reshape(-1, x.shape[1]))
    return cells.astype(np.float32)


def fit(x: np.ndarray, n_cells: int, threshold: float = 0.3, rounds: int = 5, seed: int = 5) -> Quantiser:
    """Fit cells and codebooks on unit vectors (float32, of even dimension)."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    cells = coarse_cells(x, n_cells, rounds, rng)
    eta = parallel_weight(dim, threshold)
    q = Quantiser(cells, np.zeros((dim // SUB, CENTRES, SUB), np.float32), eta)
    cell = np.concatenate([q.assign(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
    r, u = (x - cells[cell]).reshape(len(x), -1, SUB), x.reshape(len(x), -1, SUB)
    books = np.stack([r[rng.integers(0, len(x), CENTRES), s] for s in range(dim // SUB)])
    for _ in range(rounds):
        q = Quantiser(cells, books.astype(np.float32), eta)
        codes = q.encode(x, cell, 1)
        along = ((r - q.books[np.arange(codes.shape[1]), codes]) * u).sum(2)
        total = along.sum(1)
        books = q.books.copy()
        for s in range(dim // SUB):
            # least squares of each centre: (n I + (eta-1) sum uu') c = sum r + (eta-1) sum (rest + r.u) u
            rest = total - along[:, s]
            w = (rest + (r[:, s] * u[:, s]).sum(1))[:, None] * u[:, s]
            outer = u[:, s, :, None] * u[:, s, None, :]
            for k in range(CENTRES):
                at = codes[:, s] == k
                if at.any():
                    left = at.sum() * np.eye(SUB) + (eta - 1) * outer[at].sum(0)
                    books[s, k] = np.linalg.solve(left, r[at, s].sum(0) + (eta - 1) * w[at].sum(0))
    return Quantiser(cells, books.astype(np.float32), eta)


def tables(q: Quantiser, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Tables of a block of queries: (byte, 256, query) as whole numbers, and what they stand for.

    A code's score is about centre + ``base`` + ``step`` * (sum of its bytes'
    entries), off by no more than ``slack`` steps; 16-bit sums never overflow.
    """
    n = q.books.shape[0]
    t = q.books @ np.ascontiguousarray(y.T).reshape(n, SUB, len(y))
    low = t.min(1)
    levels = 65_000 // n
    step = np.maximum((t.max(1) - low).max(0) / levels, 1e-12)
    whole = np.rint((t - low[:, None]) / step).astype(np.uint16)
    if n % 2:
        whole = np.concatenate([whole, np.zeros((1, *whole.shape[1:]), np.uint16)])
    both = whole[1::2, :, None] + whole[::2, None]  # high nibble, low nibble
    return both.reshape(len(both), CENTRES * CENTRES, len(y)), low.sum(0), step, n / 2 + 1


def scan_codes(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of the table entries of packed codes: (code, query)."""
    at = np.ascontiguousarray(codes.T).astype(np.intp)
    total = table[0][at[0]]
    part = np.empty_like(total)
    for b in range(1, len(table)):
        np.take(table[b], at[b], axis=0, out=part, mode="clip")  # a byte is never out of range, and this mode needs no buffer
        total += part
    return total


def _nearest(y: np.ndarray, y_id: np.ndarray, k: int):
    """The k nearest to a few queries among a task's vectors: ``query, near, cos, vec``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)), np.zeros((0, y.shape[1]), np.float32))
        least = np.full(len(y), -2.0)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                ids, x = part.column(0).to_numpy(), _padded(_unit(_matrix(part.column(1), np.float32)))
                s = y @ x.T
                s[y_id[:, None] == ids[None, :]] = -9
                hit = s > least[:, None]
                if hit.sum() > 4 * k * len(y):  # none beyond the k best of these vectors alone can count
                    n = min(k, s.shape[1])
                    hit &= s >= -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                row, col = np.nonzero(hit)
                both = [np.concatenate(c) for c in zip(kept, (row, ids[col], s[row, col], x[col].astype(np.float32)), strict=True)]
                order = np.lexsort((both[1], -both[2], both[0]))
                row = both[0][order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                order = order[rank < k]
                kept = tuple(c[order] for c in both)
                full, n = np.unique(kept[0], return_counts=True)
                ends = np.cumsum(n) - 1
                least[full[n == k]] = kept[2][ends[n == k]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in kept[:3]], _binary(kept[3])], names=["query", "near", "cos", "vec"])

    return run


def cell_ranks(q: Quantiser, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of unit vectors (float32): the place of y's own cell among the cells that x probes, and of x's among y's."""
    out = []
    for i in range(0, len(x), 4096):
        a, b = x[i : i + 4096] @ q.cells.T, y[i : i + 4096] @ q.cells.T
        at = np.arange(len(a))
        out.append([(s > s[at, other.argmax(1)][:, None]).sum(1) for s, other in ((a, b), (b, a))])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def drawn_at(x: np.ndarray, cos: float, seed: int = 7) -> np.ndarray:
    """For each unit vector another in a random direction, with this cosine to it."""
    e = np.random.default_rng(seed).standard_normal(x.shape)
    e = _unit_rows(e - (e * x).sum(1, keepdims=True) * x)
    return (cos * x + np.sqrt(max(0.0, 1 - cos * cos)) * e).astype(np.float32)


def choose_probes(q: Quantiser, index: DataFrame, sample: pa.Table, k: int, floor: float) -> int:
    """Cells to probe so that true neighbours lie in a probed cell.

    Without a floor: 96 % of the ``k`` nearest of ``PROBE_QUERIES`` vectors of the
    sample among all vectors, found by brute force (of at least ``PROBE_PAIRS``).
    With a floor: all of these pairs from the floor, and ``DRAWN_FOUND`` of as
    many pairs drawn at the floor as the sample has vectors, each from either side.
    """
    asks = sample.slice(0, PROBE_QUERIES)
    y, y_id = _padded(_unit(_matrix(asks.column("vec"), np.float32))), asks.column("id").to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((y, y_id, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _nearest(*shared.value)(batches)

    found = index.select("id", "vec").mapInArrow(run, "query long, near long, cos double, vec binary")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "near"))
    got = found.withColumn("r", best).where(F.col("r") <= k).select("query", "cos", "vec").toArrow()  # PROBE_QUERIES x k rows at most
    if not got.num_rows:
        return 1
    row, cos, near = got.column("query").to_numpy(), got.column("cos").to_numpy(), _matrix(got.column("vec"), np.float32)
    pick = np.argsort(-cos, kind="stable")[: max(int((cos >= floor).sum()), PROBE_PAIRS)]
    there, back = cell_ranks(q, y[row[pick]].astype(np.float32), near[pick])
    if floor <= -1:
        return int(np.quantile(there, 0.96, method="higher")) + 1
    x = _padded(_unit(_matrix(sample.column("vec"), np.float32))).astype(np.float32)
    hard = np.minimum(*cell_ranks(q, x, drawn_at(x, floor)))
    return int(max(np.minimum(there, back).max(), np.quantile(hard, DRAWN_FOUND, method="higher"))) + 1


def _usable(id_name: str, vec_name: str, dim: int):
    """Keep rows with an id and ``dim`` finite numbers, not all zero; vectors as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, ids = b.column(1), b.column(0)
            length = np.diff(vec.offsets.to_numpy())
            ok = (length == dim) & vec.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            values = vec.values.cast(pa.float32()).to_numpy(zero_copy_only=False)  # null elements become NaN
            at = vec.offsets.to_numpy()[:-1][ok]
            x = values[at[:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim), np.float32)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            keep = np.flatnonzero(ok)[good]
            x = np.ascontiguousarray(x[good] + np.float32(0), np.float32)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)).cast(pa.int64()), b.column(2).take(pa.array(keep)), _binary(x)], names=["id", "at", "vec"])

    return run


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow binary column."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = (np.arange(len(x) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def _matrix(col: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The inverse of ``_binary``."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, 1), dtype)
    o = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[o[0] : o[-1]].view(dtype).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # very long and very short vectors
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, id: str, vector: str, dim: int, newest: str | None = None) -> DataFrame:
    """One usable vector for each id: ``id, vec`` (float32 bytes).

    Null ids, null, short or long arrays, null, NaN or infinite elements and
    zero vectors are left out. Of several rows of an id the one with the
    highest ``newest`` counts, then the bytewise greatest.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), (F.col(newest).cast("timestamp") if newest else F.lit(None).cast("timestamp")).alias("at"))
    rows = rows.where("id is not null and v is not null").mapInArrow(_usable("id", "v", dim), "id long, at timestamp, vec binary")
    return rows.groupBy("id").agg(F.max(F.struct(F.coalesce("at", F.lit("1000-01-01").cast("timestamp")).alias("at"), "vec")).alias("r")).select("id", "r.vec")


def _padded(x: np.ndarray) -> np.ndarray:
    """A zero dimension more if their number is odd."""
    return np.pad(x, ((0, 0), (0, x.shape[1] % SUB))) if x.shape[1] % SUB else x


def _deal(q: Quantiser, probes: int):
    """Probed cells (the first is its own), code, and the code's error along and across the vector of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                exact = _padded(_unit(_matrix(part.column(1), np.float32)))
                x = exact.astype(np.float32)
                cells = q.assign(x, probes)
                codes = q.encode(x, cells[:, 0])
                error = exact - q.decode(codes, cells[:, 0])
                along = (error * exact).sum(1)
                across = np.linalg.norm(error - along[:, None] * exact, axis=1)
                flat = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * cells.shape[1]).astype(np.int32)), pa.array(cells.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), flat, _binary(pack(codes)), pa.array(along.astype(np.float32)), pa.array(across.astype(np.float32))], names=["id", "cells", "codes", "along", "across"])

    return run


def _floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as lists of numbers."""
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(1), np.float32)
            flat = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "vec"])


def _looked_up(vectors: mapped.Flat, ids: np.ndarray) -> np.ndarray:
    """The unit vectors of ids."""
    held = vectors.open()
    return _padded(_unit(np.asarray(held["vec"][np.searchsorted(held["id"], ids)])))


def _lists(row: np.ndarray, value: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, sorted by row, as one list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)), pa.array(value, kind))


_CANDIDATES = pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("d", pa.int64()), ("near", pa.list_(pa.int64())), ("most", pa.list_(pa.float32())), ("sure", pa.list_(pa.float32()))])
_CANDIDATES_SQL = "id long, cell int, d long, near array<bigint>, most array<float>, sure array<float>"


def cosine_bounds(score: np.ndarray, along: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest cosine of a unit query with vectors whose codes give ``score``.

    With cosine c the code scores c (1 - along) minus the query's part across the
    vector times the error's, which is sqrt(1 - c^2) ``across`` at most.
    """
    a = 1 - along
    size = a * a + across * across
    mid, reach = a * score / size, across * np.sqrt(np.maximum(size - score * score, 0)) / size
    return mid - reach, mid + reach


def _scan(q: Quantiser, vectors: mapped.Flat, k: int, floor: float):
    """Scan the codes of one block of a cell for one block of queries, looked up in ``vectors``.

    A row for each query that has candidates here: ``near`` with the most each
    can score, or null and 1 if all of the block are to be scored. Without a floor
    ``sure`` is what its k best here score at least; with one a pair below a
    query's k best may be among the other vector's, so none is left out.
    """

    def run(rows: pa.Table) -> pa.Table:
        is_db = rows.column("is_db").to_numpy().astype(bool)
        cell, d = rows.column("cell")[0].as_py(), rows.column("d")[0].as_py()
        db, ask = rows.filter(pa.array(is_db)), rows.filter(pa.array(~is_db))
        if not db.num_rows or not ask.num_rows:
            return _CANDIDATES.empty_table()
        db_id, ask_id = (t.column("id").to_numpy() for t in (db, ask))
        by_id = np.argsort(db_id)
        db_id, codes = db_id[by_id], _matrix(db.column("data"), np.uint8)[by_id]
        along, across = (db.column(c).to_numpy()[by_id] for c in ("along", "across"))
        # what a code scores at least with a query whose cosine is the floor or more
        needs = floor * (1 - along) - np.sqrt(max(0.0, 1 - floor**2)) * across if floor > -1 else np.full(len(db_id), -9.0)
        needs = needs.astype(np.float32)
        y = _looked_up(vectors, ask_id).astype(np.float32)
        centre = q.cells[cell]
        place = np.minimum(np.searchsorted(db_id, ask_id), len(db_id) - 1)
        got = []
        for i in range(0, len(y), SCAN_QUERIES):
            part, at = y[i : i + SCAN_QUERIES], place[i : i + SCAN_QUERIES]
            table, base, step, slack = tables(q, part)
            off = (slack * step + HALF).astype(np.float32)
            high = scan_codes(table, codes).astype(np.float32)  # the most a code can score with a query: (code, query)
            high *= step.astype(np.float32)
            high += (base + part @ centre).astype(np.float32) + off
            hit = high >= needs[:, None]
            own = np.flatnonzero(db_id[at] == ask_id[i : i + SCAN_QUERIES])
            hit[at[own], own] = False
            if not hit.any():
                continue
            sure = np.full((len(part), k), np.float32(-9))
            if floor <= -1:
                low = cosine_bounds((high - 2 * off).T, along, across)[0]
                low[~hit.T] = -9
                n = min(k, low.shape[1])
                sure[:, :n] = -np.partition(-low, n - 1, axis=1)[:, :n]
                if n == k:
                    hit &= (cosine_bounds(high.T, along, across)[1] >= sure.min(1)[:, None]).T
            count = hit.sum(0)
            all_ = count > NAMED
            col, row = np.nonzero(hit & ~all_)
            order = np.argsort(row, kind="stable")
            row, col = row[order], col[order]
            asks = np.flatnonzero(count)
            line = np.searchsorted(asks, row)
            most = cosine_bounds(high[col, row], along[col], across[col])[1]
            near = _lists(line, db_id[col], len(asks), pa.int64())
            line, value = np.r_[line, np.searchsorted(asks, np.flatnonzero(all_))], np.r_[most, np.ones(all_.sum())]
            order = np.argsort(line, kind="stable")
            high = _lists(line[order], value[order], len(asks), pa.float32())
            near = pa.ListArray.from_arrays(near.offsets, near.values, mask=pa.array(all_[asks]))
            own_row, own_col = np.nonzero(sure[asks] > -3)
            got.append(pa.table([pa.array(ask_id[i + asks]), pa.array(np.full(len(asks), cell, np.int32)), pa.array(np.full(len(asks), d)), near, high, _lists(own_row, sure[asks][own_row, own_col], len(asks), pa.float32())], schema=_CANDIDATES))
        return pa.concat_tables([_CANDIDATES.empty_table(), *got])

    return run


def _rerank(vectors: mapped.Flat, k: int, floor: float):
    """Exact scores of the candidates of one block: the k best of each query, and with a floor those of each vector of the block among the queries."""
    schema = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("cos", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        is_db = rows.column("is_db").to_numpy().astype(bool)
        db, ask = rows.filter(pa.array(is_db)), rows.filter(pa.array(~is_db)).combine_chunks()
        if not db.num_rows or not ask.num_rows:
            return schema.empty_table()
        db_id, ask_id = (t.column("id").to_numpy() for t in (db, ask))
        db_id = np.sort(db_id)
        x, y = _looked_up(vectors, db_id), _looked_up(vectors, ask_id)
        near = ask.column("near").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        n = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, col = np.repeat(np.arange(len(y)), n), np.searchsorted(db_id, near.flatten().to_numpy())
        cos = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", y[row[j : j + PAIRS]], x[col[j : j + PAIRS]]) for j in range(0, len(row), PAIRS)]])
        got = [(row, col, cos)]
        every = np.flatnonzero(near.is_null().to_numpy(zero_copy_only=False))
        for j in range(0, len(every), 512):
            s = y[every[j : j + 512]] @ x.T
            s[ask_id[every[j : j + 512], None] == db_id[None, :]] = -9
            n = min(k, s.shape[1])
            good = s >= -np.partition(-s, n - 1, axis=1)[:, n - 1 : n] - 1e-12
            if floor > -1:
                n = min(k, s.shape[0])
                good |= s >= -np.partition(-s, n - 1, axis=0)[n - 1 : n] - 1e-12
            r, c = np.nonzero(good & (s >= max(floor, -2.0) - 1e-12))
            got.append((every[j + r], c, s[r, c]))
        row, col, cos = (np.concatenate(c) for c in zip(*got, strict=True))
        ok = cos >= max(floor, -2.0)
        own, near, cos = ask_id[row[ok]], db_id[col[ok]], cos[ok]
        out = []
        for a, b in ((own, near), (near, own)) if floor > -1 else ((own, near),):
            order = np.lexsort((b, -cos, a))
            a, b, c = a[order], b[order], cos[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((a[keep], b[keep], c[keep]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def neighbours(df: DataFrame, id: str, vector: str, dim: int, k: int, floor: float = -2.0, probes: int | None = None, newest: str | None = None, cells: int | None = None) -> DataFrame:
    """The ``k`` nearest by cosine of every usable vector: ``id, near, cos``.

    Neighbours below ``floor`` are left out, an id is not its own neighbour,
    equal cosines go to the smaller id. Approximate: a neighbour in none of the
    ``probes`` nearest cells is missed, with a floor only if neither of the two
    probes the other's cell (for the number by default see ``choose_probes``);
    ``recall`` measures how many are. No usable vectors give no rows.
    """
    spark = df.sparkSession
    head = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    all_rows = usable_vectors(df, id, vector, dim, newest).withColumn("h", F.struct(F.xxhash64("vec").alias("a"), F.hash("vec").alias("b")))
    all_rows = materialize(all_rows.withColumn("copy", head), "vectors")
    sweep(spark)
    index = all_rows.where(F.col("copy") <= k + 1)
    n = index.count()
    if not n:
        return spark.createDataFrame([], "id long, near long, cos double")
    # the hash bound leaves about twice the sample, however many rows there are
    some = index.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 2 * FIT_ROWS / n)))
    sample = some.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id", "vec").toArrow()
    q = fit(_padded(_unit(_matrix(sample.column("vec"), np.float32))).astype(np.float32), cells or max(1, round(n**0.5)))
    probes = probes or choose_probes(q, index, sample, k, floor)
    shared = spark.sparkContext.broadcast(q)  # about sqrt(n) x dim numbers
    dealt = materialize(index.select("id", "vec").mapInArrow(_on(shared, _deal, probes), "id long, cells array<int>, codes binary, along float, across float"), "vectors-dealt")
    vectors = mapped.write_flat(index.select("id", "vec").mapInArrow(_floats, "id long, vec array<float>"), ["id"], {"id": ("int64", 0), "vec": ("float32", dim)}, "vectors-exact")
    sweep(spark)
    own = F.get("cells", F.lit(0))
    sizes = dealt.select(own.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_db"))
    asks = dealt.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_ask"))
    blocks = materialize(sizes.join(asks, "cell").select("cell", F.ceil(F.col("n_db") / DB_BLOCK).cast("int").alias("db_blocks"), F.ceil(F.col("n_ask") / QUERY_BLOCK).cast("int").alias("q_blocks")), "vectors-blocks")
    few = small(blocks, len(q.cells))  # a row for each cell
    turn = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    block = F.pmod(turn, F.col("db_blocks").cast("long"))
    none = [F.lit(None).cast("float").alias(c) for c in ("along", "across")]
    db = dealt.withColumn("cell", own).join(few, "cell")
    db = db.select("cell", block.alias("d"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("u"), F.lit(1).alias("is_db"), "id", F.col("codes").alias("data"), "along", "across")
    ask = dealt.select(F.explode("cells").alias("cell"), "id").join(few, "cell")
    ask = ask.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("db_blocks").cast("long") - 1)).alias("d"), F.pmod(turn, F.col("q_blocks").cast("long")).cast("int").alias("u"), F.lit(0).alias("is_db"), "id", F.lit(None).cast("binary").alias("data"), *none)
    found = materialize(db.unionByName(ask).groupBy("cell", "d", "u").applyInArrow(_on_group(shared, vectors, k, floor), _CANDIDATES_SQL), "vectors-candidates")
    sweep(spark)
    # what a query's k best score at least, over all its blocks: candidates that can't reach it are dropped (none with a floor)
    sure = found.select("id", F.explode("sure").alias("s"))
    kth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s")))
    bound = sure.withColumn("r", kth).where(F.col("r") == k).select("id", F.col("s").alias("bound"))
    wanted = found.drop("sure").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-9.0)))
    pairs = F.filter(F.arrays_zip("near", "most"), lambda p: p["most"] >= F.col("bound"))
    wanted = wanted.where(F.array_max("most") >= F.col("bound")).select("id", "cell", "d", F.when(F.col("near").isNotNull(), F.transform(pairs, lambda p: p["near"])).alias("near"))
    wanted = materialize(wanted, "vectors-wanted")
    parts = wanted.groupBy("cell", "d").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    lists = F.lit(None).cast("array<bigint>").alias("near")
    fetched = dealt.withColumn("cell", own).join(few, "cell").select("cell", block.alias("d"), "id").join(parts, ["cell", "d"])
    fetched = fetched.select("cell", "d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u"), F.lit(1).alias("is_db"), "id", lists)
    asked = wanted.join(parts, ["cell", "d"]).select("cell", "d", F.pmod(turn, F.col("parts").cast("long")).cast("int").alias("u"), F.lit(0).alias("is_db"), "id", "near")
    scored = fetched.unionByName(asked).groupBy("cell", "d", "u").applyInArrow(_rerank(vectors, k, floor), "id long, near long, cos double")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "near"))
    if floor > -1:  # a pair may come from either side
        scored = scored.repartition("id").groupBy("id", "near").agg(F.max("cos").alias("cos"))
    near = scored.withColumn("r", best).where(F.col("r") <= k).drop("r")
    # further exact copies: their k nearest are the k smallest ids among the copies
    rest = all_rows.where(F.col("copy") > k + 1).select("id", F.col("h.a").alias("h"), F.col("h.b").alias("h2"))
    if not rest.isEmpty():
        heads = index.where(F.col("copy") <= k).select(F.col("h.a").alias("h"), F.col("h.b").alias("g"), F.col("id").alias("near"))
        copies = fragment_replicate_join(rest, heads, "h").where("h2 = g").select("id", "near", F.lit(1.0).alias("cos"))
        near = near.unionByName(copies)
    return near


def _on(shared, make, probes: int):
    def run(batches):
        yield from make(shared.value, probes)(batches)

    return run


def _on_group(shared, vectors: mapped.Flat, k: int, floor: float):
    def run(rows: pa.Table) -> pa.Table:
        return _scan(shared.value, vectors, k, floor)(rows)

    return run


def exact_neighbours(df: DataFrame, id: str, vector: str, dim: int, k: int, floor: float = -2.0, every: int = 1, newest: str | None = None, block: int = 8192) -> DataFrame:
    """Brute force for ids divisible by ``every`` against all rows, in blocks."""
    rows = materialize(usable_vectors(df, id, vector, dim, newest), "vectors-exact")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    nq, nd = max(1, -(-queries.count() // block)), max(1, -(-rows.count() // block))
    turn = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = queries.select(turn(nq).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("d"), F.lit(0).alias("is_db"), "id", "vec")
    b = rows.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("u"), turn(nd).alias("d"), F.lit(1).alias("is_db"), "id", "vec")

    def run(t: pa.Table) -> pa.Table:
        is_db = t.column("is_db").to_numpy().astype(bool)
        db, ask = t.filter(pa.array(is_db)), t.filter(pa.array(~is_db))
        x_id, y_id = db.column("id").to_numpy(), ask.column("id").to_numpy()
        x, out = _unit(_matrix(db.column("vec"), np.float32)) if len(x_id) else np.zeros((0, dim)), []
        y = _unit(_matrix(ask.column("vec"), np.float32)) if len(y_id) else np.zeros((0, dim))
        for i in range(0, len(y), 512):
            s = y[i : i + 512] @ x.T
            s[y_id[i : i + 512, None] == x_id[None, :]] = -9
            for r, row in enumerate(s):
                top = np.flatnonzero(row >= max(floor, -np.partition(-row, min(k, len(row)) - 1)[min(k, len(row)) - 1]) - 1e-9)
                top = top[row[top] >= max(floor, -2)]
                top = top[np.lexsort((x_id[top], -row[top]))][:k]
                out.append((np.full(len(top), y_id[i + r]), x_id[top], row[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(cols, names=["id", "near", "cos"])

    found = a.unionByName(b).groupBy("u", "d").applyInArrow(run, "id long, near long, cos double")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "near"))
    return found.withColumn("r", best).where(F.col("r") <= k).drop("r")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found: ``n_exact, n_found, recall``."""
    both = exact.join(found.select("id", "near", F.lit(1).alias("hit")), ["id", "near"], "left")
    out = both.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.try_divide(F.col("n_found").cast("double"), "n_exact"))
