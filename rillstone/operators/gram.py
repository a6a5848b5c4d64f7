"""Blocked Gram matrix: sums over records of the products of the ids that stand together in them.

With X the sparse matrix of records and ids, X'X is summed over blocks of
records. A task gathers records until their product would have ``CELLS`` cells
(a record block), whose ids are hashed to column blocks X_I, forms the products
X_I' X_J and adds equal cells up, in a dense accumulator where they fill it and
by sorting where they are sparse. Each tile (I, J) leaves as one row: ids and
places as compressed differences. The tiles of one place are summed over the
record blocks, and only what a reader wants of a finished tile (cells of enough
records, or the k best of each id) leaves that task.

Records longer than ``PART`` are cut into parts, and the pairs of parts spread
over tasks, so neither a long basket nor a crowded key is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.session import materialize, parallelism, small

#: Ids of one record, or one part of a longer record.
PART = 1024
#: Cells of one record block, and of one finished block about.
CELLS = 4_000_000

_codec = pa.Codec("zstd", 1)


def _pack(x: np.ndarray) -> tuple[bytes, int]:
    """Numbers as compressed byte planes of the narrowest width; and the width."""
    if x.dtype == np.float64:
        planes, width = x.view(np.uint8).reshape(-1, 8), 8
    else:
        u = x.astype(np.int64).view(np.uint64)
        top = int(u.max()) if len(u) else 0
        width = max(1, (top.bit_length() + 7) // 8)
        planes = u.view(np.uint8).reshape(-1, 8)[:, :width]
    return _codec.compress(np.ascontiguousarray(planes.T), asbytes=True), width


def _unpack(raw: bytes, width: int, n: int, dtype: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(_codec.decompress(raw, n * width), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = flat.T
    return out.view(dtype).ravel()


def encode_block(a_ids: np.ndarray, b_ids: np.ndarray, la: np.ndarray, lb: np.ndarray, n: np.ndarray, dot: np.ndarray | None) -> bytes:
    """A summed block whose cells (places in ``a_ids``, ``b_ids``) are sorted by row, then column."""
    rows, length = np.unique(la, return_counts=True)
    cols, lb = np.unique(lb, return_inverse=True) if len(b_ids) < 4 * len(lb) else (np.arange(len(b_ids)), lb)
    step = np.diff(lb, prepend=0)
    first = np.cumsum(length) - length
    step[first] = lb[first]
    parts = [(np.diff(a_ids[rows], prepend=0), len(rows)), (length, len(rows)), (np.diff(b_ids[cols], prepend=0), len(cols)), (step, len(lb)), (n, len(n))]
    if dot is not None:
        parts.append((dot, len(dot)))
    out, head = [], [len(parts)]
    for x, size in parts:
        raw, width = _pack(x)
        head += [size, width, len(raw)]
        out.append(raw)
    return np.array(head, np.int32).tobytes() + b"".join(out)


def decode_block(raw: bytes) -> tuple[np.ndarray, ...]:
    """Row ids, places of the cells' rows, column ids, places of the columns, counts and sums (None if not kept)."""
    k = int(np.frombuffer(raw, np.int32, 1)[0])
    head = np.frombuffer(raw, np.int32, 1 + 3 * k)[1:].reshape(k, 3)
    at, got = 4 * (1 + 3 * k), []
    for j, (size, width, length) in enumerate(head.tolist()):
        got.append(_unpack(raw[at : at + length], width, size, np.float64 if j == 5 else np.int64))
        at += length
    rows, length, cols, step, n = got[:5]
    run = np.cumsum(step)
    first = np.cumsum(length) - length
    base = run[first] - step[first]
    return np.cumsum(rows), np.repeat(np.arange(len(rows)), length), np.cumsum(cols), run - np.repeat(base, length), n, got[5] if k > 5 else None


def add_cells(code: np.ndarray, n: np.ndarray | None, dot: np.ndarray | None, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Add equal cells up: distinct codes ascending, counts and sums."""
    if space <= 4 * len(code):
        count = np.bincount(code, n, space)
        at = np.flatnonzero(count)
        return at, count[at].astype(np.int64), None if dot is None else np.bincount(code, dot, space)[at]
    if n is None and dot is None:
        code = np.sort(code.astype(np.uint32) if space < 1 << 32 else code)
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        return code[start].astype(np.int64), np.diff(np.r_[start, len(code)]), None
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    count = np.diff(np.r_[start, len(code)]) if n is None else np.add.reduceat(n[order], start) if len(start) else n[:0]
    return code[start], count, None if dot is None else np.add.reduceat(dot[order], start) if len(start) else dot[:0]


def block_products(rec: np.ndarray, ids: np.ndarray, side: np.ndarray, value: np.ndarray | None, n_rec: int, blocks: int, add: bool) -> Iterator[tuple[int, int, bytes]]:
    """The tiles X_I' X_J, I <= J, of one record block that have cells, encoded.

    Entries are sorted by record, side and id. A record with entries of side 1
    is a pair of parts: its cells join one of each side; else its cells are all
    pairs of its entries. ``add`` sums value + value instead of value * value.
    """
    uniq, local = np.unique(ids, return_inverse=True)
    block_of = (uniq ^ (uniq >> 17)) % blocks
    order = np.argsort(block_of, kind="stable")
    starts = np.searchsorted(block_of[order], np.arange(blocks + 1))
    place = np.empty(len(uniq), np.int64)
    place[order] = np.arange(len(uniq)) - starts[block_of[order]]
    width = int(place.max()) + 1 if len(place) else 1
    column = block_of[local] * width + place[local]  # ids of a block stand together
    # the entries each entry is multiplied with: those after it, or those of the other part
    end = np.searchsorted(rec, np.arange(n_rec), side="right")
    right = end - np.bincount(rec[side == 1], minlength=n_rec)
    start = np.where(right[rec] < end[rec], right[rec], np.arange(1, len(rec) + 1))
    count = np.where(side == 0, end[rec] - start, 0)
    p = np.repeat(np.arange(len(rec)), count)
    q = np.arange(len(p)) - np.repeat(np.cumsum(count) - count - start, count)
    dot = None if value is None else value[p] + value[q] if add else value[p] * value[q]
    a, b = np.minimum(column[p], column[q]), np.maximum(column[p], column[q])
    space = blocks * width
    tile = (a // width) * blocks + b // width
    code, n, dot = add_cells((tile * width + a % width) * width + b % width, None, dot, space * space)
    tile = code // (width * width)
    cuts = np.r_[0, np.flatnonzero(np.diff(tile)) + 1, len(tile)] if len(tile) else np.zeros(1, int)
    for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, j = divmod(int(tile[at]), blocks)
        cell = code[at:to] % (width * width)
        yield i, j, encode_block(uniq[order[starts[i] : starts[i + 1]]], uniq[order[starts[j] : starts[j + 1]]], cell // width, cell % width, n[at:to], None if dot is None else dot[at:to])


def _record_blocks(blocks: int, add: bool, valued: bool):
    """Gather the records of a task into record blocks and send the summed products."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        rec = np.concatenate([h[0] for h in held])
        ids, side = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        value = np.concatenate([h[3] for h in held]) if valued else None
        rec = np.unique(rec, return_inverse=True)[1]
        order = np.lexsort((ids, side, rec))
        rec, ids, side = rec[order], ids[order], side[order]
        out = list(block_products(rec, ids, side, value[order] if valued else None, int(rec[-1]) + 1 if len(rec) else 0, blocks, add))
        for at in range(0, len(out), 16):
            cut = out[at : at + 16]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2] for c in cut], pa.binary())], names=["i", "j", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        for batch in batches:
            n = [np.diff(batch.column(c).offsets.to_numpy()) for c in range(2)]
            work = np.where(n[1] > 0, n[0].astype(np.int64) * n[1], n[0].astype(np.int64) * (n[0] - 1) // 2)
            at = 0
            while at < batch.num_rows:
                total = np.cumsum(work[at:])
                to = at + max(1, int(np.searchsorted(total, CELLS - size, side="right")))
                for s in (0, 1):
                    col = batch.column(s).slice(at, to - at)
                    rec = np.repeat(np.arange(at, to), n[s][at:to]) + seen
                    value = batch.column(2 + s).slice(at, to - at).flatten().to_numpy(zero_copy_only=False) if valued else None
                    held.append((rec, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(rec), s, np.int8), value))
                size += int(total[to - at - 1])
                at = to
                if size >= CELLS:
                    yield from flush(held)
                    held, size = [], 0
            seen += batch.num_rows
        if size:
            yield from flush(held)

    return run


@dataclass(frozen=True)
class Tile:
    """Finished cells, by row and then column: places in the ids of both sides, counts and sums (None if not kept)."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    ia: np.ndarray
    ib: np.ndarray
    n: np.ndarray
    dot: np.ndarray | None

    def where(self, ok: np.ndarray) -> Tile:
        return self if ok.all() else Tile(self.a_ids, self.b_ids, self.ia[ok], self.ib[ok], self.n[ok], None if self.dot is None else self.dot[ok])


def sum_blocks(payloads: list[bytes]) -> Tile:
    """The tile of one place over all record blocks."""
    parts = [decode_block(p) for p in payloads]
    a_ids, b_ids = np.unique(np.concatenate([p[0] for p in parts])), np.unique(np.concatenate([p[2] for p in parts]))
    code = np.concatenate([np.searchsorted(a_ids, p[0])[p[1]] * len(b_ids) + np.searchsorted(b_ids, p[2])[p[3]] for p in parts])
    n = np.concatenate([p[4] for p in parts])
    dot = np.concatenate([p[5] for p in parts]) if parts[0][5] is not None else None
    if len(parts) > 1:
        code, n, dot = add_cells(code, n, dot, len(a_ids) * len(b_ids))
    return Tile(a_ids, b_ids, code // len(b_ids), code % len(b_ids), n, dot)


def gram(work: DataFrame, reduce: Callable[[Tile], pa.Table], schema: str, valued: bool = False, add: bool = False) -> DataFrame:
    """Run ``reduce`` on every finished tile.

    ``work`` has arrays ``x, y`` of BIGINT (and ``xv, yv`` of DOUBLE): a record,
    or a part of one in ``x`` alone, or a pair of parts of a record. Ids are
    distinct within a record. A tile has each unordered pair once, either id
    first; ``reduce`` must return ``schema``.
    """
    size = F.size("x").cast("double")
    cells = work.agg(F.sum(F.when(F.size("y") > 0, size * F.size("y")).otherwise(size * (size - 1) / 2)).alias("c")).first()["c"] or 0.0
    pairs = max(3.0 * parallelism(work.sparkSession), cells / CELLS)  # block pairs
    blocks = max(1, math.ceil(math.sqrt(2 * pairs)))
    columns = ["x", "y", "xv", "yv"] if valued else ["x", "y"]
    summed = work.select(*columns).mapInArrow(_record_blocks(blocks, add, valued), "i int, j int, cells binary")

    def finish(t: pa.Table) -> pa.Table:
        return reduce(sum_blocks(t.column("cells").to_pylist()))

    return summed.groupBy("i", "j").applyInArrow(finish, schema)


def array_records(df: DataFrame, items: str, part: int = PART) -> DataFrame:
    """The work of records that are arrays of distinct integers: ``x, y``; arrays beyond ``part`` as pairs of parts."""
    rows = df.where(F.size(items) > 1).select(F.col(items).cast("array<bigint>").alias("m"))
    none = F.array().cast("array<bigint>")
    short = rows.where(F.size("m") <= part).select(F.col("m").alias("x"), none.alias("y"))
    n = F.call_function("div", F.size("m") - 1, F.lit(part)).cast("int")
    cut = lambda i: F.slice("m", i * part + 1, F.lit(part))
    long = (
        rows.where(F.size("m") > part).select("m", F.explode(F.sequence(F.lit(0), n)).alias("i"))
        .select("m", "i", F.explode(F.sequence(F.col("i"), n)).alias("j"))
        .select(cut(F.col("i")).alias("x"), F.when(F.col("i") == F.col("j"), none).otherwise(cut(F.col("j"))).alias("y"))
        .repartition(F.xxhash64("x", "y"))
    )
    return short.unionByName(long)


def keyed_records(rows: DataFrame, key: str, id: str, value: str, part: int = PART, counted: DataFrame | None = None) -> DataFrame:
    """The work of rows (key, id, value), distinct in key and id: ``x, y, xv, yv``, written to the shared folder.

    Keys beyond ``part`` rows are dealt by a hash of the id to parts; every
    pair of parts is a unit of its own, so no key is gathered in one place.
    ``counted`` may name a cheaper frame with at least the same rows of each key.
    """
    sizes = (rows if counted is None else counted).select(F.col(key).alias("_k")).dropna().groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.select(F.col(key).alias("_k"), F.col(id).cast("bigint").alias("_i"), F.col(value).cast("double").alias("_v")).dropna(subset=["_k", "_i"])
    hot = materialize(sizes.where(F.col("_n") > part).select("_k", F.ceil(F.col("_n") / F.lit(part)).cast("int").alias("_c")), "gram-keys")
    cut = rows.join(small(hot, hot.count()), "_k", "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    cut = cut.withColumn("_p", F.pmod(F.xxhash64("_i"), F.col("_c").cast("long")).cast("int"))
    # the parts a row's part is paired with: (least, greatest)
    pairs = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda q: F.struct(F.least("_p", q).alias("lo"), F.greatest("_p", q).alias("hi")))
    cut = cut.withColumn("_q", F.explode(pairs))
    entry = F.struct("_i", "_v")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("_p") == F.col(f"_q.{s}"), entry)))
    work = cut.groupBy("_k", "_q").agg(side("lo").alias("a"), side("hi").alias("b"))
    same = F.col("_q.lo") == F.col("_q.hi")
    work = work.where((same & (F.size("a") > 1)) | (~same & (F.size("a") > 0) & (F.size("b") > 0)))
    none = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    out = work.select(
        F.col("a._i").alias("x"), F.when(same, none[0]).otherwise(F.col("b._i")).alias("y"), F.col("a._v").alias("xv"), F.when(same, none[1]).otherwise(F.col("b._v")).alias("yv")
    )
    return materialize(out, "gram-records")


def cells_of(min_common: int = 1):
    """Keep the cells of at least ``min_common`` records: ``a, b, n, dot`` with a < b."""

    def reduce(t: Tile) -> pa.Table:
        t = t.where(t.n >= min_common)
        a, b = t.a_ids[t.ia], t.b_ids[t.ib]
        dot = np.zeros(len(a)) if t.dot is None else t.dot
        got = pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": t.n, "dot": dot})
        return got if (a != b).all() else got.filter(pa.array(a != b))

    return reduce


def best_of(k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int, min_common: int = 1):
    """Keep the ``k`` best partners of each id within the tile: ``entity, neighbor, sim, common``; equal scores to the smaller id."""

    def reduce(t: Tile) -> pa.Table:
        t = t.where((t.n >= min_common) & (t.a_ids[t.ia] != t.b_ids[t.ib]))
        sim = np.round(score(t.n, t.dot), digits) + 0.0
        whole = np.rint(sim * 10.0**digits)
        packs = len(sim) and np.abs(whole).max() < 1 << 31
        falling = (1 << 31) - whole.astype(np.int64) if packs else None
        kept = []
        for own, other, own_ids, other_ids in ((t.ia, t.ib, t.a_ids, t.b_ids), (t.ib, t.ia, t.b_ids, t.a_ids)):
            # the cells' order, by row and then column, breaks ties: partners rise among equal scores of an id
            order = np.argsort((own << 32) + falling, kind="stable") if packs else np.lexsort((other, -sim, own))
            length = np.bincount(own, minlength=1)
            rank = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
            at = order[rank < k]
            kept.append((own_ids[own[at]], other_ids[other[at]], sim[at], t.n[at]))
        return pa.table([np.concatenate(c) for c in zip(*kept, strict=True)], names=["entity", "neighbor", "sim", "common"])

    return reduce
