"""Embedding tables: nearest neighbours, recommendation by inner product, inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators import mapped
from rillstone.operators.ordering import top_k
from rillstone.session import materialize, parallelism

#: Vectors in a block of one side of a blocked product.
BLOCK = 8_192
#: Vectors in a block of items whose candidates are kept, and cells of a product at a time.
WIDE_BLOCK, PRODUCT = 65_536, 2_000_000
#: Cells of an inverted file, at most.
MAX_CELLS = 1_024
#: Rows of a mapped matrix looked at together; queries of a group that isn't halved further, and pairs.
CHUNK, LEAF, SMALL = 262_144, 64, 200_000
#: Longest rows of a mapped matrix that give a first bound of the best products.
LONGEST = 2_048


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def blocked_top_k(queries: DataFrame, items: DataFrame, q_id: str, i_id: str, vec: str, k: int, kind: str = "cosine", skip_self: bool = False) -> DataFrame:
    """The ``k`` best items of every query vector: ``q, i, score, rank``.

    Both sides are cut into blocks; a task multiplies two blocks and keeps k
    per query, so what moves is (blocks of the other side) copies of each
    vector and k rows per query and block. No side is broadcast or collected.
    Zero norms count as 1; equal scores (rounded to 9 digits) to the smaller id.
    """
    if kind not in ("cosine", "inner-product"):
        raise ValueError(f"unknown similarity {kind!r}")
    q = queries.select(F.col(q_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    i = items.select(F.col(i_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    nq, ni = (max(1, -(-d.count() // BLOCK)) for d in (q, i))
    turn = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = q.select(turn(nq).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("d"), F.lit(0).alias("side"), "id", "v")
    b = i.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("u"), turn(ni).alias("d"), F.lit(1).alias("side"), "id", "v")
    id_type = q.schema["id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ask, db = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        empty = pa.table({"q": ask.column("id").slice(0, 0), "i": db.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not ask.num_rows or not db.num_rows:
            return empty
        x, y = _matrix(ask.column("v")), _matrix(db.column("v"))
        x, y = (_unit(x), _unit(y)) if kind == "cosine" else (x, y)
        ids = db.column("id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        y, ids = y[by_id], ids[by_id]
        own = ask.column("id").to_numpy()
        qs, is_, ss = [], [], []
        for at in range(0, len(x), 512):
            s = np.round(x[at : at + 512] @ y.T, 9)
            if skip_self:
                s[own[at : at + 512, None] == ids[None, :]] = -np.inf
            n = min(k, s.shape[1])
            least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero(s >= least[:, None])  # ties included, cut by the final rank
            order = np.lexsort((col, -s[row, col], row))
            row, col = row[order], col[order]
            start = np.searchsorted(row, np.arange(len(s)))
            keep = np.arange(len(row)) - start[row] < n
            row, col = row[keep], col[keep]
            ok = np.isfinite(s[row, col])
            qs.append(own[at + row[ok]])
            is_.append(ids[col[ok]])
            ss.append(s[row[ok], col[ok]])
        return pa.table({"q": np.concatenate(qs), "i": np.concatenate(is_), "score": np.concatenate(ss)})

    found = a.unionByName(b).groupBy("u", "d").applyInArrow(run, f"q {id_type}, i {id_type}, score double")
    return top_k(found, ["q"], [F.desc("score"), F.asc("i")], k)


def pruned_top_k(queries: DataFrame, items: DataFrame, q_id: str, i_id: str, vec: str, k: int) -> DataFrame:
    """``blocked_top_k`` by inner product for short vectors without nulls, most pairs of which are ruled out unseen.

    Items are mapped from a file. A task halves its queries by direction; of a
    group only items are kept whose product with some unit vector of the
    group's cone may reach the group's least k-th best so far, a bound that
    leaves out no item of a result. Ids are integers.
    """
    q = queries.select(F.col(q_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    i = items.select(F.col(i_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    head = i.limit(1).collect()
    dim = len(head[0]["v"]) if head else 1
    held = mapped.write_flat(i, ["id"], {"id": ("int64", 0), "v": ("float64", dim)}, "knn-items")
    kinds = q.schema["id"].dataType.simpleString(), items.schema[i_id].dataType
    parts = max(4 * q.sparkSession.sparkContext.defaultParallelism, -(-q.count() // WIDE_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own or not held.rows:
            return
        t = pa.Table.from_batches(own)
        there = held.open()
        ids = there["id"]
        for row, at, score in best_products(_matrix(t.column("v")), there["v"], k):
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            q = t.column("id").take(pa.array(row)).combine_chunks()
            yield pa.RecordBatch.from_arrays([q.chunk(0) if isinstance(q, pa.ChunkedArray) else q, pa.array(ids[at]), pa.array(score), pa.array(rank)], names=["q", "i", "score", "rank"])

    found = q.repartition(parts, "id").mapInArrow(run, f"q {kinds[0]}, i long, score double, rank long")
    return found.withColumn("i", F.col("i").cast(kinds[1]))


def best_products(x: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of ``x`` the ``k`` largest products with rows of ``y``, rounded to 9 digits: rows, places in ``y`` and products.

    Of equal products the first places. Rows rise, and fall apart into no two parts.
    """
    k = min(k, len(y))
    norm, pieces = np.linalg.norm(x, axis=1), range(0, len(y), CHUNK)
    zero = np.flatnonzero(norm == 0)
    if len(zero):
        yield np.repeat(zero, k), np.tile(np.arange(k), len(zero)), np.zeros(k * len(zero))
    unit = x / np.where(norm == 0, 1, norm)[:, None]
    # what all of y have in common adds the same to every product of a row: lengths and angles are those of the rest
    mean = sum(y[at : at + CHUNK].sum(0) for at in pieces) / len(y)
    far = np.concatenate([np.linalg.norm(y[at : at + CHUNK] - mean, axis=1) for at in pieces])
    slack = 1.1e-9 + 1e-12 * norm * (far.max() + np.linalg.norm(mean))
    least = np.empty(len(x))  # the k-th best product so far, first of those with the longest
    longest = np.argpartition(far, len(far) - n)[len(far) - n :] if (n := max(LONGEST, 4 * k)) < len(far) else np.arange(len(far))
    for lo in range(0, len(x), step := max(1, PRODUCT // len(longest))):
        s = x[lo : lo + step] @ y[longest].T
        least[lo : lo + step] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]

    def need(rows: np.ndarray) -> float:
        """The length along its direction that an item needs to be among the best of one of the rows."""
        return float(((least[rows] - slack[rows] - x[rows] @ mean) / norm[rows]).min())

    def leaf(rows: np.ndarray, at: np.ndarray, v: np.ndarray):
        got = []
        for lo in range(0, len(at), step := max(1, PRODUCT // len(rows))):
            s = x[rows] @ v[lo : lo + step].T
            r, c = np.nonzero(s >= (least[rows] - slack[rows])[:, None])
            got.append((r, at[lo + c], np.round(s[r, c], 9)))
        r, c, s = (np.concatenate([g[j] for g in got]) for j in range(3))
        order = np.lexsort((c, -s, rows[r]))
        r, c, s = rows[r][order], c[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], c[keep], s[keep]

    some = np.flatnonzero(norm > 0)
    if not len(some):
        return
    at = np.flatnonzero(far >= need(some) - 1e-9 * far)
    todo = [(some, at, y[at])]  # groups not yet answered: their rows, the items that may be among their best and these items' vectors
    while todo:
        rows, at, v = todo.pop()
        center = unit[rows].mean(0)
        center = center / length if (length := np.linalg.norm(center)) > 1e-9 else unit[rows[0]]
        cos = float(np.clip((unit[rows] @ center).min() - 1e-12, -1, 1))
        along, size = v @ center - mean @ center, far[at]
        seeds = np.argpartition(along, len(along) - n)[len(along) - n :] if (n := 4 * k) < len(along) else np.arange(len(along))
        if len(seeds) >= k:
            for lo in range(0, len(rows), 4096):
                s = x[rows[lo : lo + 4096]] @ v[seeds].T
                least[rows[lo : lo + 4096]] = np.maximum(least[rows[lo : lo + 4096]], np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        # the largest product with a unit vector within the cone: the length inside it, else that with its nearest edge
        across = np.sqrt(np.maximum(size * size - along * along, 0))
        bound = np.where(along >= size * cos, size, along * cos + across * np.sqrt(1 - cos * cos))
        kept = np.flatnonzero(bound >= need(rows) - 1e-9 * size)
        at, v = at[kept], v[kept]
        if len(rows) <= LEAF or len(rows) * len(at) <= SMALL:
            yield leaf(rows, at, v)
            continue
        off = unit[rows] - center
        side = off @ np.linalg.eigh(off.T @ off)[1][:, -1]
        half = np.argsort(side, kind="stable")
        mid = len(rows) // 2
        todo += [(np.sort(rows[half[mid:]]), at, v), (np.sort(rows[half[:mid]]), at, v)]


def candidates(queries: DataFrame, items: DataFrame, q_id: str, i_id: str, vec: str, need: str) -> DataFrame:
    """For every query at least its ``need`` best items by inner product, and all that may tie with them: ``q, i``.

    For scores that are the product up to rounding: whoever scores the pairs
    exactly finds the same best among them as among all pairs. A vector with a
    null counts as worst, a product that is no number is always kept. Each pair
    of blocks is one task whatever its few bytes, so nothing merges them.
    """
    q = queries.select(F.col(q_id).alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col(need).cast("long").alias("n"))
    i = items.select(F.col(i_id).alias("id"), F.col(vec).cast("array<double>").alias("v"), F.lit(0).cast("long").alias("n"))
    ni = max(1, -(-i.count() // WIDE_BLOCK))
    nq = max(1, -(-q.count() // WIDE_BLOCK), -(-2 * parallelism(q.sparkSession) // ni))
    turn = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = q.select(F.explode(F.sequence(turn(nq) * ni, turn(nq) * ni + ni - 1)).alias("at"), F.lit(0).alias("side"), "id", "v", "n")
    b = i.select(F.explode(F.sequence(turn(ni), turn(ni) + (nq - 1) * ni, F.lit(ni))).alias("at"), F.lit(1).alias("side"), "id", "v", "n")
    kinds = q.schema["id"].dataType.simpleString(), i.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [t for t in batches if t.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        side = t.column("side").to_numpy()
        ask, db = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        if not ask.num_rows or not db.num_rows:
            return
        x, y = _with_nulls(ask.column("v")), _with_nulls(db.column("v"))
        void = np.isnan(y[1])
        least = np.minimum(1 << np.ceil(np.log2(np.maximum(ask.column("n").to_numpy(), 8))).astype(np.int64), len(void))  # few sizes, rather more than needed
        far = np.linalg.norm(y[0], axis=1)
        slack = 2e-9 + 1e-9 * np.linalg.norm(x[0], axis=1) * (np.max(far, where=np.isfinite(far), initial=0.0))
        for k in np.unique(least):
            own = np.flatnonzero(least == k)
            step = max(1, PRODUCT // len(void))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                with np.errstate(invalid="ignore", over="ignore"):
                    s = x[0][rows] @ y[0].T
                odd = np.isnan(s)
                s[odd] = -np.inf
                s[:, void] = -np.inf
                s[np.isnan(x[1][rows])] = -np.inf
                low = np.partition(s, len(void) - k, axis=1)[:, len(void) - k]
                r, c = np.nonzero((s >= np.where(np.isfinite(slack[rows]), low - slack[rows], -np.inf)[:, None]) | odd)
                yield pa.RecordBatch.from_arrays([ask.column("id").take(pa.array(rows[r])).combine_chunks(), db.column("id").take(pa.array(c)).combine_chunks()], names=["q", "i"])

    return a.unionByName(b).repartitionById(nq * ni, F.col("at")).select("side", "id", "v", "n").mapInArrow(run, f"q {kinds[0]}, i {kinds[1]}")


def _with_nulls(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and for each NaN if it is null or has a null (then zeros), else 0."""
    whole = col.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    dim = next((len(v) for v in whole if v.is_valid), 1)
    x, void = np.zeros((len(whole), dim)), np.full(len(whole), np.nan)
    there = whole.is_valid().to_numpy(zero_copy_only=False)
    flat = whole.drop_null().flatten()
    lacks = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(1)
    got = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    x[there] = np.where(lacks[:, None], 0.0, got)
    void[there] = np.where(lacks, np.nan, 0.0)
    return x, void


def search_knn(df: DataFrame, ids: list, id: str, vec: str, k: int, kind: str = "cosine") -> DataFrame:
    """Neighbours of a few ids, the id itself included; an unknown id is an error."""
    known = df.where(F.col(id).isin(ids))
    if known.count() < len(set(ids)):
        raise ValueError("unknown id")
    return blocked_top_k(known, df, id, id, vec, k, kind)


class IvfIndex:
    """Inverted file over an embedding table: k-means cells, probes, exact scores within cells.

    By default there are as many cells as the root of the number of rows
    (``MAX_CELLS`` at most), and as many are probed as measured recall asks for.
    """

    def __init__(self, df: DataFrame, id: str, vec: str, nlist: int | None = None, seed: int = 1, fit_rows: int = 100_000):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        n = rows.count()
        self.spark, self.nlist = df.sparkSession, nlist or max(2, min(MAX_CELLS, int(n**0.5)))
        least = min(1.0, 2 * fit_rows / max(n, 1))
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * least))
        sample = some.orderBy(F.xxhash64("id")).limit(fit_rows).select(array_to_vector("v").alias("features"))
        centers = np.array(KMeans(k=self.nlist, seed=seed, maxIter=10).fit(sample).clusterCenters())  # nlist x dim
        self.centers = self.spark.sparkContext.broadcast(centers)
        self.rows = materialize(rows.mapInArrow(_cells(self.centers, 1, "inner"), f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, cell int"), "ivf")

    def choose_probes(self, queries: DataFrame, id: str, vec: str, k: int, target: float = 0.95, ask_rows: int = 1_000) -> int:
        """Cells to probe so that ``target`` of the true neighbours of at most ``ask_rows`` queries, among all rows, lie in a probed cell."""
        q = queries.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        least = min(1.0, 2 * ask_rows / max(q.count(), 1))
        some = q.where(F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(1 << 40)) < int((1 << 40) * least))
        some = materialize(some.orderBy(F.xxhash64("id", F.lit("ask")), "id").limit(ask_rows), "ivf-ask")
        exact = blocked_top_k(some, self.rows, "id", "id", "v", k, "inner-product").select("q", F.col("i").alias("id"))
        kind = q.schema["id"].dataType.simpleString()
        cells = some.mapInArrow(_cells(self.centers, self.nlist, "inner", True), f"id {kind}, v array<double>, cell int, place int").select(F.col("id").alias("q"), "cell", "place")
        places = exact.join(self.rows.select("id", "cell"), "id").join(cells, ["q", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
        n = dict(places.collect())  # a row for each cell at most
        share = np.cumsum([n.get(p, 0) for p in range(self.nlist)]) / max(sum(n.values()), 1)
        return int(np.searchsorted(share, target - 1e-12) + 1) if n else self.nlist

    def search(self, queries: DataFrame, id: str, vec: str, k: int, probes: int | None = None) -> DataFrame:
        """``q, i, score, rank`` by inner product over the probed cells (by default those of ``choose_probes``)."""
        probes = probes or self.choose_probes(queries, id, vec, k)
        q = queries.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        kind = q.schema["id"].dataType.simpleString()
        asks = q.mapInArrow(_cells(self.centers, probes, "inner"), f"id {kind}, v array<double>, cell int")
        pairs = asks.withColumnsRenamed({"id": "q", "v": "qv"}).join(self.rows.withColumnsRenamed({"id": "i"}), "cell")
        from rillstone.functions.arrays import dot

        return top_k(pairs.select("q", "i", F.round(dot("qv", "v"), 9).alias("score")), ["q"], [F.desc("score"), F.asc("i")], k)


def _cells(centers, probes: int, kind: str, places: bool = False):
    """The nearest cells of each vector, on demand with their place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            far = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argsort(1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(x)), far.shape[1])
            take = pa.array(at)
            cols = {"id": b.column(0).take(take), "v": b.column(1).take(take), "cell": pa.array(far.ravel().astype(np.int32))}
            if places:
                cols["place"] = pa.array(np.tile(np.arange(far.shape[1], dtype=np.int32), len(x)))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def predict_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, vec: str = "v") -> DataFrame:
    """Inner product of given pairs, by two equi joins."""
    from rillstone.functions.arrays import dot

    u = users.select(F.col(user), F.col(vec).alias("_u"))
    i = items.select(F.col(item), F.col(vec).alias("_i"))
    return pairs.join(u, user).join(i, item).withColumn("score", dot("_u", "_i")).drop("_u", "_i")


def with_oov(df: DataFrame, id: str, vec: str, oov: int) -> DataFrame:
    """Append the mean vector as the row of unknown ids."""
    from rillstone.operators.stats import vector_means

    mean = vector_means(df.withColumn("_g", F.lit(0)), "_g", vec)
    kind = df.schema[id].dataType
    return df.select(id, F.col(vec).cast("array<double>").alias(vec)).unionByName(mean.select(F.lit(oov).cast(kind).alias(id), vec))


def user_vectors_from_items(history: DataFrame, items: DataFrame, user: str, item: str, vec: str) -> DataFrame:
    """A user's vector as the mean of the vectors of consumed items."""
    from rillstone.operators.stats import vector_means

    return vector_means(history.select(user, item).join(items.select(item, vec), item), user, vec)


