"""Graphs over interactions: two-hop edges, seeded walks, propagation of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.ordering import top_k
from rillstone.operators.sampling import mix, uniform
from rillstone.session import materialize


def two_hop_edges(df: DataFrame, user: str, item: str) -> DataFrame:
    """Items joined by at least one common user: ``src, dst, weight`` both ways, without loops."""
    e = df.select(user, item).dropna().distinct()
    pairs = e.withColumnRenamed(item, "src").join(e.withColumnRenamed(item, "dst"), user).where("src < dst")
    n = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return n.unionByName(n.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def adjacency(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Sorted neighbour list of each node: ``node, next, degree``."""
    return edges.groupBy(F.col(src).alias("node")).agg(F.sort_array(F.collect_list(dst)).alias("next")).withColumn("degree", F.size("next"))


def random_walks(starts: DataFrame, node: str, adj: DataFrame, n_walks: int, length: int, seed: int = 42) -> DataFrame:
    """``walk, step, node``: seeded walks that stop where there is no neighbour.

    One join with the adjacency per step; the step's choice is a hash of walk,
    step and seed.
    """
    now = starts.select(F.col(node).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("_w"))
    now = now.select((F.col("node").cast("long") * n_walks + F.col("_w")).alias("walk"), F.lit(0).alias("step"), "node")
    out = now
    for step in range(1, length):
        at = F.pmod(mix(F.col("walk"), step, seed), F.col("degree").cast("long")).cast("int")
        now = materialize(now.join(adj, "node").select("walk", F.lit(step).alias("step"), F.get("next", at).alias("node")), "walk")
        out = out.unionByName(now)
    return out


def bipartite_walk_pairs(starts: DataFrame, node: str, item_users: DataFrame, user_items: DataFrame, n_walks: int, length: int, focus_start: bool = False, seed: int = 42) -> DataFrame:
    """(``node``, ``positive``) pairs of item-user-item walks; a node without users pairs with itself."""
    now = starts.select(F.col(node).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("_w"))
    now = now.select((F.col("node").cast("long") * n_walks + F.col("_w")).alias("walk"), "node", F.col("node").alias("start"))
    iu = item_users.select(F.col("node").alias("node"), F.col("next").alias("users"))
    ui = user_items.select(F.col("node").alias("user"), F.col("next").alias("items"))
    pairs = None
    for step in range(length):
        pick = lambda arr, k: F.get(arr, F.pmod(mix(F.col("walk"), step * 2 + k, seed), F.size(arr).cast("long")).cast("int"))  # noqa: B023, E731
        hop = now.join(iu, "node", "left").withColumn("user", pick("users", 0)).join(ui, "user", "left").withColumn("to", F.coalesce(pick("items", 1), F.col("node")))
        hop = materialize(hop.select("walk", "start", "node", "to"), "bipartite-walk")
        part = hop.select((F.col("start") if focus_start else F.col("node")).alias("node"), F.col("to").alias("positive"))
        pairs = part if pairs is None else pairs.unionByName(part)
        now = hop.select("walk", F.col("to").alias("node"), "start")
    return pairs


def weighted_neighbors(pairs: DataFrame, num: int) -> DataFrame:
    """Most visited other nodes of each walk start, with visit shares over those kept: ``node, neighbor, weight``."""
    n = pairs.where("node <> positive").groupBy("node", F.col("positive").alias("neighbor")).agg(F.count(F.lit(1)).alias("visits"))
    kept = top_k(n, ["node"], [F.desc("visits"), F.asc("neighbor")], num)
    total = kept.groupBy("node").agg(F.sum("visits").alias("_t"))
    return kept.join(total, "node").select("node", "neighbor", (F.col("visits") / F.col("_t")).alias("weight"))


def sampled_neighbors(edges: DataFrame, num: int, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``num`` neighbours of each node."""
    return top_k(edges, ["src"], [mix(F.col("src"), F.col("dst"), seed).asc(), F.asc("dst")], num)


def _explode(vectors: DataFrame, id: str, vec: str) -> DataFrame:
    return vectors.select(F.col(id).alias("node"), F.posexplode(vec).alias("p", "x")).withColumn("x", F.col("x").cast("double"))


def _collect(cells: DataFrame, vec: str = "vec") -> DataFrame:
    sort = F.array_sort(F.collect_list(F.struct("p", "x")))
    return cells.groupBy("node").agg(F.transform(sort, lambda c: c["x"]).alias(vec))


def aggregate_neighbors(edges: DataFrame, vectors: DataFrame, id: str, vec: str, dim: int) -> DataFrame:
    """Weighted sum of the neighbours' vectors: ``node, vec``; ``edges`` has src, dst, w (into dst)."""
    joined = edges.join(vectors.select(F.col(id).alias("src"), F.col(vec).alias("_v")), "src")
    cols = [F.sum(F.col("w") * F.get("_v", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)]
    return joined.groupBy(F.col("dst").alias("node")).agg(*cols).select("node", F.array(*[f"_{i}" for i in range(dim)]).alias("vec"))


def normalized_edges(edges: DataFrame, kind: str = "symmetric") -> DataFrame:
    """Weights of D^-1/2 A D^-1/2 (symmetric) or of D^-1 (A + I) (row, with loops) for edges both ways."""
    e = edges.select("src", "dst").distinct()
    if kind == "row":
        e = e.unionByName(e.select("src", F.col("src").alias("dst")).distinct())
        deg = e.groupBy("dst").agg(F.count(F.lit(1)).alias("_d"))
        return e.join(deg, "dst").select("src", "dst", (1 / F.col("_d")).alias("w"))
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    other = deg.select(F.col("src").alias("dst"), F.col("_d").alias("_e"))
    return e.join(deg, "src").join(other, "dst").select("src", "dst", (1 / F.sqrt(F.col("_d") * F.col("_e"))).alias("w"))


def sampled_sums(edges: DataFrame, num: int, kind: str = "symmetric", seed: int = 42) -> DataFrame:
    """For edges both ways a sample of at most ``num`` neighbours of each node: ``node, near, w`` (arrays).

    Weights are those of ``normalized_edges`` times neighbours a sampled one,
    so that the weighted sum estimates the one over all, and is it for at most
    ``num`` neighbours. Loops are left out.
    """
    e = normalized_edges(edges, kind).where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    kept = sampled_neighbors(e, num, seed).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("_l"))
    share = F.col("_d") / F.size("_l")
    return kept.join(degree, "src").select(F.col("src").alias("node"), F.col("_l.dst").alias("near"), F.transform("_l.w", lambda x: x * share).alias("w"))


def lightgcn(edges: DataFrame, vectors: DataFrame, id: str, vec: str, dim: int, layers: int = 3) -> DataFrame:
    """Mean of the embeddings of layers 0 to ``layers``; a layer is one join and one aggregate."""
    w = normalized_edges(edges)
    zero = F.array(*[F.lit(0.0)] * dim)
    layer = vectors.select(F.col(id).alias("node"), F.col(vec).cast("array<double>").alias("vec"))
    total = layer
    for _ in range(layers):
        nxt = aggregate_neighbors(w, layer, "node", "vec", dim)
        layer = materialize(layer.select("node").join(nxt, "node", "left").select("node", F.coalesce("vec", zero).alias("vec")), "lightgcn")
        total = total.join(layer.withColumnRenamed("vec", "_n"), "node").select("node", F.zip_with("vec", "_n", lambda a, b: a + b).alias("vec"))
    return total.select("node", F.transform("vec", lambda x: x / (layers + 1)).alias("vec"))


def ngcf(edges: DataFrame, vectors: DataFrame, id: str, vec: str, dim: int, weights: list[tuple]) -> DataFrame:
    """Layers leaky_relu(side W1 + (side * ego) W2) at length 1, all layers one after another: ``node, vec``.

    ``weights`` has a pair of (dim, dim) matrices for each layer; side is the
    row-normalised sum over neighbours and the node itself.
    """
    import numpy as np
    import pyarrow as pa

    w = normalized_edges(edges, "row")
    layer = vectors.select(F.col(id).alias("node"), F.col(vec).cast("array<double>").alias("vec"))
    kind = layer.schema["node"].dataType.simpleString()
    total = layer
    for w1, w2 in weights:

        def step(batches, w1=np.asarray(w1), w2=np.asarray(w2)):
            for b in batches:
                ego, side = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in (1, 2))
                y = side @ w1 + (side * ego) @ w2
                y = np.where(y > 0, y, 0.2 * y)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["node", "vec"])

        side = aggregate_neighbors(w, layer, "node", "vec", dim).withColumnRenamed("vec", "side")
        layer = materialize(layer.join(side, "node").mapInArrow(step, f"node {kind}, vec array<double>"), "ngcf")
        total = total.join(layer.withColumnRenamed("vec", "_n"), "node").select("node", F.concat("vec", "_n").alias("vec"))
    return total


def importance_pairs(starts: DataFrame, node: str, item_users: DataFrame, user_items: DataFrame, n_walks: int, length: int, termination: float = 0.5, seed: int = 42) -> DataFrame:
    """Walk pairs from each start in which a walk ends after a step with the given probability."""
    pairs = bipartite_walk_pairs(starts, node, item_users, user_items, n_walks, length, focus_start=True, seed=seed)
    return pairs.where(uniform(F.col("node"), F.col("positive"), seed) >= termination) if termination > 0 and length > 1 else pairs


def prefix_offsets(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Exclusive prefix sums of a small table of sizes (one row per block)."""
    from pyspark.sql.window import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
