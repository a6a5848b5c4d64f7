"""Seeded samplers: every draw is a hash of its keys, so results survive any repartitioning.

The hash mixes integers only (``mix``) and is the same in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillstone.operators.ordering import top_k
from rillstone.operators.stats import negative_probabilities
from rillstone.session import fresh, parallelism

# Fixed values of the integer mixing; products stay below 2**63.
MOD, MUL_A, MUL_B, ADD = 2_147_483_647, 48_271, 16_807, 12_345


def mix(*parts: Column | int) -> Column:
    """A number in [0, MOD) from integer keys."""
    h = F.lit(ADD).cast("long")
    for p in parts:
        x = F.lit(p).cast("long") if isinstance(p, int) else p.cast("long")
        h = F.pmod((h * MUL_A + F.pmod(x, F.lit(MOD)) * MUL_B + ADD), F.lit(MOD))
        h = F.pmod(h * MUL_A + F.shiftright(h, 11), F.lit(MOD))
    return h


def uniform(*parts: Column | int) -> Column:
    return mix(*parts).cast("double") / F.lit(float(MOD))


def _candidates(df: DataFrame, row: str, num: int, tries: int) -> DataFrame:
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(num * tries - 1))))


def random_negatives(df: DataFrame, row: str, item: str, n_items: int, num: int, seed: int = 42, tries: int = 10) -> DataFrame:
    """``num`` inner item ids for each row, uniform over all items but the row's own; may be consumed ones.

    Drawn ``tries`` times as often as needed in one pass, the first distinct
    valid draws are kept.
    """
    draws = _candidates(df, row, num, tries).withColumn("negative", F.pmod(mix(F.col(row), F.col("_k"), seed), F.lit(n_items)))
    draws = draws.where(F.col("negative") != F.col(item)).groupBy(row, "negative").agg(F.min("_k").alias("_k"))
    kept = top_k(draws, [row], [F.asc("_k")], num, "_r").select(row, "negative")
    return df.join(kept, row)


def unconsumed_negatives(df: DataFrame, row: str, user: str, item: str, consumed: DataFrame, n_items: int, num: int, seed: int = 42, tries: int = 10) -> DataFrame:
    """As ``random_negatives``, but never an item the user consumed, unless valid draws run out.

    ``consumed`` has the columns user and item; pairs may repeat. Consumed draws
    rank behind all others, so they fill up only rows with too few. ``row`` is
    unique; ids are integers. Rows and pairs are dealt by user once, and a task
    draws for its rows by itself: no draw is shuffled.
    """
    out = [row, *[c for c in df.columns if c != row]]
    at, side, own_user, own_item = fresh(df.columns, "_at", "_side", "_u", "_i")
    keys = [F.col(user).cast("long").alias(own_user), F.col(item).cast("long").alias(own_item)]
    pairs = consumed.select(*keys, F.lit(0).alias(side)).dropna().where(F.col(own_item).between(0, n_items - 1))
    asks = df.where(F.col(row).isNotNull() & F.col(item).isNotNull()).select(*keys, F.lit(1).alias(side), F.col(row).cast("long").alias(at), *out)
    both = pairs.unionByName(asks, allowMissingColumns=True).repartition(parallelism(df.sparkSession), own_user).sortWithinPartitions(side)
    schema = T.StructType([*[df.schema[c] for c in out], T.StructField("negative", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, users, codes = [], None, None
        for b in batches:
            first = b.column(2).to_numpy() == 0
            if first.any():
                held.append((b.column(0).filter(pa.array(first)).to_numpy(), b.column(1).filter(pa.array(first)).to_numpy()))
                b = b.filter(pa.array(~first))
            if not b.num_rows:
                continue
            if codes is None:
                u, i = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
                users, place = np.unique(u, return_inverse=True)
                codes, held = np.unique(place * n_items + i), []
            yield from _drawn(b, users, codes, n_items, num, num * tries, seed)

    return both.mapInArrow(run, schema)


def _drawn(b: pa.RecordBatch, users: np.ndarray, codes: np.ndarray, n_items: int, num: int, draws: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The first ``num`` distinct draws of each row other than its item, those of its user's pairs (``codes``) last."""
    asked, item, at = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
    mine = np.searchsorted(users, asked)
    known = b.column(0).is_valid().to_numpy(zero_copy_only=False) & (mine < len(users))
    known[known] = users[mine[known]] == asked[known]
    got, free = np.full((len(at), draws), -1, np.int64), np.zeros(len(at), np.int64)
    seen = np.zeros((len(at), draws), bool)
    rows = np.arange(len(at))
    for k in range(draws):  # rows that have all they need draw no more
        x = _mix_numbers(at[rows], k, seed) % n_items
        ok = (x != item[rows]) & ~(got[rows, :k] == x[:, None]).any(1)
        r, x = rows[ok], x[ok]
        got[r, k] = x
        c = mine[r] * n_items + x
        p = np.searchsorted(codes, c)
        hit = known[r] & (p < len(codes))
        hit[hit] = codes[p[hit]] == c[hit]
        seen[r, k] = hit
        free[r] += ~hit
        rows = rows[free[rows] < num]
        if not len(rows):
            break
    r, k = np.nonzero(got >= 0)
    order = np.lexsort((k, seen[r, k], r))
    r, k = r[order], k[order]
    start = np.searchsorted(r, np.arange(len(at)))
    keep = np.arange(len(r)) - start[r] < num
    r, k = r[keep], k[keep]
    take = pa.array(r)
    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[4:]], pa.array(got[r, k])], names=[*b.schema.names[4:], "negative"])


def _mix_numbers(*parts: np.ndarray | int) -> np.ndarray:
    """``mix`` of numbers."""
    h = np.int64(ADD)
    for p in parts:
        h = (h * MUL_A + np.mod(p, MOD) * MUL_B + ADD) % MOD
        h = (h * MUL_A + (h >> 11)) % MOD
    return h


def popular_negatives(df: DataFrame, row: str, item: str, log: DataFrame, user: str, num: int, seed: int = 42, temperature: float = 0.75, buckets: int = 1024) -> DataFrame:
    """``num`` negatives drawn by popularity to a power; two draws for each, those of the row's own item rank behind all others.

    The cumulative distribution is cut into equal buckets, so a draw joins by
    bucket and then by range rather than with all items.
    """
    probs = negative_probabilities(log, user, item, temperature).withColumnRenamed(item, "negative")
    from rillstone.operators.ordering import global_rank

    ranked = global_rank(probs, ["negative"], "_i")
    # cumulative probability: within blocks of ranks, then over the (few) blocks
    block = F.call_function("div", F.col("_i"), F.lit(4096))
    inner = F.sum("prob").over(Window.partitionBy("_b").orderBy("_i"))
    ranked = ranked.withColumn("_b", block).withColumn("_in", inner)
    heads = ranked.groupBy("_b").agg(F.max("_in").alias("_t"))
    heads = heads.withColumn("_off", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_b", "_off")
    cdf = ranked.join(heads, "_b").select("negative", (F.col("_in") + F.col("_off")).alias("_hi"), (F.col("_in") + F.col("_off") - F.col("prob")).alias("_lo"))
    last = F.lit(buckets - 1)
    cdf = cdf.withColumn("_bucket", F.explode(F.sequence(F.least(F.floor(F.col("_lo") * buckets).cast("int"), last), F.least(F.floor(F.col("_hi") * buckets).cast("int"), last))))
    draws = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2 * num - 1)))).withColumn("_u", uniform(F.col(row), F.col("_k"), seed))
    draws = draws.withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    hit = draws.join(cdf, "_bucket").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    kept = top_k(hit, [row], [(F.col("negative") == F.col(item)).asc(), F.asc("_k")], num, "_r").select(row, "negative")
    return df.join(kept, row)


def out_batch_negatives(df: DataFrame, row: str, batch: str, item: str, n_items: int, seed: int = 42, tries: int = 16) -> DataFrame:
    """One negative per row that is no positive of the row's batch; any other item if none is drawn."""
    draws = _candidates(df, row, 1, tries).withColumn("negative", F.pmod(mix(F.col(row), F.col("_k"), seed), F.lit(n_items)))
    used = df.select(batch, F.col(item).alias("negative"), F.lit(1).alias("_used")).distinct()
    draws = draws.where(F.col("negative") != F.col(item)).join(used, [batch, "negative"], "left")
    return df.join(top_k(draws, [row], [F.coalesce("_used", F.lit(0)), F.asc("_k")], 1, "_r").select(row, "negative"), row)


def eval_negatives(df: DataFrame, row: str, user: str, item: str, consumed: DataFrame, n_items: int, num: int, seed: int = 42) -> DataFrame:
    """Each row as one positive (label 1, whatever its label was) followed by ``num`` unconsumed negatives (label 0)."""
    pos = df.select(row, user, item, F.lit(1).alias("label"))
    neg = unconsumed_negatives(df.select(row, user, item), row, user, item, consumed, n_items, num, seed)
    return pos.unionByName(neg.select(row, user, F.col("negative").alias(item), F.lit(0).alias("label")))


def pairwise(df: DataFrame, negatives: DataFrame, row: str, user: str, item: str) -> DataFrame:
    """(user, positive, negative) triples."""
    return df.select(row, user, F.col(item).alias("positive")).join(negatives.select(row, "negative"), row)


def sample_users(df: DataFrame, user: str, num: int, seed: int = 42) -> DataFrame:
    """``num`` distinct users without replacement."""
    return df.select(user).dropna().distinct().orderBy(F.xxhash64(F.lit(seed), user), user).limit(num)


def weighted_sample(df: DataFrame, group: list[str], weight: Column, num: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Weighted sampling without replacement in each group (Efraimidis-Spirakis keys)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *(keys or df.columns)), F.lit(MOD)).cast("double") + 1) / (MOD + 1)
    return top_k(df.withColumn("_key", F.log(u) / weight), group, [F.desc("_key")], num, "_r").drop("_key", "_r")


def mask_features(df: DataFrame, cols: list[str], row: str, oov: dict[str, object], pattern: str = "rfm", seed: int = 42) -> DataFrame:
    """Two masked views of a row's features for self-supervision: ``view`` 0 and 1.

    rfm: each view drops its own random half; rfm-complementary: the views drop
    complementary halves; cfm: a random half of neighbouring columns.
    """
    if pattern not in ("rfm", "rfm-complementary", "cfm"):
        raise ValueError(f"unknown pattern {pattern!r}")
    out = df.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    for j, c in enumerate(cols):
        if pattern == "rfm":
            drop = F.pmod(mix(F.col(row), F.col("view"), j, seed), F.lit(2)) == 0
        elif pattern == "rfm-complementary":
            drop = F.pmod(mix(F.col(row), j, seed), F.lit(2)) == F.col("view")
        else:
            start = F.pmod(mix(F.col(row), F.col("view"), seed), F.lit(len(cols)))
            drop = F.pmod(F.lit(j) - start, F.lit(len(cols))) < F.lit((len(cols) + 1) // 2)
        out = out.withColumn(c, F.when(drop, F.lit(oov[c])).otherwise(F.col(c)))
    return out
