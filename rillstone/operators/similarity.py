"""Neighbourhood models: cosine, Pearson, Jaccard and Swing similarity, their predictions and increments.

Similarities are the cells of a blocked Gram matrix (``operators/gram.py``):
crowded keys are cut into parts, equal cells summed before the shuffle. Where
only the nearest are asked for, the k best of each entity leave a tile, and the
pairs are never written. Ids are integers; rows must not repeat a pair of
keys: callers keep the last beforehand (``drop_duplicates_last``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators import gram, mapped
from rillstone.operators.ordering import top_k
from rillstone.session import materialize, parallelism, sweep

#: Entries of rows whose products are looked at together.
ENTRIES = 1_000_000


def _integral(df: DataFrame, entity: str) -> T.DataType:
    """The type of an id column; anything but integers is refused."""
    kind = df.schema[entity].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{entity} is {kind.simpleString()}: encode ids as integers first")
    return kind


def pair_sums(df: DataFrame, entity: str, key: str, value: str) -> DataFrame:
    """``a, b, dot, common`` over the keys that two entities share, a < b."""
    kind = _integral(df, entity)
    rows = materialize(df.select(entity, key, value), "similarity-rows")
    cells = gram.gram(gram.keyed_records(rows, key, entity, value), gram.cells_of(), "a long, b long, n long, dot double", valued=True)
    return cells.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "dot", F.col("n").alias("common"))


def _prepared(df: DataFrame, entity: str, key: str, value: str, kind: str) -> DataFrame:
    """Rows with the value that the products (sums, for jaccard) are taken of."""
    if kind not in ("cosine", "pearson", "jaccard"):
        raise ValueError(f"unknown similarity {kind!r}")
    rows = df.select(entity, key, F.col(value).cast("double").alias("_v"))
    if kind == "pearson":
        means = rows.groupBy(entity).agg(F.avg("_v").alias("_m"))
        rows = rows.join(means, entity).select(entity, key, (F.col("_v") - F.col("_m")).alias("_v"))
    # what the sizes are needed for is done on the rows, so the many pairs are joined with nothing
    size = F.count(F.lit(1)).cast("double") if kind == "jaccard" else F.sqrt(F.sum(F.col("_v") * F.col("_v")))
    rows = rows.join(rows.groupBy(entity).agg(size.alias("_n")), entity)
    return rows.select(entity, key, (F.col("_n") if kind == "jaccard" else F.coalesce(F.try_divide("_v", "_n"), F.lit(0.0))).alias("_v"))


def _score(kind: str):
    """Similarity of a cell: the product of unit values, or from the summed sizes of both sets."""
    if kind == "jaccard":
        return lambda n, dot: n / (dot / n - n)
    return lambda n, dot: dot


def similarities(df: DataFrame, entity: str, key: str, value: str, kind: str = "cosine", min_common: int = 1) -> DataFrame:
    """``a, b, sim, common`` (a < b) of entities that share at least ``min_common`` keys.

    cosine divides by the norms over all keys; pearson centres each entity by
    its mean over all its keys and does the same; jaccard ignores values.
    Zero norms give 0. Null ids and keys match nothing.
    """
    type_ = _integral(df, entity)
    rows = materialize(df.select(entity, key, value), "similarity-rows")  # read for sizes, means and products
    work = gram.keyed_records(_prepared(rows, entity, key, value, kind), key, entity, "_v", counted=rows)
    cells = gram.gram(work, gram.cells_of(min_common), "a long, b long, n long, dot double", valued=True, add=kind == "jaccard")
    sim = F.col("n") / (F.col("dot") / F.col("n") - F.col("n")) if kind == "jaccard" else F.col("dot")
    return cells.select(F.col("a").cast(type_).alias("a"), F.col("b").cast(type_).alias("b"), sim.alias("sim"), F.col("n").alias("common"))


def top_neighbors(df: DataFrame, entity: str, key: str, value: str, kind: str = "cosine", k: int = 20, min_common: int = 1, digits: int = 9) -> DataFrame:
    """The ``k`` most similar of each entity without the pairs: ``entity, neighbor, sim, common, rank``.

    As ``neighbors`` of ``similarities``: equal (rounded) sims go to the smaller id.
    """
    type_ = _integral(df, entity)
    rows = materialize(df.select(entity, key, value), "similarity-rows")  # read for sizes, means and products
    work = gram.keyed_records(_prepared(rows, entity, key, value, kind), key, entity, "_v", counted=rows)
    lists = gram.gram(work, gram.best_of(k, _score(kind), digits, min_common), "entity long, neighbor long, sim double, common long", valued=True, add=kind == "jaccard")
    lists = lists.withColumns({c: F.col(c).cast(type_) for c in ("entity", "neighbor")})
    return top_k(lists, ["entity"], [F.desc("sim"), F.asc("neighbor")], k)


def both_ways(pairs: DataFrame) -> DataFrame:
    """The symmetric closure: ``entity, neighbor`` and the other columns."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ways = F.array(F.struct(F.col("a").alias("entity"), F.col("b").alias("neighbor")), F.struct(F.col("b").alias("entity"), F.col("a").alias("neighbor")))
    return pairs.select(F.explode(ways).alias("_w"), *rest).select("_w.*", *rest)  # one pass over the pairs


def neighbors(pairs: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The ``k`` most similar of each entity: ``entity, neighbor, sim, rank``; equal (rounded) sims to the smaller id."""
    rows = both_ways(pairs).withColumn("sim", F.round("sim", digits))
    return top_k(rows, ["entity"], [F.desc("sim"), F.asc("neighbor")], k)


def cf_predict(pairs: DataFrame, history: DataFrame, sims: DataFrame, group: str, other: str, target: str, task: str, k: int, default: float, bounds: tuple[float, float]) -> DataFrame:
    """Scores of (group, target) pairs from the k most similar entries of the group's history.

    ItemCF: group is the user, ``other`` and ``target`` items; for UserCF the
    roles are swapped. ``sims`` is symmetric (entity, neighbor, sim). Rating:
    mean label weighted by similarity, within ``bounds``; ranking: mean
    similarity. No neighbour with positive similarity gives ``default``.
    """
    hit = (
        pairs.select(group, target).distinct()
        .join(sims.where("sim > 0"), F.col(target) == F.col("entity"))
        .join(history.select(F.col(group), F.col(other).alias("neighbor"), F.col("label").alias("_label")), [group, "neighbor"])
    )
    best = top_k(hit, [group, target], [F.desc("sim"), F.asc("neighbor")], k)
    if task == "rating":
        raw = F.sum(F.col("sim") * F.col("_label")) / F.sum("sim")
        score = F.least(F.greatest(raw, F.lit(float(bounds[0]))), F.lit(float(bounds[1])))
    else:
        score = F.avg("sim")
    got = best.groupBy(group, target).agg(score.alias("pred"))
    return pairs.join(got, [group, target], "left").withColumn("pred", F.coalesce("pred", F.lit(default)))


def cf_predict_asked(pairs: DataFrame, history: DataFrame, group: str, target: str, kind: str, task: str, k: int, min_common: int, default: float, bounds: tuple[float, float]) -> DataFrame:
    """``cf_predict`` without the similar pairs: only those between a target and its group's entries are ever summed up.

    The history is written sorted by target and by group, and mapped by the
    tasks, which form a target's row of the Gram matrix and look the entries of
    the asking groups up in it. Ids are integers.
    """
    rows = _prepared(history.dropna(subset=[group, target]).select(target, group, F.col("label").alias("_l")), target, group, "_l", kind) if kind != "jaccard" else history.select(target, group, F.lit(0.0).alias("_v"))
    ends = history.agg(*[f(c).cast("long") for c in (target, group) for f in (F.min, F.max)], F.max(F.abs(F.col("label") - F.col("label").cast("float")))).first()
    if ends[0] is None or ends[2] is None:
        return pairs.withColumn("pred", F.lit(float(default)))
    id_ = [("int32" if -(1 << 31) <= lo and hi < 1 << 31 else "int64", 0) for lo, hi in (ends[:2], ends[2:4])]
    label = ("float32" if ends[4] == 0 else "float64", 0)
    value = {} if kind == "jaccard" else {"v": ("float64", 0)}
    named = rows.select(F.col(target).alias("e"), F.col(group).alias("g"), F.col("_v").alias("v")).dropna(subset=["e", "g"])
    labels = history.select(F.col(target).alias("e"), F.col(group).alias("g"), F.coalesce(F.col("label").cast("double"), F.lit(float("nan"))).alias("l")).dropna(subset=["e", "g"])
    by_e = mapped.write_flat(named, ["e", "g"], {"e": id_[0], "g": id_[1]} | value, "cf-targets")
    sweep(pairs.sparkSession)
    by_g = mapped.write_flat(labels.join(named, ["e", "g"]) if value else labels, ["g", "e"], {"g": id_[1], "e": id_[0], "l": label} | value, "cf-groups")
    sweep(pairs.sparkSession)
    low, span = ends[0], ends[1] - ends[0] + 1

    def spans(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids of a sorted column and where their rows begin and end."""
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return np.asarray(ids[first]), np.r_[first, len(ids)]

    def places(index: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each id."""
        at = np.minimum(np.searchsorted(index[0], ids), len(index[0]) - 1)
        return index[1][at], np.where(index[0][at] == ids, index[1][at + 1] - index[1][at], 0)

    def unfold(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.arange(len(n)), n)
        return own, np.arange(len(own)) + (first - np.cumsum(n) + n)[own]

    def cuts(n: np.ndarray) -> Iterator[slice]:
        total, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ENTRIES, side="right")))
            yield slice(at, to)
            at = to

    def scores(g: np.ndarray, t: np.ndarray, e: dict, h: dict, ei: tuple, hi: tuple) -> np.ndarray:
        own, targets = np.unique(t, return_inverse=True)
        ask, at = unfold(*places(hi, g))
        n, lab = h["e"][at].astype(np.int64), h["l"][at].astype(np.float64)
        wanted, cell = np.unique(targets[ask] * span + (n - low), return_inverse=True)
        common, dot = np.zeros(len(wanted)), np.zeros(len(wanted))
        if len(wanted):
            first, size = places(ei, own)
            row, at = unfold(first, size)
            where, many = places(hi, e["g"][at])
            for cut in cuts(many):
                entry, to = unfold(where[cut], many[cut])
                code = row[cut][entry] * span + (h["e"][to].astype(np.int64) - low)
                p = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                hit = np.flatnonzero(wanted[p] == code)
                common += np.bincount(p[hit], minlength=len(wanted))
                if value:
                    dot += np.bincount(p[hit], e["v"][at[cut]][entry[hit]] * h["v"][to[hit]], len(wanted))
            near = wanted % span + low
            if kind == "jaccard":
                dot = common / np.maximum(size[wanted // span] + places(ei, near)[1] - common, 1)
            dot[(common < min_common) | (near == own[wanted // span])] = 0
        ok = np.flatnonzero(dot[cell] > 0)
        ok = ok[np.lexsort((n[ok], -dot[cell[ok]], ask[ok]))]
        ok = ok[np.arange(len(ok)) - np.searchsorted(ask[ok], ask[ok]) < k]
        ask, sim, lab = ask[ok], dot[cell[ok]], lab[ok]
        total, given = np.bincount(ask, sim, len(g)), np.bincount(ask, ~np.isnan(lab) if task == "rating" else None, len(g))
        if task == "rating":
            raw = np.clip(np.bincount(ask, sim * np.nan_to_num(lab), len(g)) / np.where(total > 0, total, 1), *bounds)
        else:
            raw = total / np.maximum(given, 1)
        return np.where(given > 0, raw, default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, h = by_e.open(), by_g.open()
        ei, hi = spans(e["e"]), spans(h["g"])
        for b in batches:
            g, t = (b.column(b.schema.get_field_index(c)) for c in (group, target))
            ok = np.flatnonzero(g.is_valid().to_numpy(zero_copy_only=False) & t.is_valid().to_numpy(zero_copy_only=False))
            pred = np.full(b.num_rows, float(default))
            g, t = (c.take(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (g, t))
            for cut in cuts(places(hi, g)[1] if len(ok) else np.zeros(0, int)):
                pred[ok[cut]] = scores(g[cut], t[cut], e, h, ei, hi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred)], names=[*b.schema.names, "pred"])

    asked = pairs.repartition(parallelism(pairs.sparkSession), target).sortWithinPartitions(target, group)
    return asked.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("pred", T.DoubleType())]))


def item_cf_scores(users: DataFrame, history: DataFrame, neighbors_: DataFrame, user: str, item: str, use_label: bool = True) -> DataFrame:
    """Sum over a user's items of similarity times label, for every neighbour item: ``user, item, score``."""
    value = F.col("sim") * (F.col("label") if use_label else F.lit(1.0))
    rows = history.join(users.select(user).distinct(), user, "left_semi").join(neighbors_.where("sim > 0"), F.col(item) == F.col("entity"))
    return rows.groupBy(user, F.col("neighbor").alias("_item")).agg(F.sum(value).alias("score")).withColumnRenamed("_item", item)


def user_cf_scores(users: DataFrame, history: DataFrame, neighbors_: DataFrame, user: str, item: str, use_label: bool = True) -> DataFrame:
    """Sum over a user's neighbours of similarity times their label of an item."""
    value = F.col("sim") * (F.col("label") if use_label else F.lit(1.0))
    near = users.select(user).distinct().join(neighbors_.where("sim > 0"), F.col(user) == F.col("entity")).select(F.col(user).alias("_u"), "neighbor", "sim")
    rows = near.join(history.withColumnRenamed(user, "neighbor"), "neighbor")
    return rows.groupBy(F.col("_u").alias(user), item).agg(F.sum(value).alias("score"))


def cosine_increment(old_rows: DataFrame, new_rows: DataFrame, entity: str, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """What new (entity, key, value) rows add to cosine state: pair sums ``a, b, dot, common`` and squared norms ``entity, sq``.

    Pairs among new rows and of new with old rows of the same key, for keys and
    entities not combined before. Old rows of keys without new rows are not
    read further than the semi join.
    """
    norms = new_rows.groupBy(F.col(entity).alias("entity")).agg(F.sum(F.col(value).cast("double") * F.col(value)).alias("sq"))
    n = new_rows.select(F.col(key).alias("_k"), F.col(entity).alias("_e"), F.col(value).cast("double").alias("_x"))
    o = old_rows.select(F.col(key).alias("_k"), F.col(entity).alias("_f"), F.col(value).cast("double").alias("_y"))
    cross = n.join(o, "_k").where("_e <> _f").select(F.least("_e", "_f").alias("a"), F.greatest("_e", "_f").alias("b"), (F.col("_x") * F.col("_y")).alias("p"))
    added = cross.groupBy("a", "b").agg(F.sum("p").alias("dot"), F.count(F.lit(1)).alias("common"))
    return sum_pairs(pair_sums(new_rows, entity, key, value).unionByName(added)), norms


def sum_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("dot").alias("dot"), F.sum("common").alias("common"))


def update_cosine(old_pairs: DataFrame, old_norms: DataFrame, old_rows: DataFrame, new_rows: DataFrame, entity: str, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Cosine state of old and new rows from the old state and the increment.

    Similarities read from it see the changed norms of untouched pairs too.
    """
    pairs, norms = cosine_increment(old_rows, new_rows, entity, key, value)
    return sum_pairs(old_pairs.unionByName(pairs)), old_norms.unionByName(norms).groupBy("entity").agg(F.sum("sq").alias("sq"))


def cosine_from_state(pairs: DataFrame, norms: DataFrame) -> DataFrame:
    a, b = (norms.select(F.col("entity").alias(c), F.sqrt("sq").alias(f"_n{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.coalesce(F.try_divide("dot", F.col("_na") * F.col("_nb")), F.lit(0.0)).alias("sim"), "common")


def swing(df: DataFrame, user: str, item: str, alpha: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """Swing scores ``a, b, sim`` (a < b) of items: sum over pairs of users who have both.

    A pair of users adds w_u w_v / (alpha + k - 1) with k common items, the item
    itself being left out, and w = 1 / sqrt(number of items). Pairs with one
    common item join no two items and are dropped before items are unfolded;
    the common items stay with the pair as an array, so nothing is joined back.
    """
    rows = df.select(F.col(user).alias("_u"), F.col(item).alias("_i")).distinct()
    w = (weights or rows.groupBy("_u").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("_w"))).withColumnRenamed("_u", "_wu")
    left, right = rows.withColumnRenamed("_u", "u"), rows.withColumnRenamed("_u", "v")
    pairs = left.join(right, "_i").where("u < v").groupBy("u", "v").agg(F.sort_array(F.collect_list("_i")).alias("items")).where(F.size("items") > 1)
    pairs = pairs.join(w.select(F.col("_wu").alias("u"), F.col("_w").alias("wu")), "u").join(w.select(F.col("_wu").alias("v"), F.col("_w").alias("wv")), "v")
    value = F.col("wu") * F.col("wv") / (F.lit(float(alpha)) + F.size("items") - 1)
    cells = pairs.select(value.alias("s"), "items", F.posexplode("items").alias("p", "a"))
    cells = cells.select("s", "a", F.explode(F.slice("items", F.col("p") + 2, F.size("items"))).alias("b"))
    return cells.groupBy("a", "b").agg(F.sum("s").alias("sim"))


def update_swing(old: DataFrame, new_rows: DataFrame, user: str, item: str, alpha: float = 1.0) -> DataFrame:
    """Scores of a new batch added to earlier ones."""
    return old.select("a", "b", "sim").unionByName(swing(new_rows, user, item, alpha)).groupBy("a", "b").agg(F.sum("sim").alias("sim"))


def density(pairs: DataFrame, n: int) -> DataFrame:
    """Share of non-zero cells of the symmetric matrix, in percent."""
    return pairs.agg((F.lit(200.0) * F.count(F.lit(1)) / F.lit(float(n) * n)).alias("density"))


class CfModel:
    """User- or item-based collaborative filtering over stored neighbour lists.

    The lists are written once; the pairs behind them only if ``predict`` asks.
    """

    def __init__(self, df: DataFrame, user: str, item: str, by: str = "item", kind: str = "cosine", k: int = 20, min_common: int = 1, task: str = "ranking"):
        if by not in ("user", "item") or task not in ("rating", "ranking"):
            raise ValueError("by is user or item, task rating or ranking")
        self.user, self.item, self.by, self.k, self.task = user, item, by, k, task
        self.kind, self.min_common = kind, min_common
        self.history = df.select(user, item, F.col("label").cast("double").alias("label"))
        self._ids = (item, user) if by == "item" else (user, item)
        self._sims = self._near = None

    @property
    def sims(self) -> DataFrame:
        """All similar pairs ``a, b, sim, common``."""
        if self._sims is None:
            self._sims = materialize(similarities(self.history, *self._ids, "label", self.kind, self.min_common), "cf-sims")
        return self._sims

    @property
    def near(self) -> DataFrame:
        """The ``k`` nearest of each entity: ``entity, neighbor, sim, common, rank``."""
        if self._near is None:
            self._near = materialize(top_neighbors(self.history, *self._ids, "label", self.kind, self.k, self.min_common), "cf-near")
        return self._near

    def recommend(self, users: DataFrame, n: int, filter_consumed: bool = True) -> DataFrame:
        """``user, item, score, rank``: the best items, consumed ones left out; maybe fewer than ``n``."""
        make = item_cf_scores if self.by == "item" else user_cf_scores
        scores = make(users, self.history, self.near, self.user, self.item)
        if filter_consumed:
            scores = scores.join(self.history.select(self.user, self.item), [self.user, self.item], "left_anti")
        return top_k(scores.withColumn("score", F.round("score", 9)), [self.user], [F.desc("score"), F.asc(self.item)], n)

    def predict(self, pairs: DataFrame, default: float = 0.0, bounds: tuple[float, float] = (1, 5)) -> DataFrame:
        group, other = (self.user, self.item) if self.by == "item" else (self.item, self.user)
        whole = all(isinstance(d.schema[c].dataType, T.IntegralType) for d in (self.history, pairs) for c in (group, other))
        if self._sims is None and whole:  # nothing is gained by pairs that aren't there
            return cf_predict_asked(pairs, self.history, group, other, self.kind, self.task, self.k, self.min_common, default, bounds)
        return cf_predict(pairs, self.history, both_ways(self.sims), group, other, self.item if self.by == "item" else self.user, self.task, self.k, default, bounds)


def score_column(score: Column, task: str, bounds: tuple[float, float] = (1, 5)) -> Column:
    """Final prediction: clipped rating or sigmoid of a ranking score."""
    if task == "rating":
        return F.least(F.greatest(score, F.lit(float(bounds[0]))), F.lit(float(bounds[1])))
    return 1 / (1 + F.exp(-score))
