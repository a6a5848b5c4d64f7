"""Models at work: predictions, recommendations, evaluation and storage behind one contract.

Every model answers ``predict(pairs)`` with a column ``pred`` and
``recommend_user(users, n)`` with ``user, item, score, rank``. ``EmbedModel``
scores by the inner product of stored vectors, ``FeatureModel`` by any Column
expression over assembled user and item features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators import features, knn, metrics, ranking, sampling
from rillstone.operators.ordering import global_rank, top_k
from rillstone.operators.similarity import CfModel, score_column
from rillstone.session import materialize
from rillstone.sources.tables import load_frames, save_frames

#: Items in one block that asking users are paired with, and items of a default list.
ITEM_BLOCK, DEFAULT_ITEMS = 4_096, 2_000
COLD_STARTS = ("popular", "average")


def ranked_defaults(popular: DataFrame, item: str, order: list[Column]) -> DataFrame:
    """A default list ``item, rank`` from popular items (bounded by the caller)."""
    return global_rank(popular, order, "_r").select(item, (F.col("_r") + 1).cast("long").alias("rank"))


def _check(cold: str, allowed: tuple[str, ...] = COLD_STARTS) -> None:
    if cold not in allowed:
        raise ValueError(f"unknown cold start {cold!r}")


def _with_cold(recs: DataFrame, users: DataFrame, known: DataFrame, user: str, item: str, defaults: DataFrame, n: int) -> DataFrame:
    """Add the head of the default list for users that are not known; its scores are null."""
    unknown = users.select(user).dropna().distinct().join(known.select(user).distinct(), user, "left_anti")
    cold = ranking.cold_start(unknown, user, item, defaults, n).select(user, item, F.lit(None).cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))
    return recs.select(user, item, "score", F.col("rank").cast("long").alias("rank")).unionByName(cold)


class EmbedModel:
    """User and item vectors, with the history that is not recommended again.

    ``users`` and ``items`` have an id (``user``, ``item``) and a vector ``v``;
    ``history`` has both ids; ``defaults`` has ``item, rank`` for cold starts.
    """

    def __init__(self, users: DataFrame, items: DataFrame, history: DataFrame, defaults: DataFrame, user: str = "user", item: str = "item", task: str = "ranking"):
        if task not in ("rating", "ranking"):
            raise ValueError("task is rating or ranking")
        self.users, self.items, self.defaults = users.select(user, "v"), items.select(item, "v"), defaults.select(item, "rank")
        self.history, self.user, self.item, self.task = history.select(user, item).distinct(), user, item, task

    def predict(self, pairs: DataFrame, cold_start: str = "average", default: float = 0.0, bounds: tuple[float, float] = (1, 5)) -> DataFrame:
        """Add ``pred``: clipped rating or sigmoid; unknown ids count as the mean vector (``average``) or give ``default`` (``popular``)."""
        _check(cold_start)
        sides = []
        for name, vectors in (("_u", self.users), ("_i", self.items)):
            key = vectors.columns[0]
            v = F.col("v").cast("array<double>")
            joined = (sides[-1] if sides else pairs).join(vectors.select(key, v.alias(name)), key, "left")
            if cold_start == "average":
                joined = joined.crossJoin(F.broadcast(_mean_vector(vectors))).withColumn(name, F.coalesce(name, "_mean")).drop("_mean")  # one row
            sides.append(joined)
        from rillstone.functions.arrays import dot

        score = score_column(dot("_u", "_i"), self.task, bounds)
        return sides[-1].withColumn("pred", F.coalesce(score, F.lit(float(default)))).drop("_u", "_i")

    def recommend_user(self, users: DataFrame, n: int, cold_start: str = "popular", filter_consumed: bool = True) -> DataFrame:
        """The ``n`` best items of each asked user, consumed ones left out; ``cold_start`` serves unknown users.

        Users are asked in classes by the length of their history, each with
        as many candidates as its longest needs, so one long history doesn't
        make every user carry as much.
        """
        _check(cold_start)
        asked = users.select(self.user).dropna().distinct().join(self.users, self.user)
        n_items = self.items.count()
        if n > n_items:
            raise ValueError(f"n_rec {n} exceeds the number of items {n_items}")
        sizes = self.history.groupBy(self.user).agg(F.count(F.lit(1)).alias("_c"))
        asked = asked.join(sizes, self.user, "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
        most = int((asked.agg(F.max("_c")).first()[0] or 0)) if filter_consumed else 0
        scores, low, high = None, -1, 64
        while low < most or scores is None:
            part = asked.where((F.col("_c") > low) & (F.col("_c") <= high)) if filter_consumed else asked
            k = min(n_items, n + (min(high, most) if filter_consumed else 0))
            got = knn.blocked_top_k(part, self.items.withColumnRenamed(self.item, "_id"), self.user, "_id", "v", k, "inner-product")
            got = got.select(F.col("q").alias(self.user), F.col("i").alias(self.item), "score")
            scores = got if scores is None else scores.unionByName(got)
            low, high = high, high * 8
        recs = ranking.recommend_top_n(scores, self.user, self.item, self.history, n, n_items, filter_consumed)
        head = self.defaults if cold_start == "popular" else self.default_recs(max(n, 1))
        return _with_cold(recs, users, self.users, self.user, self.item, head, n)

    def default_recs(self, n: int = DEFAULT_ITEMS) -> DataFrame:
        """The best items of the mean user: ``item, rank``; at most ``DEFAULT_ITEMS``."""
        mean = _mean_vector(self.users).select(F.lit(0).cast(self.items.schema[self.item].dataType).alias("_q"), F.col("_mean").alias("v"))
        top = knn.blocked_top_k(mean, self.items.withColumnRenamed(self.item, "_id"), "_q", "_id", "v", min(n, DEFAULT_ITEMS), "inner-product")
        return top.select(F.col("i").alias(self.item), F.col("rank").cast("long").alias("rank"))

    def similar(self, side: str, ids: DataFrame, k: int, kind: str = "cosine") -> DataFrame:
        """The ``k`` users (or items) nearest to each of ``ids``, itself left out: ``q, i, score, rank``."""
        if side not in ("user", "item"):
            raise ValueError("side is user or item")
        vectors = self.users if side == "user" else self.items
        key = vectors.columns[0]
        return knn.blocked_top_k(ids.select(key).distinct().join(vectors, key), vectors, key, key, "v", k, kind, skip_self=True)

    def export_vectors(self) -> DataFrame:
        """``side, id, vector`` as JSON for a key-value store."""
        rows = [f.select(F.lit(s).alias("side"), F.col(f.columns[0]).cast("string").alias("id"), F.to_json("v").alias("vector")) for s, f in (("user", self.users), ("item", self.items))]
        return rows[0].unionByName(rows[1])

    def save(self, path: str) -> None:
        frames = {"users": self.users, "items": self.items, "history": self.history, "defaults": self.defaults}
        save_frames(self.users.sparkSession, path, frames, {"kind": "embed", "user": self.user, "item": self.item, "task": self.task})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EmbedModel:
        """What ``save`` wrote; ``OSError`` if it is not there."""
        f, meta = load_frames(spark, path)
        return cls(f["users"], f["items"], f["history"], f["defaults"], meta["user"], meta["item"], meta["task"])


def _mean_vector(vectors: DataFrame) -> DataFrame:
    """One row ``_mean``: the mean of the vectors."""
    from rillstone.operators.stats import vector_means

    return vector_means(vectors.withColumn("_g", F.lit(0)), "_g", "v").select(F.col("v").cast("array<double>").alias("_mean"))


class FeatureModel:
    """Scores of user and item features: the same assembly for pairs, batches and whole catalogues.

    ``users`` and ``items`` are dimension tables, one row an id; ``user_oov``
    and ``item_oov`` are the features of unknown ids. ``score`` is a Column over
    the features, so scoring stays in the JVM. ``vectors`` may give two array
    Columns, over the features of a user and of an item, whose inner product is
    the score up to rounding: then only the pairs that may be among a user's
    best are scored (``fm_vectors`` gives those of ``fm_score``).
    """

    def __init__(self, users: DataFrame, items: DataFrame, score: Column, history: DataFrame, user_oov: dict, item_oov: dict, user: str = "user", item: str = "item", task: str = "ranking", vectors: tuple[Column, Column] | None = None):
        clash = (set(users.columns) & set(items.columns)) | ({user, item} & (set(user_oov) | set(item_oov)))
        if clash:
            raise ValueError(f"features on both sides: {sorted(clash)}")
        self.users, self.items, self.score, self.user_oov, self.item_oov = users, items, score, user_oov, item_oov
        self.history, self.user, self.item, self.task, self.vectors = history.select(user, item).distinct(), user, item, task, vectors

    def _of(self, rows: DataFrame, dim: DataFrame, key: str, oov: dict) -> DataFrame:
        """The features of each row's id, those of an unknown one where it has no row."""
        known = rows.join(dim.withColumn("_known", F.lit(True)), key, "left")
        for c, v in oov.items():
            known = known.withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise(F.lit(v).cast(dim.schema[c].dataType)))
        return known.drop("_known")

    def _patched(self, rows: DataFrame, feats: str | None, dim: DataFrame, oov: dict) -> DataFrame:
        """Values of a map column over the row's own features; unknown names are ignored."""
        if feats is None:
            return rows
        return features.override(rows, feats, {c: dim.schema[c].dataType.simpleString() for c in oov})

    def assemble(self, pairs: DataFrame, feats: str | None = None) -> DataFrame:
        """All features of given pairs; ``feats`` names a map column of user features that go first."""
        rows = self._patched(self._of(pairs, self.users, self.user, self.user_oov), feats, self.users, self.user_oov)
        return self._of(rows, self.items, self.item, self.item_oov)

    def predict(self, pairs: DataFrame, feats: str | None = None, bounds: tuple[float, float] = (1, 5)) -> DataFrame:
        """The pairs with ``pred``: clipped rating or sigmoid of the score; unknown ids by their own features."""
        keep = [c for c in pairs.columns if c != feats]
        return self.assemble(pairs, feats).select(*keep, score_column(self.score, self.task, bounds).alias("pred"))

    def _asked(self, users: DataFrame, feats: str | None) -> DataFrame:
        """The asked users, once each, with their features."""
        cols = [self.user, *([feats] if feats else [])]
        return self._patched(self._of(users.select(*cols).dropna(subset=[self.user]).dropDuplicates([self.user]), self.users, self.user, self.user_oov), feats, self.users, self.user_oov)

    def _score_best(self, users: DataFrame, n: int, n_items: int, feats: str | None, filter_consumed: bool) -> DataFrame:
        """As ``score_all``, but of each user only the pairs that can be among the best ``n`` that the consumed filter leaves."""
        asked = materialize(self._asked(users, feats), "asked")
        need = F.lit(n)
        if filter_consumed:
            sizes = self.history.groupBy(self.user).agg(F.count(F.lit(1)).alias("_c"))
            asked, need = asked.join(sizes, self.user, "left"), F.when(F.coalesce("_c", F.lit(0)) + n <= n_items, F.coalesce("_c", F.lit(0)) + n).otherwise(F.lit(n))
        of, by = self.vectors
        found = knn.candidates(asked.select(self.user, of.alias("_v"), need.alias("_n")), self.items.select(self.item, by.alias("_v")), self.user, self.item, "_v", "_n")
        pairs = found.select(F.col("q").alias(self.user), F.col("i").alias(self.item))
        return pairs.join(asked, self.user).join(self.items, self.item).select(self.user, self.item, self.score.cast("double").alias("score"))

    def score_all(self, users: DataFrame, feats: str | None = None) -> DataFrame:
        """Every asked user with every item: ``user, item, score``.

        The asked users are a stated set; they meet the items block by block
        through an equi join on the block, so no side is broadcast or collected.
        """
        asked = self._asked(users, feats)
        blocks = max(1, -(-self.items.count() // ITEM_BLOCK))
        asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        items = self.items.withColumn("_block", F.pmod(F.xxhash64(self.item), F.lit(blocks)).cast("int"))
        return asked.join(items, "_block").select(self.user, self.item, self.score.cast("double").alias("score"))

    def recommend_user(self, users: DataFrame, n: int, feats: str | None = None, filter_consumed: bool = True, random_rec: bool = False, seed: int = 42) -> DataFrame:
        """The ``n`` best items of each asked user, unknown ones by the features of unknown users.

        ``random_rec`` draws the items instead, in proportion to softmax(score)^0.75.
        """
        n_items = self.items.count()
        few = self.vectors and not random_rec
        scores = self._score_best(users, n, n_items, feats, filter_consumed) if few else self.score_all(users, feats)
        if not random_rec:
            return ranking.recommend_top_n(scores.withColumn("score", F.round("score", 9)), self.user, self.item, self.history, n, n_items, filter_consumed)
        if filter_consumed:
            scores = scores.join(self.history, [self.user, self.item], "left_anti")
        drawn = sampling.weighted_sample(scores, [self.user], F.exp(F.col("score") * 0.75), n, seed, [self.user, self.item])
        return top_k(drawn, [self.user], [F.desc("score"), F.asc(self.item)], n)


def save_cf(model: CfModel, path: str) -> None:
    """History, neighbour lists and settings of a neighbourhood model."""
    meta = {"kind": model.kind, "user": model.user, "item": model.item, "by": model.by, "k": model.k, "min_common": model.min_common, "task": model.task}
    save_frames(model.history.sparkSession, path, {"history": model.history, "near": model.near, "sims": model.sims}, meta)


def load_cf(spark: SparkSession, path: str) -> CfModel:
    """What ``save_cf`` wrote; ``OSError`` if it is not there. Nothing is computed again."""
    f, m = load_frames(spark, path)
    model = CfModel(f["history"], m["user"], m["item"], m["by"], m["kind"], m["k"], m["min_common"], m["task"])
    model._near, model._sims = f["near"], f["sims"]
    return model


def positives(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a label other than 0; all of them if every label is 0."""
    any_ = df.agg(F.coalesce(F.max((F.col(label) != 0).cast("int")), F.lit(0)).alias("_any"))  # one row
    return df.crossJoin(F.broadcast(any_)).where((F.col(label) != 0) | (F.col("_any") == 0)).drop("_any")


def evaluate(
    data: DataFrame, task: str, wanted: list[str], predict: Callable[[DataFrame], DataFrame] | None = None, recommend: Callable[[DataFrame, int], DataFrame] | None = None,
    user: str = "user", item: str = "item", label: str = "label", k: int = 10, sample_user_num: int | None = None, seed: int = 42, n_items: int | None = None,
) -> DataFrame:
    """One row with the wanted metrics of a model on ``data`` (user, item, label).

    Pointwise metrics read ``predict(data)``; listwise ones ``recommend(users,
    k)`` against the positives, over all users of the data or ``sample_user_num``
    of them, a user without recommendation counting as one without a hit.
    """
    metrics.check_metrics(task, wanted, k)
    out: list[DataFrame] = []
    point = [m for m in wanted if m not in metrics.LISTWISE]
    if point:
        p = predict(data).withColumnRenamed(label, "label")
        if task == "rating":
            out.append(metrics.rating_metrics(p).withColumn("loss", F.col("rmse")))
        else:
            make = {"loss": lambda d: metrics.log_loss(d).withColumnRenamed("log_loss", "loss"), "balanced_accuracy": metrics.balanced_accuracy, "roc_auc": metrics.roc_auc, "pr_auc": metrics.pr_auc}
            make["roc_gauc"] = lambda d: metrics.gauc(d, user)
            for m in point:
                got = make[m](p)
                out.append(got.select(F.col(got.columns[0]).alias(m)))
    lists = [m for m in wanted if m in metrics.LISTWISE]
    if lists:
        truth = positives(data.withColumnRenamed(label, "label")).select(user, item).distinct()
        asked = sampling.sample_users(truth, user, sample_user_num, seed) if sample_user_num else truth.select(user).distinct()
        recs = recommend(asked, k)
        per = asked.join(metrics.user_list_metrics(recs, truth, user, item, k), user, "left").fillna(0.0)
        out.append(per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "map", "ndcg")]))
        if "coverage" in lists:
            out.append(metrics.coverage(recs, item, n_items or truth.select(item).distinct().count()))
    row = out[0]
    for more in out[1:]:
        row = row.crossJoin(F.broadcast(more))  # one row each
    return row.select(*[F.col(m).cast("double").alias(m) for m in wanted])


def recent_dual_seqs(lists: DataFrame, items: str, long: int, short: int, pad_value: object) -> DataFrame:
    """Each user's latest ``short`` items and the ``long`` before them, padded, with lengths (1 for an empty long part)."""
    from rillstone.operators.history import last_n, pad

    rows = lists.withColumn("_s", last_n(F.col(items), short)).withColumn("_l", last_n(F.slice(items, F.lit(1), F.greatest(F.size(items) - F.lit(short), F.lit(0))), long))
    for name, src, n in (("short", "_s", short), ("long", "_l", long)):
        rows = rows.withColumn(f"{name}_seq", pad(F.col(src), n, pad_value)).withColumn(f"{name}_len", F.greatest(F.size(src), F.lit(1)))
    return rows.drop("_s", "_l")


def random_seqs(lists: DataFrame, user: str, items: str, length: int, pad_value: object, seed: int = 42) -> DataFrame:
    """``length`` items of each whole history, drawn without replacement by seeded hashes, in order of consumption."""
    from rillstone.operators.history import pad

    at = F.sequence(F.lit(0), F.size(items) - 1)
    keyed = F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(seed), F.col(user), i).alias("h"), i.alias("i")))
    drawn = F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, length), lambda x: x["i"]))
    seq = F.when(F.size(items) > 0, F.transform(drawn, lambda i: F.get(items, i))).otherwise(F.slice(items, 1, length))
    return lists.withColumn("_q", seq).withColumn("seq", pad(F.col("_q"), length, pad_value)).withColumn("seq_len", F.greatest(F.size("_q"), F.lit(1))).drop("_q")


def serve_embed(requests: DataFrame, model: EmbedModel, n_rec: str) -> DataFrame:
    """Requests (user, n_rec) answered over stored vectors; an unknown user gets no rows: ``user, item, score, rank``."""
    ask = requests.groupBy(model.user).agg(F.max(n_rec).alias("_n")).where(F.col("_n") >= 1)
    most = int(ask.agg(F.max("_n")).first()[0] or 1)
    known = ask.join(model.users.select(model.user), model.user, "left_semi")
    recs = model.recommend_user(known, min(most, model.items.count()))
    return recs.join(ask, model.user).where(F.col("rank") <= F.col("_n")).select(model.user, model.item, "score", "rank")


def fm_score(linear: dict[str, float], factors: dict[str, list[float]], bias: float = 0.0) -> Column:
    """Factorisation machine over numeric features with fixed weights, as one Column."""
    d = len(next(iter(factors.values()), []))
    out = F.lit(float(bias))
    for c, w in linear.items():
        out = out + F.lit(float(w)) * F.col(c).cast("double")
    for j in range(d):
        terms = [F.lit(float(v[j])) * F.col(c).cast("double") for c, v in factors.items()]
        total, squares = terms[0], terms[0] * terms[0]
        for t in terms[1:]:
            total, squares = total + t, squares + t * t
        out = out + F.lit(0.5) * (total * total - squares)
    return out


def fm_vectors(linear: dict[str, float], factors: dict[str, list[float]], of: list[str], by: list[str], bias: float = 0.0) -> tuple[Column, Column]:
    """Two vectors, over the features ``of`` and ``by``, whose inner product is ``fm_score`` of all of them up to rounding.

    The terms within a side are a score of their own; between the sides only
    the products of the summed factors are left.
    """
    d = len(next(iter(factors.values()), []))
    sides = []
    for cols, own in ((of, bias), (by, 0.0)):
        mine = {c: v for c, v in factors.items() if c in cols}
        alone = fm_score({c: w for c, w in linear.items() if c in cols}, mine, own)
        sums = [sum((F.lit(float(v[j])) * F.col(c).cast("double") for c, v in mine.items()), F.lit(0.0)) for j in range(d)]
        sides.append((alone, sums))
    one = F.lit(1.0)
    return F.array(sides[0][0], one, *sides[0][1]), F.array(one, sides[1][0], *sides[1][1])
