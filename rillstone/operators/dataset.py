"""The catalogue of an encoded data set: vocabularies, histories, sizes; building, merging, saving."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators import history, stats, vocab
from rillstone.operators.features import drop_duplicates_last
from rillstone.session import BROADCAST_ROWS, materialize
from rillstone.sources.tables import check_interactions, load_frames, save_frames


@dataclass(frozen=True)
class OldSizes:
    """Sizes of an earlier training, for models that grow."""

    n_users: int
    n_items: int


@dataclass(frozen=True)
class Catalog:
    """Everything an encoded data set needs; an explicit object, no global state."""

    users: DataFrame  # raw, idx
    items: DataFrame
    user_consumed: DataFrame  # user, items (inner ids)
    item_consumed: DataFrame  # computed when it is read
    popular: DataFrame  # item, n_users
    n_users: int
    n_items: int
    global_mean: float
    min_label: float
    max_label: float
    old: OldSizes | None = None

    @classmethod
    def build(cls, train: DataFrame, order: list[str]) -> tuple[Catalog, DataFrame]:
        """Catalogue of a training frame, and the frame encoded (``user_idx, item_idx``)."""
        check_interactions(train)
        users, items = (materialize(vocab.vocabulary(train, c), "vocab") for c in ("user", "item"))
        return cls._of(train, order, users, items, None, None)

    @classmethod
    def _of(cls, train: DataFrame, order: list[str], users: DataFrame, items: DataFrame, before: Catalog | None, old: OldSizes | None, merge: bool = True) -> tuple[Catalog, DataFrame]:
        n_users, n_items = users.count(), items.count()
        whole = all(isinstance(train.schema[c].dataType, T.IntegralType) for c in ("user", "item"))
        if before is None and whole and max(n_users, n_items) > BROADCAST_ROWS:
            enc = vocab.encode_sorted(train, {"user": (users, n_users), "item": (items, n_items)})
        else:
            enc = vocab.encode(vocab.encode(train, "user", users, n_users, size=n_users), "item", items, n_items, size=n_items)
        enc = materialize(enc, "encoded")
        key = [F.col(c) for c in order]
        uc = history.consumed(enc, "user_idx", "item_idx", key).withColumnRenamed("user_idx", "user")
        ic = history.consumed(enc, "item_idx", "user_idx", key).withColumnRenamed("item_idx", "item")
        popular = stats.popular_items(enc, "user_idx", "item_idx").withColumnRenamed("item_idx", "item")
        if before:
            uc, ic = history.merge_consumed(before.user_consumed, uc, "user", merge=merge), history.merge_consumed(before.item_consumed, ic, "item", merge=merge)
            popular = stats.top_up_popular(popular, before.popular, "item").withColumn("n_users", F.lit(None).cast("long"))
        row = enc.agg(F.avg("label").alias("global_mean"), F.min("label").alias("min_label"), F.max("label").alias("max_label")).first()
        cat = cls(users, items, materialize(uc, "consumed"), ic, popular, n_users, n_items, row["global_mean"], row["min_label"], row["max_label"], old)
        return cat, enc

    def merge(self, train: DataFrame, order: list[str], merge_behavior: bool = True) -> tuple[Catalog, DataFrame]:
        """Catalogue grown by new rows: old ids stay, new ones come behind; histories are joined or replaced."""
        check_interactions(train)
        users, items = (materialize(vocab.grow(v, train, c), "vocab") for v, c in ((self.users, "user"), (self.items, "item")))
        return self._of(train, order, users, items, self, OldSizes(self.n_users, self.n_items), merge_behavior)

    def encode(self, df: DataFrame) -> DataFrame:
        """Evaluation rows with inner ids; unknown users and items get n_users and n_items, a missing label 0."""
        check_interactions(df, train=False)
        if "label" not in df.columns:
            df = df.withColumn("label", F.lit(0))
        return vocab.encode(vocab.encode(df, "user", self.users, self.n_users, size=self.n_users), "item", self.items, self.n_items, size=self.n_items)

    def interactions(self, encoded: DataFrame, order: list[str]) -> DataFrame:
        """One row for each (user, item), the last."""
        rest = [c for c in order if c not in ("user", "item")]
        return drop_duplicates_last(encoded, ["user_idx", "item_idx"], rest or ["label"])

    _FRAMES = ("users", "items", "user_consumed", "item_consumed", "popular")

    def save(self, path: str) -> None:
        meta = {k: getattr(self, k) for k in ("n_users", "n_items", "global_mean", "min_label", "max_label")}
        save_frames(self.users.sparkSession, path, {k: getattr(self, k) for k in self._FRAMES}, meta | {"old": [self.old.n_users, self.old.n_items] if self.old else None})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        frames, meta = load_frames(spark, path)
        old = OldSizes(*meta.pop("old")) if meta.get("old") else (meta.pop("old", None) and None)
        meta.pop("frames")
        return cls(**frames, **meta, old=old)
