"""Vector expressions over array columns, evaluated in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; norms of 0 count as 1."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def weighted_sum(vectors: Column | str, dim: int) -> Column:
    """Sum of an array of vectors, position by position."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")))


def pool(vectors: Column, valid: Column, dim: int, combiner: str = "sqrtn") -> Column:
    """Pool vectors whose flag in ``valid`` is set: sum, mean or sum / sqrt(count); none gives zeros."""
    if combiner not in ("sum", "mean", "sqrtn"):
        raise ValueError(f"unknown combiner {combiner!r}")
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), valid.alias("ok")), lambda x: x["ok"]), lambda x: x["v"])
    n = F.size(kept).cast("double")
    by = {"sum": F.lit(1.0), "mean": n, "sqrtn": F.sqrt(n)}[combiner]
    return F.transform(weighted_sum(kept, dim), lambda x: F.coalesce(F.try_divide(x, by), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    """Tanh form of the Gaussian error linear unit."""
    inner = F.lit(math.sqrt(2 / math.pi)) * (x + F.lit(0.044715) * x * x * x)
    return F.lit(0.5) * x * (1 + F.tanh(inner))


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def rms_norm(a: Column, eps: float = 1e-8) -> Column:
    mean = dot(a, a) / F.size(a)
    return F.transform(a, lambda x: x / F.sqrt(mean + eps))


def layer_norm(a: Column, eps: float = 1e-8) -> Column:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.transform(a, lambda x: (x - mean) / F.sqrt(var + eps))


def positional_encoding(spark: SparkSession, length: int, dim: int) -> DataFrame:
    """``pos, i, value``: sines in the first half of the dimensions, cosines in the second."""
    r = spark.range(length).select(F.col("id").alias("pos")).crossJoin(spark.range(dim).select(F.col("id").alias("i")))
    half = (dim + 1) // 2
    k = F.when(F.col("i") < half, F.col("i")).otherwise(F.col("i") - half)
    angle = F.col("pos") / F.pow(F.lit(10000.0), 2 * k / F.lit(float(dim)))
    return r.withColumn("value", F.when(F.col("i") < half, F.sin(angle)).otherwise(F.cos(angle)))


# losses of one prediction


def bce_loss(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    right = F.when(label > 0, p).otherwise(1 - p)
    weight = F.when(label > 0, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return weight * F.pow(1 - right, F.lit(gamma)) * bce_loss(logit, label)


def bpr_loss(positive: Column, negative: Column) -> Column:
    return F.log1p(F.exp(negative - positive))


def max_margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), negative - positive + F.lit(margin))


LOSSES = {"cross_entropy": bce_loss, "focal": focal_loss, "bpr": bpr_loss, "max_margin": max_margin_loss}
