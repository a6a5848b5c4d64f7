"""Dense scaling, multi-valued columns, feature dimensions and their updates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMALIZERS = ("min_max", "standard", "robust", "power")
TRANSFORMERS = ("log", "sqrt", "square")


def fit_scaler(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """One row with the parameters of each column: ``<col>_shift, <col>_scale`` (and ``<col>_lambda``)."""
    if kind not in NORMALIZERS:
        raise ValueError(f"unknown normalizer {kind!r}")
    if kind == "power":
        return _fit_power(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if kind == "min_max":
            shift, scale = F.min(x), F.max(x) - F.min(x)
        elif kind == "standard":
            shift, scale = F.avg(x), F.stddev_pop(x)
        else:
            q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            shift, scale = q[1], q[2] - q[0]
        aggs += [shift.alias(f"{c}_shift"), scale.alias(f"{c}_scale")]
    return df.agg(*aggs)


def scale(df: DataFrame, cols: list[str], params: DataFrame) -> DataFrame:
    """(x - shift) / scale with parameters fitted on another frame; a scale of 0 counts as 1."""
    names = params.columns
    out = df.crossJoin(F.broadcast(params))  # one row
    for c in cols:
        x = F.col(c).cast("double")
        if f"{c}_lambda" in names:
            x = yeo_johnson(x, F.col(f"{c}_lambda"))
        s = F.col(f"{c}_scale")
        out = out.withColumn(c, (x - F.col(f"{c}_shift")) / F.when(s == 0, 1.0).otherwise(s))
    return out.drop(*names)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson power transform."""
    near0, near2 = F.abs(lam) < 1e-12, F.abs(lam - 2) < 1e-12
    up = F.when(near0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(near0, 1.0).otherwise(lam))
    down = F.when(near2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / F.when(near2, 1.0).otherwise(2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def _fit_power(df: DataFrame, cols: list[str], rounds: int = 8, points: int = 9) -> DataFrame:
    """Likelihood-maximal lambda of each column by narrowing grids: one aggregate pass per round for all columns."""
    spans = {c: (-3.0, 3.0) for c in cols}
    for _ in range(rounds):
        grids = {c: [lo + (hi - lo) * k / (points - 1) for k in range(points)] for c, (lo, hi) in spans.items()}
        aggs = []
        for c, grid in grids.items():
            x = F.col(c).cast("double")
            aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"{c}_j"))
            aggs.append(F.count(x).alias(f"{c}_n"))
            aggs += [F.var_pop(yeo_johnson(x, F.lit(lam))).alias(f"{c}_{k}") for k, lam in enumerate(grid)]
        row = df.agg(*aggs).first()
        for c, grid in grids.items():
            n, j = row[f"{c}_n"], row[f"{c}_j"] or 0.0
            like = [(-n / 2 * math.log(v) + (lam - 1) * j) if (v := row[f"{c}_{k}"]) else -math.inf for k, lam in enumerate(grid)]
            best = max(range(points), key=like.__getitem__)
            spans[c] = (grid[max(0, best - 1)], grid[min(points - 1, best + 1)])
    aggs = []
    for c, (lo, hi) in spans.items():
        lam = F.lit((lo + hi) / 2)
        y = yeo_johnson(F.col(c).cast("double"), lam)
        aggs += [F.avg(y).alias(f"{c}_shift"), F.stddev_pop(y).alias(f"{c}_scale"), F.first(lam).alias(f"{c}_lambda")]
    return df.agg(*aggs)


def transform_dense(df: DataFrame, cols: list[str], kinds: tuple[str, ...] = TRANSFORMERS) -> DataFrame:
    """Add ``<col>_log`` (of 1 + x), ``_sqrt``, ``_square``; columns with negative values get none."""
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    make = {"log": F.log1p, "sqrt": F.sqrt, "square": lambda x: x * x}
    for c in cols:
        if low[c] is not None and low[c] >= 0:
            for k in kinds:
                df = df.withColumn(f"{c}_{k}", make[k](F.col(c).cast("double")))
    return df


def split_multi_value(df: DataFrame, cols: list[str], sep: str, max_len: list[int] | None = None, pad_val: str | list[str] = "missing") -> tuple[DataFrame, list[list[str]]]:
    """Positional columns ``<col>_1..k`` of delimited text; the frame and the new columns of each.

    Separators and blanks around are stripped, all blanks removed, letters
    lowered; empty text becomes the pad value. k is the longest list or
    ``max_len``. Nulls anywhere in text columns become the first pad value.
    """
    pads = [pad_val] * len(cols) if isinstance(pad_val, str) else list(pad_val)
    clean = {c: F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), f"^[\\Q{sep}\\E\\s]+|[\\Q{sep}\\E\\s]+$", ""), r"\s+", "")) for c in cols}
    for c, p in zip(cols, pads, strict=True):
        df = df.withColumn(c, F.split(F.when(clean[c] == "", F.lit(p)).otherwise(clean[c]), f"\\Q{sep}\\E"))
    longest = df.agg(*[F.max(F.size(c)).alias(c) for c in cols]).first()
    names = []
    for j, (c, p) in enumerate(zip(cols, pads, strict=True)):
        k = max_len[j] if max_len else (longest[c] or 1)
        new = [f"{c}_{i + 1}" for i in range(k)]
        for i, name in enumerate(new):
            df = df.withColumn(name, F.coalesce(F.get(c, F.lit(i)), F.lit(p)))
        names.append(new)
    df = df.drop(*cols)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna(pads[0], subset=strings), names


def last_rows(df: DataFrame, key: str, cols: list[str], order: list[Column | str]) -> DataFrame:
    """Dimension table: the last row of each key in the given order."""
    by = F.struct(*order)
    picked = F.max_by(F.struct(*cols), by)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("_r")).select(key, "_r.*")


def drop_duplicates_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep the last of the rows that agree in ``keys``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def oov_row(dim: DataFrame, dense: list[str], sparse_oov: dict[str, object]) -> DataFrame:
    """The row of unknown keys: column means of dense features, out-of-vocabulary of sparse ones."""
    means = dim.agg(*[F.avg(c).alias(c) for c in dense]) if dense else dim.agg(F.count(F.lit(1)).alias("_n")).select()
    return means.select("*", *[F.lit(v).alias(k) for k, v in sparse_oov.items()])


def override(df: DataFrame, feats: str, cols: dict[str, str], vocabs: dict[str, dict] | None = None) -> DataFrame:
    """Features of a map column over those of the row; unknown names and categories are ignored.

    ``cols`` gives the type of each feature; ``vocabs`` the allowed categories
    of sparse ones (small, as literals).
    """
    for c, kind in cols.items():
        raw = F.try_element_at(F.col(feats), F.lit(c))
        new = F.expr(f"try_cast(element_at({feats}, '{c}') as {kind})") if kind != "string" else raw
        if vocabs and c in vocabs:
            new = F.when(new.isin(list(vocabs[c])), new)
        df = df.withColumn(c, F.coalesce(new, F.col(c)))
    return df


def upsert(old: DataFrame, new: DataFrame, key: str, cols: list[str], insert: bool = True) -> DataFrame:
    """Rows of ``new`` over those of ``old``, column by column where not null; unknown keys are added or ignored."""
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    both = old.join(n, key, "full_outer" if insert else "left")
    return both.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns if c != key])
