"""Queries of the data layer: splits, vocabularies, features, histories, statistics, samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators import features, history, sampling, split, stats, vocab
from rillstone.operators.ordering import global_rank
from rillstone.plans.interactions import ORDER, SQL_D, SQL_I, SQL_LISTS, SQL_ORDER, SQL_SPLIT, interactions, table
from rillstone.session import sweep

ROW = ["user", "item", "k1", "k2", "k3", "k4"]
L = 10
NONE = -1


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_by_ratio(interactions(spark, sf_dir), "user", ORDER, test_size=0.2)


def split_ratio_chrono(spark, sf_dir):
    return chrono_split(spark, sf_dir).select(*ROW, "fold")


def split_multi_ratio(spark, sf_dir):
    return split.split_by_ratio(interactions(spark, sf_dir), "user", ORDER, multi_ratios=[0.7, 0.2, 0.1]).select(*ROW, "fold")


def split_num_chrono(spark, sf_dir):
    return split.split_by_num(interactions(spark, sf_dir), "user", ORDER, 2).select(*ROW, "fold")


def split_random_counts(spark, sf_dir):
    out = split.random_split(interactions(spark, sf_dir), ORDER, multi_ratios=[0.8, 0.1, 0.1])
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def filter_unknown(spark, sf_dir):
    s = chrono_split(spark, sf_dir)
    return split.filter_unknown(s.where("fold = 1"), s.where("fold = 0"), ["user", "item"]).select(*ROW)


def pad_unknown(spark, sf_dir):
    s = chrono_split(spark, sf_dir)
    return split.pad_unknown(s.where("fold = 1"), s.where("fold = 0"), {"user": -9, "item": -8}).select(*ROW)


def vocab_encode(spark, sf_dir):
    s = chrono_split(spark, sf_dir)
    train = s.where("fold = 0")
    for c in ("user", "item"):
        v = vocab.vocabulary(train, c)
        s = vocab.encode(s, c, v, v.count())
    return s.select(*ROW, "user_idx", "item_idx")


def vocab_growth(spark, sf_dir):
    s = chrono_split(spark, sf_dir)
    old = vocab.vocabulary(s.where("fold = 0"), "item")
    return vocab.grow(old, s.where("fold = 1"), "item")


def sparse_matrix_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    v = {n: vocab.vocabulary(c, n) for n in ("c_mktsegment", "c_nationkey")}
    space = vocab.IndexSpace({n: x.count() for n, x in v.items()})
    out = vocab.sparse_indices(c, space, v)
    return out.select("c_custkey", F.posexplode("sparse").alias("pos", "idx"))


def multi_value_split(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", "|").alias("words"))
    return features.split_multi_value(p, ["words"], "|", [3])[0]


def multi_sparse_encode(spark, sf_dir):
    p, names = features.split_multi_value(table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.regexp_replace("p_name", " ", "|").alias("words")), ["words"], "|", [3])
    v = {"p_brand": vocab.vocabulary(p, "p_brand"), "words": vocab.vocabulary(p, names[0], "missing")}
    space = vocab.IndexSpace({n: x.count() for n, x in v.items()}, {"words": names[0]})
    return vocab.sparse_indices(p, space, v).select("p_partkey", F.posexplode("sparse").alias("pos", "idx"))


def _scaled(kind):
    def run(spark, sf_dir):
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
        params = features.fit_scaler(c, ["c_acctbal"], kind)
        return features.scale(c, ["c_acctbal"], params).select("c_custkey", F.round("c_acctbal", 6).alias("x"))

    return run


minmax_scale, standard_scale, robust_scale, power_scale = (_scaled(k) for k in features.NORMALIZERS)


def dense_transforms(spark, sf_dir):
    p = features.transform_dense(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return p.select("p_partkey", *[F.round(c, 6).alias(c) for c in p.columns if c.split("_")[-1] in features.TRANSFORMERS])


def distinct_last(spark, sf_dir):
    return features.drop_duplicates_last(interactions(spark, sf_dir), ["user", "item"], ["time", "k1", "k2", "k3", "k4"])


def dedup_keep_last(spark, sf_dir):
    return distinct_last(spark, sf_dir).select(*ROW, "label")


def dataset_stats(spark, sf_dir):
    out = stats.dataset_stats(interactions(spark, sf_dir), "user", "item", "label")
    return out.select("data_size", "n_users", "n_items", "min_label", "max_label", F.round("global_mean", 6).alias("global_mean"), F.round("density", 6).alias("density"))


def popular_items(spark, sf_dir):
    return stats.popular_items(interactions(spark, sf_dir), "user", "item", 100)


def popular_topped_up(spark, sf_dir):
    i = interactions(spark, sf_dir)
    new = stats.popular_items(i.where("label = 5"), "user", "item", 60)
    return stats.top_up_popular(new, stats.popular_items(i, "user", "item", 100), "item", 100)


def lists(spark, sf_dir):
    return history.consumed(interactions(spark, sf_dir), "user", "item", ORDER)


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def consumed_lists(spark, sf_dir):
    return lists(spark, sf_dir).select("user", _joined("items").alias("items"))


def consumed_merge(spark, sf_dir):
    i = interactions(spark, sf_dir)
    old, new = (history.consumed(i.where(c), "user", "item", ORDER) for c in ("k1 % 2 = 0", "k1 % 2 = 1"))
    return history.merge_consumed(old, new, "user").select("user", _joined("items").alias("items"))


def user_dim_last(spark, sf_dir):
    return features.last_rows(interactions(spark, sf_dir), "user", ["item", "label"], ORDER)


def dim_oov_row(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return features.oov_row(c, ["c_acctbal"], {"c_mktsegment": "unknown"}).select(F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


def feature_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    patch = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return features.upsert(c, patch, "c_custkey", ["c_acctbal", "c_mktsegment"], insert=False)


def feature_override(spark, sf_dir):
    """Features of requests over fixed ones."""
    r = table(spark, sf_dir, "rec_requests").select("request_id", "n_rec", "received_at", "user_feats")
    r = r.withColumn("sex", F.lit("none")).withColumn("age", F.lit(0))
    out = features.override(r, "user_feats", {"sex": "string", "age": "int"}, {"sex": {"male": 0, "female": 1}})
    return out.groupBy("sex", "age").agg(F.count(F.lit(1)).alias("n"))


def recent_seq(spark, sf_dir):
    out = history.recent_seq(lists(spark, sf_dir), "items", L, NONE)
    return out.select("user", _joined("seq").alias("seq"), F.col("seq_len").cast("long").alias("seq_len"))


def train_seq_recent(spark, sf_dir):
    out = history.train_seq(interactions(spark, sf_dir), lists(spark, sf_dir), "user", "item", L, NONE)
    return out.select(*ROW, _joined("seq").alias("seq"), F.col("seq_len").cast("long").alias("seq_len"))


def dual_seq(spark, sf_dir):
    out = history.dual_seq(interactions(spark, sf_dir), lists(spark, sf_dir), "user", "item", 8, 4, NONE)
    return out.select(*ROW, *[_joined(f"{n}_seq").alias(f"{n}_seq") for n in ("short", "long")], *[F.col(f"{n}_len").cast("long").alias(f"{n}_len") for n in ("short", "long")])


def sparse_history(spark, sf_dir):
    i = interactions(spark, sf_dir).withColumn("row", F.struct("k1", "k2", "k3", "k4"))
    out = history.sparse_history(i, lists(spark, sf_dir), "row", "user", "item", 5)
    return out.select("row.*", F.col("pos").cast("long").alias("pos"), "past_item")


def consecutive_edges(spark, sf_dir):
    return history.consecutive_edges(interactions(spark, sf_dir), "user", "item", ORDER)


def neg_probs(spark, sf_dir):
    return stats.negative_probabilities(interactions(spark, sf_dir), "user", "item").select("item", F.round("prob", 9).alias("prob"))


def pos_probs(spark, sf_dir):
    return stats.positive_probabilities(interactions(spark, sf_dir), "user", "item").select("item", F.round("prob", 9).alias("prob"))


def logq_correction(spark, sf_dir):
    return stats.sampling_correction(interactions(spark, sf_dir), "item").select("item", F.round("rate", 9).alias("rate"))


def mutual_info(spark, sf_dir):
    out = stats.mutual_information(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"])
    return out.select("a", "b", F.round("mi", 6).alias("mi"))


def _rows(spark, sf_dir):
    return global_rank(interactions(spark, sf_dir).select("user", "item", "label", *[c for c in ORDER if c != "item"]), ORDER, "row")


def neg_random(spark, sf_dir):
    rows = interactions(spark, sf_dir).select("k1", "k2", "item")
    rows = rows.groupBy("k1", "k2").agg(F.min("item").alias("item")).withColumn("row", F.col("k1") * 100 + F.col("k2"))
    n = rows.agg(F.max("item")).first()[0] + 1
    return sampling.random_negatives(rows, "row", "item", n, 3).select("row", "negative")


def neg_unconsumed(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    n = rows.agg(F.max("item")).first()[0] + 1
    sweep(spark)
    return sampling.unconsumed_negatives(rows.select("row", "user", "item"), "row", "user", "item", rows.select("user", "item"), n, 2).select("row", "user", "negative")


def neg_popular(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return sampling.popular_negatives(rows, "row", "item", rows, "user", 2).select("row", "negative")


def neg_out_batch(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("batch", F.call_function("div", F.col("row"), F.lit(256)))
    n = rows.agg(F.max("item")).first()[0] + 1
    return sampling.out_batch_negatives(rows, "row", "batch", "item", n).select("row", "negative")


def eval_negatives(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    n = rows.agg(F.max("item")).first()[0] + 1
    out = sampling.eval_negatives(rows, "row", "user", "item", rows.select("user", "item").distinct(), n, 1)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def masked_views(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    out = sampling.mask_features(c, ["c_nationkey", "c_mktsegment"], "c_custkey", {"c_nationkey": -1, "c_mktsegment": "?"}, "rfm-complementary")
    return out.groupBy("c_custkey").agg(F.max("c_nationkey").alias("c_nationkey"), F.sum((F.col("c_mktsegment") == "?").cast("long")).alias("n_masked"))


def sampled_users(spark, sf_dir):
    out = sampling.sample_users(interactions(spark, sf_dir), "user", 50)
    return out.agg(F.count_distinct("user").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        split_ratio_chrono, split_multi_ratio, split_num_chrono, split_random_counts, filter_unknown, pad_unknown, vocab_encode, vocab_growth,
        sparse_matrix_offsets, multi_value_split, multi_sparse_encode, dense_transforms, dedup_keep_last, dataset_stats, popular_items, popular_topped_up,
        consumed_lists, consumed_merge, user_dim_last, dim_oov_row, feature_update, feature_override, recent_seq, train_seq_recent, dual_seq, sparse_history,
        consecutive_edges, neg_probs, pos_probs, logq_correction, mutual_info, neg_random, neg_unconsumed, neg_popular, neg_out_batch, eval_negatives, masked_views, sampled_users,
    )
} | {"minmax_scale": minmax_scale, "standard_scale": standard_scale, "robust_scale": robust_scale, "power_scale": power_scale}

_R = '"user", item, k1, k2, k3, k4'
_J = lambda c: f"array_to_string({c}, ',')"
#: Rows of the held-out fold, and the users and items of the other.
_KNOWN = """sm as materialized (select * from s), s0f as (select * from sm where fold = 1),
        ku as materialized (select distinct "user" from sm where fold = 0), ki as materialized (select distinct item from sm where fold = 0)"""
_BEFORE = SQL_LISTS + """,
b as (select i0."user", item, k1, k2, k3, k4,
        case when list_position(items, item) > 0 then items[1:list_position(items, item) - 1] else items end as past
      from i0 join l on i0."user" = l."user")"""
_PAD = lambda c, n: f"array_to_string(({c} || list_transform(range({n}), lambda x: -1::bigint))[1:{n}], ',')"
_SCALE = lambda shift, scale: f"""
    select c_custkey, round((c_acctbal - a) / case when b = 0 then 1 else b end, 6) as x
    from customer, (select {shift} as a, {scale} as b from customer)"""  # noqa: E731
_WORDS = """
w as (select p_partkey, p_brand, string_split(lower(p_name), ' ') as x from part),
m as (select p_partkey, p_brand, coalesce(x[1], 'missing') as words_1, coalesce(x[2], 'missing') as words_2, coalesce(x[3], 'missing') as words_3 from w)"""



def _mix(*parts: str) -> str:
    """Columns whose last, ``h``, is the integer mixing of ``parts``."""
    last, cols = "12345", []
    for n, x in enumerate(parts):
        out = "h" if n == len(parts) - 1 else f"m{n}"
        cols.append(f"({last} * 48271 + (({x}) % 2147483647) * 16807 + 12345) % 2147483647 as m{n}_0, (m{n}_0 * 48271 + (m{n}_0 >> 11)) % 2147483647 as {out}")
        last = out
    return ", ".join(cols)


_RANKED = SQL_I + f""",
    r as (select *, row_number() over (order by {SQL_ORDER}) - 1 as "row" from i0), n as (select max(item) + 1 as n from r)"""

ORACLE = {
    "neg_random": f"""with r as (select l_orderkey * 100 + l_linenumber as "row", min(l_partkey) as item from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, l_linenumber),
        n as (select max(item) + 1 as n from r), c as (select "row", item, k, n, {_mix('"row"', 'k', '42')} from r cross join n cross join (select unnest(range(30)) as k)),
        g as (select "row", h % n as negative, min(k) as k from c where h % n <> item group by "row", h % n)
        select "row", negative from g qualify row_number() over (partition by "row" order by k) <= 3""",
    "neg_unconsumed": f"""with {_RANKED}, c as (select "row", "user", item, k, n, {_mix('"row"', 'k', '42')} from r cross join n cross join (select unnest(range(20)) as k)),
        g as (select "row", "user", h % n as negative, min(k) as k from c where h % n <> item group by "row", "user", h % n),
        e as (select distinct "user", item from i0)
        select "row", g."user", negative from g left join e on e."user" = g."user" and e.item = negative
        qualify row_number() over (partition by "row" order by e.item is not null, k) <= 2""",
    "neg_out_batch": f"""with {_RANKED}, c as (select "row", item, k, n, {_mix('"row"', 'k', '42')} from r cross join n cross join (select unnest(range(16)) as k)),
        e as (select distinct "row" // 256 as b, item from r)
        select "row", h % n as negative from c left join e on e.b = "row" // 256 and e.item = h % n where h % n <> c.item
        qualify row_number() over (partition by "row" order by e.item is not null, k) <= 1""",
    "split_ratio_chrono": f"with {SQL_SPLIT} select {_R}, fold from s",
    "split_multi_ratio": f"""with {SQL_I},
        s0 as (select *, row_number() over (partition by "user" order by {SQL_ORDER}) as at_, count(*) over (partition by "user") as n from i0)
        select {_R}, case when n <= 3 then 0 else (at_ > cast(round_even(0.7::double * n, 0) as bigint))::int
          + (at_ > cast(round_even((0.7::double + 0.2::double) * n, 0) as bigint))::int end as fold from s0""",
    "split_num_chrono": f"""with {SQL_I},
        s0 as (select *, row_number() over (partition by "user" order by {SQL_ORDER}) as at_, count(*) over (partition by "user") as n from i0)
        select {_R}, case when n <= 3 then 0 when at_ > n - 2 then 1 else 0 end as fold from s0""",
    "split_random_counts": """with n as (select count(*) as n from lineitem join orders on l_orderkey = o_orderkey),
        a as (select n, cast(ceil(round(n * 0.1, 9)) as bigint) as f2 from n),
        b as (select n, f2, cast(ceil(round((n - f2) * 0.1 / 0.9, 9)) as bigint) as f1 from a)
        select 0 as fold, n - f1 - f2 as n from b union all select 1, f1 from b union all select 2, f2 from b""",
    "filter_unknown": f"""with {SQL_SPLIT}, {_KNOWN} select {_R} from s0f semi join ku using ("user") semi join ki using (item)""",
    "pad_unknown": f"""with {SQL_SPLIT}, {_KNOWN} select case when ku."user" is null then -9 else s0f."user" end as "user",
        case when ki.item is null then -8 else s0f.item end as item, k1, k2, k3, k4
        from s0f left join ku on s0f."user" = ku."user" left join ki on s0f.item = ki.item""",
    "vocab_encode": f"""with {SQL_SPLIT},
        vu as (select "user" as r, row_number() over (order by "user") - 1 as x from (select distinct "user" from s where fold = 0)),
        vi as (select item as r, row_number() over (order by item) - 1 as x from (select distinct item from s where fold = 0))
        select {_R}, coalesce(vu.x, (select count(*) from vu)) as user_idx, coalesce(vi.x, (select count(*) from vi)) as item_idx
        from s left join vu on "user" = vu.r left join vi on item = vi.r""",
    "vocab_growth": f"""with {SQL_SPLIT},
        o as (select item as raw, row_number() over (order by item) - 1 as idx from (select distinct item from s where fold = 0)),
        n as (select item as raw, row_number() over (order by item) - 1 + (select count(*) from o) as idx
              from (select distinct item from s where fold = 1 and item not in (select raw from o)))
        select raw, idx from o union all select raw, idx from n""",
    "sparse_matrix_offsets": """with
        a as (select c_mktsegment as r, row_number() over (order by c_mktsegment) - 1 as x from (select distinct c_mktsegment from customer)),
        b as (select c_nationkey as r, row_number() over (order by c_nationkey) - 1 as x from (select distinct c_nationkey from customer)),
        n as (select (select count(*) from a) as na, (select count(*) from b) as nb)
        select c_custkey, 0 as pos, cast(coalesce(a.x, na) as int) as idx from customer cross join n left join a on c_mktsegment = a.r
        union all select c_custkey, 1, cast(coalesce(b.x, nb) + na + 1 as int) from customer cross join n left join b on c_nationkey = b.r""",
    "multi_value_split": f"with {_WORDS} select p_partkey, words_1, words_2, words_3 from m",
    "multi_sparse_encode": f"""with {_WORDS},
        a as (select p_brand as r, row_number() over (order by p_brand) - 1 as x from (select distinct p_brand from m)),
        b as (select r, row_number() over (order by r) - 1 as x from (select words_1 as r from m union select words_2 from m union select words_3 from m) where r <> 'missing'),
        n as (select (select count(*) from a) as na, (select count(*) from b) as nb),
        e as (select p_partkey, 0 as pos, p_brand as v from m union all select p_partkey, 1, words_1 from m union all select p_partkey, 2, words_2 from m union all select p_partkey, 3, words_3 from m)
        select p_partkey, pos, cast(case when pos = 0 then coalesce(a.x, na) else na + 1 + coalesce(b.x, nb) end as int) as idx
        from e cross join n left join a on pos = 0 and v = a.r left join b on pos > 0 and v = b.r""",
    "minmax_scale": _SCALE("min(c_acctbal)", "max(c_acctbal) - min(c_acctbal)"),
    "standard_scale": _SCALE("avg(c_acctbal)", "stddev_pop(c_acctbal)"),
    "robust_scale": _SCALE("quantile_cont(c_acctbal, 0.5)", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)"),
    "dense_transforms": """select p_partkey, round(ln(1 + p_size), 6) as p_size_log, round(sqrt(p_size), 6) as p_size_sqrt, round(p_size::double * p_size, 6) as p_size_square,
        round(ln(1 + p_retailprice), 6) as p_retailprice_log, round(sqrt(p_retailprice), 6) as p_retailprice_sqrt, round(p_retailprice * p_retailprice, 6) as p_retailprice_square from part""",
    "dedup_keep_last": f"with {SQL_D} select {_R}, label from d",
    "dataset_stats": f"""with {SQL_I} select count(*) as data_size, count(distinct "user") as n_users, count(distinct item) as n_items, min(label) as min_label, max(label) as max_label,
        round(avg(label), 6) as global_mean, round(100.0::double * count(*) / (count(distinct "user") * count(distinct item)), 6) as density from i0""",
    "popular_items": f"""with {SQL_I} select item, count(distinct "user") as n_users from i0 group by item order by n_users desc, item limit 100""",
    "popular_topped_up": f"""with {SQL_I},
        n as (select item, count(distinct "user") as c from i0 where label = 5 group by item order by c desc, item limit 60),
        o as (select item, count(distinct "user") as c from i0 group by item order by c desc, item limit 100)
        select item from (select item, 0 as g, c from n union all select item, 1, c from o where item not in (select item from n)) order by g, c desc, item limit 100""",
    "consumed_lists": f"""with {SQL_LISTS} select "user", {_J('items')} as items from l""",
    "consumed_merge": f"""with {SQL_I},
        c0 as (select *, k1 % 2 as half, lag(item) over (partition by "user", k1 % 2 order by {SQL_ORDER}) as before from i0)
        select "user", array_to_string(list(item order by half, {SQL_ORDER}), ',') as items from c0 where before is null or before <> item group by "user" """,
    "user_dim_last": f"""with {SQL_I} select "user", item, label from (
        select *, row_number() over (partition by "user" order by time desc, k1 desc, k2 desc, item desc, k3 desc, k4 desc) as rn from i0) where rn = 1""",
    "dim_oov_row": "select round(avg(c_acctbal), 6) as c_acctbal, 'unknown' as c_mktsegment from customer",
    "feature_update": """select c_custkey, coalesce(s_acctbal, c_acctbal) as c_acctbal, c_mktsegment from customer left join supplier on c_custkey = s_suppkey * 3""",
    "feature_override": """with r as (select map_extract_value(user_feats, 'sex') as s, case when regexp_full_match(trim(map_extract_value(user_feats, 'age')), '[-+]?[0-9]+') then cast(map_extract_value(user_feats, 'age') as int) end as a from rec_requests)
        select case when s in ('male', 'female') then s else 'none' end as sex, coalesce(a, 0) as age, count(*) as n from r group by 1, 2""",
    "recent_seq": f"""with {SQL_LISTS} select "user", {_PAD('items[-10:]', 10)} as seq, greatest(least(len(items), 10), 1) as seq_len from l""",
    "train_seq_recent": f"""with {_BEFORE} select {_R}, {_PAD('past[-10:]', 10)} as seq, greatest(least(len(past), 10), 1) as seq_len from b""",
    "dual_seq": f"""with {_BEFORE} select {_R}, {_PAD('past[-4:]', 4)} as short_seq, {_PAD('past[1:greatest(len(past) - 4, 0)][-8:]', 8)} as long_seq,
        greatest(least(len(past), 4), 1) as short_len, greatest(least(len(past) - 4, 8), 1) as long_len from b""",
    "sparse_history": f"""with {_BEFORE}, p as (select k1, k2, k3, k4, past[-5:] as q from b)
        select k1, k2, k3, k4, unnest(range(len(q))) as pos, unnest(q) as past_item from p""",
    "consecutive_edges": f"""with {SQL_I}, c0 as (select *, lag(item) over (partition by "user" order by {SQL_ORDER}) as before from i0),
        e as (select item as src, lead(item) over (partition by "user" order by {SQL_ORDER}) as dst from c0 where before is null or before <> item)
        select src, dst, count(*) as weight from e where dst is not null group by src, dst""",
    "neg_probs": f"""with {SQL_I}, f as (select item, pow(count(distinct "user"), 0.75) as p from i0 group by item)
        select item, round(p / (select sum(p) from f), 9) as prob from f""",
    "pos_probs": f"""with {SQL_I}, f as (select item, count(distinct "user")::double / (select count(distinct "user") from i0) as p from i0 group by item)
        select item, round((sqrt(p / 0.001::double) + 1) * (0.001::double / p), 9) as prob from f""",
    "logq_correction": f"with {SQL_I} select item, round(count(*)::double / (select count(*) from i0), 9) as rate from i0 group by item",
    "mutual_info": """with p as (select p_brand as a, p_type as b, p_size::varchar as c from part), n as (select count(*)::double as n from part),
        e as (select 'p_brand' as x, 'p_type' as y, a as u, b as v from p union all select 'p_brand', 'p_size', a, c from p union all select 'p_type', 'p_size', b, c from p),
        j as (select x, y, u, v, count(*) as k from e group by x, y, u, v),
        ju as (select x, y, u, sum(k) as ku from j group by x, y, u), jv as (select x, y, v, sum(k) as kv from j group by x, y, v)
        select x as a, y as b, round(sum(k / n * ln(k * n / (ku * kv))), 6) as mi from j join ju using (x, y, u) join jv using (x, y, v), n group by x, y""",
    "eval_negatives": """with n as (select count(*) as n from lineitem join orders on l_orderkey = o_orderkey) select 1 as label, n from n union all select 0, n from n""",
    "masked_views": "select c_custkey, c_nationkey, cast(1 as bigint) as n_masked from customer",
    "sampled_users": 'select least(50, count(distinct o_custkey)) as n from lineitem join orders on l_orderkey = o_orderkey',
}
