"""Queries of the training-data problems for language and recommendation models, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm.cooccur import associations, latest
from rillstone.llm.frequent import frequent_elements, frequent_values
from rillstone.llm.mixing import mix
from rillstone.llm.neighbours import exact_neighbours, neighbours, recall
from rillstone.llm.subjects import document_subjects
from rillstone.llm.suffixes import leaks, without_leaks
from rillstone.llm.topn import GroupIndex, expand_requests
from rillstone.llm.winnow import overlaps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- p3: top N of every group


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable requests: digits-only user key as number, n_rec of at least 1."""
    key = F.regexp_extract("user_key", r"(?U)^\s*([0-9]+)\s*$", 1)
    entity = F.expr("try_cast(_key as bigint)")
    rows = table(spark, sf_dir, "rec_requests").where("n_rec >= 1").withColumn("_key", F.when(key != "", key))
    return rows.select("request_id", entity.alias("entity"), "n_rec").where("entity is not null")


def p3_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests = _requests(spark, sf_dir)
    sims = table(spark, sf_dir, "k_sims").where("entity <> neighbor").select("entity", "neighbor", "sim")
    return requests, GroupIndex.build(sims, "entity", "neighbor", "sim").top_n(requests, "entity", "n_rec")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, lists = p3_lists(spark, sf_dir)
    out = expand_requests(requests, "request_id", "entity", "n_rec", lists)
    return out.select(F.col("request").alias("request_id"), F.col("item").cast("int").alias("neighbor"))


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked list of every requested user."""
    _, lists = p3_lists(spark, sf_dir)
    return lists.select(F.col("grp").alias("entity"), F.col("item").alias("neighbor"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("sim"))


# ---- p4: items that stand together


def _associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = latest(table(spark, sf_dir, "user_consumed"), ["user_id"], "export_id", "items")
    chunks = latest(table(spark, sf_dir, "item_consumed"), ["item", "chunk_no"], "export_id", "users")
    items = associations(users, "items", 5, 6.0).withColumn("kind", F.lit("item"))
    return items.unionByName(associations(chunks, "users", 5, 6.0).withColumn("kind", F.lit("user")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir).select("kind", F.col("a").alias("a_id"), F.col("b").alias("b_id"))


def p4_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir).select("kind", F.col("a").alias("a_id"), F.col("b").alias("b_id"), "n_ab", F.round("lift", 6).alias("lift"))


# ---- p5: most similar vectors


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(table(spark, sf_dir, "user_embeds"), "user_id", "user_embed", 48, 5, 0.9, newest="trained_at")
    return near.select(F.least("id", "near").cast("int").alias("user_a"), F.greatest("id", "near").cast("int").alias("user_b")).distinct()


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against brute force: users divisible by 20 against all, five nearest of any cosine and of at least 0.9."""
    rows = table(spark, sf_dir, "user_embeds")
    out = None
    for name, floor in (("any", -2.0), ("0.9", 0.9)):
        exact = exact_neighbours(rows, "user_id", "user_embed", 48, 5, floor, every=20, newest="trained_at")
        part = recall(neighbours(rows, "user_id", "user_embed", 48, 5, floor, newest="trained_at"), exact).withColumn("floor", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# ---- p6: same or near-same records across splits

#: Characters of the k-gram and hashes in a window: together the 32 characters of user and item.
RECORD_K, RECORD_W = 24, 9


def _record_text(user: Column, item: Column, label: Column) -> Column:
    """A rating as characters: hashes of user and item in turns of four hex digits, then the label.

    Hashed ids make any k-gram as telling of the user as of the item, so that
    neither a crowded item nor a busy user makes a crowded fingerprint.
    """
    u, i = (F.lpad(F.lower(F.hex(F.xxhash64(c))), 16, "0") for c in (user, item))
    parts = [F.substring(x, p, 4) for p in (1, 5, 9, 13) for x in (u, i)]
    return F.concat(*parts, F.format_string("%.1f", label.cast("double")))


def _split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "split_ratings").where("user_id is not null and item is not null and label is not null and not isnan(label)")
    rows = rows.withColumn("split", F.lower(F.trim("split_name"))).withColumn("text", _record_text(F.col("user_id"), F.col("item"), F.col("label")))
    train, held = rows.where("split = 'train'"), rows.where("split in ('eval', 'test')")
    pairs = overlaps(train, held, "row_id", "text", RECORD_K, RECORD_W, ["user_id", "item", "label", "split", "feed"])
    # user and item stand for 32 characters: rows are near if the alignment matches as many
    pairs = pairs.where(F.col("matched") >= RECORD_K + RECORD_W - 1).withColumnsRenamed({"left_row": "a", "right_row": "b"})
    # an exact check of what the alignment let through: the ids are hashed in the text
    return pairs.where("a.user_id = b.user_id and a.item = b.item and abs(a.label - b.label) <= 0.5")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _split_overlaps(spark, sf_dir)
    return pairs.select(F.least("left_id", "right_id").alias("row_a"), F.greatest("left_id", "right_id").alias("row_b"))


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each overlapping held-out row with its source, its partners in train and the most of it that one of them covers."""
    rows = _split_overlaps(spark, sf_dir).groupBy("right_id", "b.split", "b.feed").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.max((F.col("a.label") == F.col("b.label")).cast("int")).alias("same"), F.round(F.max("coverage"), 6).alias("coverage")
    )
    return rows.withColumnRenamed("right_id", "row_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rows of each held-out split and feed, how many of them are the same, and their mean coverage."""
    rows = p6_coverage(spark, sf_dir)
    return rows.groupBy("split", "feed").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_pairs").alias("n_pairs"), F.sum("same").alias("n_same"), F.round(F.avg("coverage"), 4).alias("mean_coverage")
    )


# ---- p7: most frequent values


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings, runs = table(spark, sf_dir, "ratings"), table(spark, sf_dir, "old_info")
    a = frequent_values(ratings, "item", 15, "user_id").withColumn("field_name", F.lit("ratings_item"))
    b = frequent_elements(runs, "popular_items", 12, "run_id").withColumn("field_name", F.lit("popular_items"))
    return a.unionByName(b).withColumnRenamed("value", "item")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("field_name", "item")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("field_name", "item", "n")


# ---- p8: evaluation texts in the corpus


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_passages"), "passage_id", "text", 20)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("passage_id", "doc_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked passages with suite, longest match and its places."""
    suites = table(spark, sf_dir, "eval_passages").select("passage_id", "suite")
    return _leaks(spark, sf_dir).join(suites, "passage_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no passage, by source."""
    left = without_leaks(table(spark, sf_dir, "documents"), "doc_id", _leaks(spark, sf_dir))
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))


# ---- p9: a mix of sources


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))[1]


# ---- p10: subject areas


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, areas, labels = (table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels"))
    return document_subjects(docs, "doc_id", "text", "lang", areas, "subject", labels, "doc_id", "subject")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of each subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_about").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p3_found, p3_ranked, p4_found, p4_lift, p5_found, p5_recall, p6_found, p6_coverage, p6_report, p7_found, p7_counts, p8_found, p8_matches, p8_clean, p9_mix, p9_shares, p10_found, p10_composition)}

_ASK = r"""
with ask as (
  select distinct request_id, try_cast(trim(user_key, e' \t\n\r\f') as bigint) as entity, n_rec from rec_requests
  where n_rec >= 1 and regexp_full_match(trim(user_key, e' \t\n\r\f'), '[0-9]+')),
best as (
  select entity, neighbor, max(sim) as sim from k_sims
  where sim is not null and not isnan(sim) and entity <> neighbor group by entity, neighbor),
ranked as (select *, row_number() over (partition by entity order by sim desc, neighbor) as rank from best)
"""

_LISTS = """
with src as (
  select 'item' as kind, 'u' || user_id as list, items as m, row_number() over (partition by user_id order by export_id desc) as v
  from user_consumed where user_id is not null
  union all
  select 'user', 'i' || item || '_' || chunk_no, users, row_number() over (partition by item, chunk_no order by export_id desc)
  from item_consumed where item is not null and chunk_no is not null),
e as (select distinct kind, list, x from (select kind, list, unnest(m) as x from src where v = 1) where x is not null),
n as (select kind, count(distinct list) as n from e group by kind),
c as (select kind, x, count(*) as n_x from e group by kind, x),
p as (select a.kind, a.x as a_id, b.x as b_id, count(*) as n_ab from e a join e b on a.kind = b.kind and a.list = b.list and a.x < b.x
      group by a.kind, a.x, b.x having count(*) >= 5),
f as (select p.*, ca.n_x as n_a, cb.n_x as n_b, n.n from p join n using (kind)
      join c ca on ca.kind = p.kind and ca.x = a_id join c cb on cb.kind = p.kind and cb.x = b_id)
"""

_VECTORS = """
with u as (select user_id, user_embed, trained_at, list_transform(user_embed, lambda x: x::double) as v from user_embeds
  where user_id is not null and len(user_embed) = 48 and len(list_filter(user_embed, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(user_embed, lambda x: x <> 0)) > 0),
l as (select user_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from u qualify row_number() over (partition by user_id order by trained_at desc nulls last) = 1),
c as (select a.user_id as a, b.user_id as b, list_dot_product(a.v, b.v) / (a.n * b.n) as cos from l a join l b on a.user_id <> b.user_id),
t as (select * from c where cos >= 0.9 qualify row_number() over (partition by a order by cos desc, b) <= 5)
select distinct least(a, b) as user_a, greatest(a, b) as user_b from t
"""

_SPLITS = """
with r as (select row_id, user_id, item, label, feed, lower(trim(split_name)) as split from split_ratings where label is not null),
p as (select a.row_id as t, b.row_id as h, b.split, b.feed, a.label = b.label as same, printf('%.1f', a.label) as x, printf('%.1f', b.label) as y
      from r a join r b on a.user_id = b.user_id and a.item = b.item and abs(a.label - b.label) <= 0.5
      where a.split = 'train' and b.split in ('eval', 'test')),
c as (select h as row_id, split, feed, count(*) as n_pairs, max(same::int) as same,
        round(max(1 - levenshtein(x, y)::double / (32 + greatest(length(x), length(y)))), 6) as coverage from p group by h, split, feed)
"""

_TOP = """
with a as (select 'ratings_item' as field_name, item, count(distinct user_id) as n from ratings
           where item is not null and user_id is not null group by item order by n desc, item limit 15),
b as (select 'popular_items' as field_name, x as item, count(distinct run_id) as n
      from (select run_id, unnest(popular_items) as x from old_info) where x is not null and run_id is not null
      group by x order by n desc, x limit 12),
f as (select * from a union all select * from b)
"""

ORACLE = {
    "p3_found": _ASK + "select distinct request_id, neighbor from ask join ranked using (entity) where rank <= n_rec",
    "p3_ranked": _ASK + """select entity, neighbor, rank, round(sim, 9) as sim
        from ranked join (select entity, max(n_rec) as n from ask group by entity) using (entity) where rank <= n""",
    "p4_found": _LISTS + "select kind, a_id, b_id from f where n_ab * n >= 6 * n_a * n_b",
    "p4_lift": _LISTS + """select kind, a_id, b_id, n_ab, round(n_ab::double * n / (n_a * n_b), 6) as lift
        from f where n_ab * n >= 6 * n_a * n_b""",
    "p5_found": _VECTORS,
    "p6_found": _SPLITS + "select least(t, h) as row_a, greatest(t, h) as row_b from p",
    "p6_coverage": _SPLITS + "select row_id, split, feed, n_pairs, same, coverage from c",
    "p6_report": _SPLITS + """select split, feed, count(*) as n_rows, cast(sum(n_pairs) as bigint) as n_pairs, cast(sum(same) as bigint) as n_same,
        round(avg(coverage), 4) as mean_coverage from c group by split, feed""",
    "p7_found": _TOP + "select field_name, item from f",
    "p7_counts": _TOP + "select field_name, item, n from f",
}
