"""Queries of similarity, ranking, metrics, embeddings, graphs and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import arrays
from rillstone.operators import graph, knn, metrics, ranking, serving, similarity, split, stats
from rillstone.operators.ordering import top_k
from rillstone.plans.data import chrono_split, distinct_last, lists
from rillstone.plans.interactions import SQL_D, SQL_I, SQL_LISTS, SQL_SPLIT, interactions, table
from rillstone.session import materialize

K, N = 20, 10
#: Users whose lists the serving queries ask for: all that made a request.
DIM = 64


def item_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarities(distinct_last(spark, sf_dir), "item", "user", "label")


def _top(pairs: DataFrame, k: int = K) -> DataFrame:
    return similarity.neighbors(pairs, k, 6).select("entity", "neighbor", "rank", "sim")


def _near(spark, sf_dir, entity: str, key: str, kind: str, least: int = 1):
    near = similarity.top_neighbors(distinct_last(spark, sf_dir), entity, key, "label", kind, K, least, 6)
    return near.select("entity", "neighbor", "rank", "sim")


def item_cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir, "item", "user", "cosine")


def user_cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir, "user", "item", "cosine")


def item_pearson(spark, sf_dir):
    return _near(spark, sf_dir, "item", "user", "pearson", 2)


def item_jaccard(spark, sf_dir):
    return _near(spark, sf_dir, "item", "user", "jaccard")


def min_common_pairs(spark, sf_dir):
    return similarity.similarities(distinct_last(spark, sf_dir), "item", "user", "label", "cosine", 3).select("a", "b", "common")


def item_matrix_density(spark, sf_dir):
    i = distinct_last(spark, sf_dir)
    n = i.agg(F.count_distinct("item")).first()[0]
    return similarity.density(similarity.similarities(i, "item", "user", "label"), n).select(F.round("density", 6).alias("density"))


def itemcf_recommend(spark, sf_dir):
    m = similarity.CfModel(distinct_last(spark, sf_dir), "user", "item", "item", "jaccard", K)
    return m.recommend(m.history, N).select("user", "item", "rank", "score")


def usercf_recommend(spark, sf_dir):
    m = similarity.CfModel(distinct_last(spark, sf_dir), "user", "item", "user", "jaccard", K)
    return m.recommend(m.history, N).select("user", "item", "rank", "score")


def itemcf_predict(spark, sf_dir):
    from rillstone.operators.features import drop_duplicates_last
    from rillstone.session import sweep

    # the last row of each pair and fold, written once; rows stand by user already
    s = drop_duplicates_last(chrono_split(spark, sf_dir), ["user", "item", "fold"], ["time", "k1", "k2", "k3", "k4"])
    s = materialize(s.select("user", "item", "fold", "label"), "folds")
    sweep(spark)
    m = similarity.CfModel(s.where("fold = 0").drop("fold"), "user", "item", "item", "jaccard", K, task="rating")
    ask = s.where("fold = 1").select("user", "item")
    return m.predict(ask, 3.0).select("user", "item", F.round("pred", 6).alias("pred"))


def _swing(spark, sf_dir):
    return similarity.swing(interactions(spark, sf_dir), "user", "item")


def swing_topk(spark, sf_dir):
    return _top(_swing(spark, sf_dir))


def swing_recommend(spark, sf_dir):
    i = distinct_last(spark, sf_dir)
    near = similarity.neighbors(_swing(spark, sf_dir), K, 6)
    scores = similarity.item_cf_scores(i, i, near, "user", "item").join(i.select("user", "item"), ["user", "item"], "left_anti")
    recs = top_k(scores.withColumn("score", F.round("score", 6)), ["user"], [F.desc("score"), F.asc("item")], N)
    popular = stats.popular_items(interactions(spark, sf_dir), "user", "item", 2 * N)
    from rillstone.operators.ordering import global_rank

    defaults = global_rank(popular, [F.desc("n_users"), F.asc("item")], "r").select("item", (F.col("r") + 1).alias("rank"))
    return ranking.fill_up(recs, "user", "item", defaults, N)


def incremental_cosine(spark, sf_dir):
    """State of the first fold updated by the second equals the state of both."""
    d = distinct_last(spark, sf_dir)
    old, new = materialize(d.where("k1 % 5 <> 0"), "old"), materialize(d.where("k1 % 5 = 0"), "new")
    pairs = similarity.pair_sums(old, "item", "user", "label")
    norms = old.groupBy(F.col("item").alias("entity")).agg(F.sum(F.col("label").cast("double") * F.col("label")).alias("sq"))
    pairs, norms = similarity.update_cosine(pairs, norms, old, new, "item", "user", "label")
    return similarity.cosine_from_state(pairs, norms).select("a", "b", F.round("sim", 6).alias("sim"), "common")


def two_hop_edges(spark, sf_dir):
    return graph.two_hop_edges(interactions(spark, sf_dir), "user", "item")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def knn_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    out = knn.blocked_top_k(v, v, "vec_id", "vec_id", "embedding", 10)
    return out.select("q", "i", "rank", F.round("score", 6).alias("score"))


def knn_inner_product(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    out = knn.blocked_top_k(v, v, "vec_id", "vec_id", "embedding", 10, "inner-product")
    return out.select("q", "i", "rank", F.round("score", 6).alias("score"))


def embed_predict(spark, sf_dir):
    """Inner products of customer and part vectors for all order lines."""
    v = _vectors(spark, sf_dir)
    i = interactions(spark, sf_dir).select("user", "item").distinct()
    u, p = v.withColumnsRenamed({"vec_id": "user", "embedding": "v"}), v.withColumnsRenamed({"vec_id": "item", "embedding": "v"})
    return knn.predict_pairs(i, u, p, "user", "item").select("user", "item", F.round("score", 6).alias("score"))


def embed_recommend(spark, sf_dir):
    """Users and items by the vectors of their number; consumed items left out."""
    v = _vectors(spark, sf_dir)
    n = v.count()
    seen = interactions(spark, sf_dir).where(f"user < {n} and item < {n}").select("user", "item").distinct()
    most = seen.groupBy("user").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    scores = knn.blocked_top_k(v, v, "vec_id", "vec_id", "embedding", int(most) + N, "inner-product").select(F.col("q").alias("user"), F.col("i").alias("item"), "score")
    recs = ranking.recommend_top_n(scores, "user", "item", seen, N, n)
    return recs.select("user", "item", "rank", F.round("score", 6).alias("score"))


def ivf_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn.IvfIndex(v, "vec_id", "embedding").search(v, "vec_id", "embedding", 10).select("q", "i", "rank")


def ivf_recall(spark, sf_dir):
    """Recall of ``ivf_knn`` against brute force: vectors divisible by 20 against all."""
    v = _vectors(spark, sf_dir)
    exact = knn.blocked_top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "vec_id", "embedding", 10, "inner-product").select("q", "i")
    both = exact.join(ivf_knn(spark, sf_dir).select("q", "i", F.lit(1).alias("hit")), ["q", "i"], "left")
    out = both.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.try_divide(F.col("n_found").cast("double"), "n_exact"))


def normalized_embeddings(spark, sf_dir):
    out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.normalize("embedding")).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def lightgcn_propagate(spark, sf_dir):
    """One layer over customers and parts, vectors of 4 derived from ids."""
    i = interactions(spark, sf_dir).select((F.col("user") * 2).alias("u"), (F.col("item") * 2 + 1).alias("i")).distinct()
    edges = i.select(F.col("u").alias("src"), F.col("i").alias("dst")).unionByName(i.select(F.col("i").alias("src"), F.col("u").alias("dst")))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    vec = nodes.select("node", F.array(*[(F.pmod(F.col("node") * (7 + j), F.lit(101)) / 101.0).cast("double") for j in range(4)]).alias("vec"))
    out = graph.lightgcn(edges, vec, "node", "vec", 4, 2)
    return out.select("node", *[F.round(F.get("vec", F.lit(j)), 6).alias(f"x{j}") for j in range(4)])


def random_walk_pairs(spark, sf_dir):
    i = interactions(spark, sf_dir).select("user", "item").distinct()
    iu, ui = graph.adjacency(i, "item", "user"), graph.adjacency(i, "user", "item")
    return graph.bipartite_walk_pairs(i.select("item").distinct(), "item", iu, ui, 2, 2)


def deepwalk_walks(spark, sf_dir):
    from rillstone.operators.history import consecutive_edges
    from rillstone.plans.interactions import ORDER

    e = consecutive_edges(interactions(spark, sf_dir), "user", "item", ORDER)
    adj = graph.adjacency(e.withColumn("dst", F.explode(F.array_repeat("dst", F.col("weight").cast("int")))), "src", "dst")
    return graph.random_walks(e.select("src").distinct(), "src", adj, 2, 4)


def pinsage_neighbors(spark, sf_dir):
    i = interactions(spark, sf_dir).select("user", "item").distinct()
    iu, ui = graph.adjacency(i, "item", "user"), graph.adjacency(i, "user", "item")
    return graph.weighted_neighbors(graph.bipartite_walk_pairs(i.select("item").distinct(), "item", iu, ui, 6, 2, True), 3)


# ---- metrics over a fixed scoring of the order lines


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir)
    score = F.pmod(F.col("user") * 7919 + F.col("item") * 104729 + F.col("label") * 13, F.lit(1000)).cast("double")
    return i.select("user", "item", "label", (F.col("label") >= 4).cast("int").alias("y"), ((score + 1) / 1002).alias("p"), (1 + score / 250).alias("stars"))


def rmse_mae_r2(spark, sf_dir):
    m = metrics.rating_metrics(scored(spark, sf_dir), "label", "stars")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def log_loss(spark, sf_dir):
    return metrics.log_loss(scored(spark, sf_dir), "y", "p").select(F.round("log_loss", 6).alias("log_loss"))


def balanced_accuracy(spark, sf_dir):
    return metrics.balanced_accuracy(scored(spark, sf_dir), "y", "p").select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), "y", "p").select(F.round("roc_auc", 6).alias("roc_auc"))


def gauc(spark, sf_dir):
    return metrics.roc_gauc(scored(spark, sf_dir), "user", "y", "p").select(F.round("roc_gauc", 6).alias("roc_gauc"))


def pr_auc(spark, sf_dir):
    return metrics.pr_auc(scored(spark, sf_dir), "y", "p").select(F.round("pr_auc", 6).alias("pr_auc"))


def losses(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("z", F.col("p") * 4 - 2)
    y = F.col("y").cast("double")
    return s.agg(F.round(F.avg(arrays.bce_loss(F.col("z"), y)), 6).alias("bce"), F.round(F.avg(arrays.focal_loss(F.col("z"), y)), 6).alias("focal"), F.round(F.avg(arrays.bpr_loss(F.col("z"), F.col("p"))), 6).alias("bpr"))


def _lists(spark, sf_dir):
    """Ten items of each user by a fixed score, and the held-out rows."""
    s = chrono_split(spark, sf_dir)
    score = F.pmod(F.col("user") * 7919 + F.col("item") * 104729, F.lit(1009)).cast("double")
    recs = top_k(s.select("user", "item").distinct().withColumn("score", score), ["user"], [F.desc("score"), F.asc("item")], N)
    return recs, s.where("fold = 1")


def list_metrics_at_k(spark, sf_dir):
    recs, truth = _lists(spark, sf_dir)
    m = metrics.list_metrics(recs, truth, "user", "item", N)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def user_metrics_at_k(spark, sf_dir):
    recs, truth = _lists(spark, sf_dir)
    m = metrics.user_list_metrics(recs, truth, "user", "item", N)
    return m.select("user", "n_hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "map", "ndcg")])


def coverage(spark, sf_dir):
    recs, _ = _lists(spark, sf_dir)
    n = interactions(spark, sf_dir).agg(F.count_distinct("item")).first()[0]
    return metrics.coverage(recs, "item", n).select(F.round("coverage", 6).alias("coverage"))


# ---- serving


def _serve(spark, sf_dir, by):
    d = distinct_last(spark, sf_dir)
    entity, key = ("item", "user") if by == "item" else ("user", "item")
    near = materialize(similarity.top_neighbors(d, entity, key, "label", "jaccard", K, digits=6), "near")
    asks = d.select("user").distinct().withColumn("n_rec", (F.col("user") % 7 + 1).cast("int"))
    return serving.serve_knn(asks, "user", "n_rec", d, "item", near, by).select("user", "item", "rank", "score")


def serve_knn_item(spark, sf_dir):
    return _serve(spark, sf_dir, "item")


def serve_knn_user(spark, sf_dir):
    return _serve(spark, sf_dir, "user")


def kv_export(spark, sf_dir):
    return serving.kv_table(lists(spark, sf_dir), "user_consumed", "user", F.col("items"))


def request_payloads(spark, sf_dir):
    """Requests as JSON payloads, parsed and validated, counted by outcome."""
    r = table(spark, sf_dir, "rec_requests")
    raw = r.select(F.to_json(F.struct(F.when(F.trim("user_key") != "", F.col("user_key")).alias("user"), "n_rec", "user_feats", "seq")).alias("value"))
    return serving.parse_requests(raw).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def cold_start_popular(spark, sf_dir):
    """Popular items for requests of users without neighbours."""
    from rillstone.operators.ordering import global_rank

    users = table(spark, sf_dir, "rec_requests").select(F.expr("try_cast(user_key as int)").alias("user")).dropna().distinct()
    unknown = users.join(table(spark, sf_dir, "k_sims").select(F.col("entity").alias("user")).distinct(), "user", "left_anti")
    head = global_rank(stats.popular_items(table(spark, sf_dir, "ratings"), "user_id", "item", 5), [F.desc("n_users"), F.asc("item")], "r")
    return ranking.cold_start(unknown, "user", "item", head.select("item", (F.col("r") + 1).alias("rank")), 5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological split, item neighbours of the training part, top ten, metrics on the rest."""
    from rillstone.operators.features import drop_duplicates_last

    s = materialize(chrono_split(spark, sf_dir), "split")
    train = drop_duplicates_last(s.where("fold = 0").drop("fold"), ["user", "item"], ["time", "k1", "k2", "k3", "k4"])
    held = split.filter_unknown(s.where("fold = 1"), train, ["user", "item"])
    m = similarity.CfModel(train, "user", "item", "item", "cosine", K)
    recs = m.recommend(held, N)
    out = metrics.list_metrics(recs, held, "user", "item", N)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


QUERIES = {
    f.__name__: f
    for f in (
        flagship, item_cosine_topk, user_cosine_topk, item_pearson, item_jaccard, min_common_pairs, item_matrix_density, itemcf_recommend, usercf_recommend,
        itemcf_predict, swing_topk, swing_recommend, incremental_cosine, two_hop_edges, knn_cosine, knn_inner_product, embed_predict, embed_recommend, ivf_knn, ivf_recall,
        normalized_embeddings, lightgcn_propagate, random_walk_pairs, deepwalk_walks, pinsage_neighbors, rmse_mae_r2, log_loss, balanced_accuracy, roc_auc, gauc,
        pr_auc, losses, list_metrics_at_k, user_metrics_at_k, coverage, serve_knn_item, serve_knn_user, kv_export, request_payloads, cold_start_popular,
    )
}


def _sims(entity: str, key: str, src: str = SQL_D, rows: str = "d", least: int = 1, kind: str = "cosine", name: str = "p") -> str:
    """CTEs up to ``p(a, b, sim, common)``."""
    value = f'label - avg(label) over (partition by "{entity}")' if kind == "pearson" else "label::double"
    size = "count(*)::double" if kind == "jaccard" else "sqrt(sum(x * x))"
    sim = "common / (na.n + nb.n - common)" if kind == "jaccard" else "coalesce(dot / nullif(na.n * nb.n, 0), 0)"
    return f"""{src},
        r as (select "{entity}" as e, "{key}" as k, {value} as x from {rows}), nn as (select e, {size} as n from r group by e),
        p0 as (select r1.e as a, r2.e as b, sum(r1.x * r2.x) as dot, count(*) as common from r r1 join r r2 on r1.k = r2.k and r1.e < r2.e
               group by r1.e, r2.e having count(*) >= {least}),
        {name} as (select a, b, {sim} as sim, common from p0 join nn na on na.e = a join nn nb on nb.e = b)"""


_TOP = """, t as (select a as entity, b as neighbor, round(sim, 6) as sim from p union all select b, a, round(sim, 6) from p),
    near as (select *, row_number() over (partition by entity order by sim desc, neighbor) as rank from t qualify rank <= 20)"""
#: neighbours ranked by similarity rounded to nine digits, as the model does
_TOP9 = _TOP.replace("round(sim, 6)", "round(sim, 9)")
_NEAR = "select entity, neighbor, rank, sim from near"
_SWING = SQL_I + """,
    r as (select distinct "user" as u, item as i from i0), w as (select u, 1 / sqrt(count(*)) as w from r group by u),
    q as (select a.u, b.u as v, count(*) as k from r a join r b on a.i = b.i and a.u < b.u group by a.u, b.u having count(*) > 1),
    c as (select q.u, q.v, wa.w * wb.w / (1.0::double + k - 1) as s, ra.i from q join w wa on wa.u = q.u join w wb on wb.u = q.v
          join r ra on ra.u = q.u join r rb on rb.u = q.v and rb.i = ra.i),
    p as (select c1.i as a, c2.i as b, sum(c1.s) as sim from c c1 join c c2 on c1.u = c2.u and c1.v = c2.v and c1.i < c2.i group by c1.i, c2.i)"""
_SCORED = SQL_I + """,
    s as (select *, (label >= 4)::int as y, z / 1002 as p, 1 + (z - 1) / 250 as stars from (
            select *, (("user" * 7919 + item * 104729 + label * 13) % 1000)::double + 1 as z from i0))"""
_AUC = _SCORED + """,
    m as (select "user", y, p, rank() over ({w} order by p) + (count(*) over ({w2} p) - 1) / 2.0::double as mid from s)"""
_RECS = SQL_SPLIT + """,
    c as (select distinct "user", item, ("user" * 7919 + item * 104729) % 1009 as score from s),
    rec as (select *, row_number() over (partition by "user" order by score desc, item) as rank from c qualify rank <= 10),
    pos as (select distinct "user", item from s where fold = 1), size as (select "user", count(*) as n from pos group by "user"),
    h as (select rec."user", rank, (pos.item is not null)::int as hit from rec left join pos on pos."user" = rec."user" and pos.item = rec.item),
    h2 as (select *, sum(hit) over (partition by "user" order by rank) as upto from h),
    m as (select h2."user", cast(sum(hit) as bigint) as n_hits, sum(hit) / 10.0::double as precision, sum(hit)::double / max(n) as recall,
            coalesce(sum(case when hit = 1 then upto::double / rank end) / nullif(sum(hit), 0), 0) as map,
            coalesce(sum(case when hit = 1 then 1 / log2(rank + 1) end) / nullif(sum(case when hit = 1 then 1 / log2(upto + 1) end), 0), 0) as ndcg
          from h2 join size using ("user") group by h2."user")"""
_ITEM_SCORES = """,
    sc as (select d."user", neighbor as item, sum(sim * {v}) as score from d join near on near.entity = d.item where sim > 0 group by d."user", neighbor)"""
_USER_SCORES = """,
    sc as (select near.entity as "user", d.item, sum(sim * {v}) as score from near join d on d."user" = near.neighbor where sim > 0 group by near.entity, d.item)"""
_REC_OUT = """, o as (select sc."user", sc.item, round(sc.score, 9) as score, row_number() over (partition by sc."user" order by round(sc.score, 9) desc, sc.item) as rank
    from sc left join d on d."user" = sc."user" and d.item = sc.item where d.item is null)
    select "user", item, rank, score from o """
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::double * x[2]::double))"


def _knn(kind: str) -> str:
    s = _DOT.format("a.embedding", "b.embedding")
    if kind == "cosine":
        s = f"({s}) / (a.n * b.n)"
    return f"""v as (select vec_id, embedding, sqrt({_DOT.format('embedding', 'embedding')}) as n from embeddings),
        k as (select a.vec_id as q, b.vec_id as i, round({s}, 9) as score from v a cross join v b)"""


_TRAIN = SQL_SPLIT + """,
    d as (select "user", item, label from (select *, row_number() over (partition by "user", item order by time desc, k1 desc, k2 desc, k3 desc, k4 desc) as rn
          from s where fold = 0) where rn = 1)"""

ORACLE = {
    "flagship": f"""with {_sims('item', 'user', src=_TRAIN)}{_TOP9}{_ITEM_SCORES.format(v='label')},
        held as (select distinct "user", item from s where fold = 1 and "user" in (select "user" from d) and item in (select item from d)),
        rec as (select sc."user", sc.item, row_number() over (partition by sc."user" order by round(sc.score, 9) desc, sc.item) as rank
                from sc left join d on d."user" = sc."user" and d.item = sc.item where d.item is null and sc."user" in (select "user" from held) qualify rank <= 10),
        size as (select "user", count(*) as n from held group by "user"),
        h as (select rec."user", rank, (held.item is not null)::int as hit from rec left join held on held."user" = rec."user" and held.item = rec.item),
        h2 as (select *, sum(hit) over (partition by "user" order by rank) as upto from h),
        m as (select sum(hit) / 10.0::double as precision, sum(hit)::double / max(n) as recall,
                coalesce(sum(case when hit = 1 then upto::double / rank end) / nullif(sum(hit), 0), 0) as map,
                coalesce(sum(case when hit = 1 then 1 / log2(rank + 1) end) / nullif(sum(case when hit = 1 then 1 / log2(upto + 1) end), 0), 0) as ndcg
              from h2 join size using ("user") group by h2."user")
        select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(map), 6) as map, round(avg(ndcg), 6) as ndcg from m""",
    "item_cosine_topk": f"with {_sims('item', 'user')}{_TOP} {_NEAR}",
    "user_cosine_topk": f"with {_sims('user', 'item')}{_TOP} {_NEAR}",
    "item_pearson": f"with {_sims('item', 'user', least=2, kind='pearson')}{_TOP} {_NEAR}",
    "item_jaccard": f"with {_sims('item', 'user', kind='jaccard')}{_TOP} {_NEAR}",
    "min_common_pairs": f"with {_sims('item', 'user', least=3)} select a, b, common from p",
    "item_matrix_density": f"with {_sims('item', 'user')} select round(200.0::double * (select count(*) from p) / pow((select count(distinct item) from d), 2), 6) as density",
    "itemcf_recommend": f"with {_sims('item', 'user', kind='jaccard')}{_TOP9}{_ITEM_SCORES.format(v='label')}{_REC_OUT} where rank <= 10",
    "usercf_recommend": f"with {_sims('user', 'item', kind='jaccard')}{_TOP9}{_USER_SCORES.format(v='label')}{_REC_OUT} where rank <= 10",
    "itemcf_predict": f"""with {_sims('item', 'user', kind='jaccard', rows='d', src=_TRAIN)},
        q as (select distinct "user", item from s where fold = 1), t as (select a as entity, b as neighbor, sim from p union all select b, a, sim from p),
        h as (select q."user", q.item, sim, label, row_number() over (partition by q."user", q.item order by sim desc, neighbor) as rn
              from q join t on t.entity = q.item join d on d."user" = q."user" and d.item = t.neighbor where sim > 0),
        g as (select "user", item, least(greatest(sum(sim * label) / sum(sim), 1), 5) as pred from h where rn <= 20 group by "user", item)
        select q."user", q.item, round(coalesce(pred, 3.0::double), 6) as pred from q left join g on g."user" = q."user" and g.item = q.item""",
    "swing_topk": f"with {_SWING}{_TOP} {_NEAR}",
    "swing_recommend": f"""with {_SWING}{_TOP}, d as (select "user", item, label from ({'with ' + SQL_D + ' select * from d'}))
        {_ITEM_SCORES.format(v='label')},
        a as (select sc."user", sc.item, row_number() over (partition by sc."user" order by round(sc.score, 6) desc, sc.item) as rank
              from sc left join d on d."user" = sc."user" and d.item = sc.item where d.item is null qualify rank <= 10),
        pop as (select item, row_number() over (order by count(distinct "user") desc, item) as r from i0 group by item qualify r <= 20),
        f as (select "user", item, 0 as g, rank as r from a union all
              select x."user", pop.item, 1, r from (select "user" from a group by "user" having count(*) < 10) x cross join pop
              where not exists (select 1 from a where a."user" = x."user" and a.item = pop.item))
        select "user", item, row_number() over (partition by "user" order by g, r) as rank from f qualify rank <= 10""",
    "incremental_cosine": f"with {_sims('item', 'user')} select a, b, round(sim, 6) as sim, common from p",
    "two_hop_edges": f"""with {SQL_I}, e as (select distinct "user" as u, item as i from i0)
        select x.i as src, y.i as dst, count(*) as weight from e x join e y on x.u = y.u and x.i <> y.i group by x.i, y.i""",
    "knn_cosine": f"with {_knn('cosine')} select q, i, row_number() over (partition by q order by score desc, i) as rank, round(score, 6) as score from k qualify rank <= 10",
    "knn_inner_product": f"with {_knn('ip')} select q, i, row_number() over (partition by q order by score desc, i) as rank, round(score, 6) as score from k qualify rank <= 10",
    "embed_predict": f"""with {SQL_I}, e as (select distinct "user", item from i0)
        select "user", item, round({_DOT.format('a.embedding', 'b.embedding')}, 6) as score from e join embeddings a on a.vec_id = "user" join embeddings b on b.vec_id = item""",
    "embed_recommend": f"""with {SQL_I}, {_knn('ip')}, e as (select distinct "user", item from i0 where "user" in (select vec_id from embeddings) and item in (select vec_id from embeddings)),
        c as (select "user", count(*) as n from e group by "user" having count(*) + 10 <= (select count(*) from embeddings)),
        f as (select q, i, score from k where not exists (select 1 from e join c using ("user") where e."user" = q and e.item = i))
        select q as "user", i as item, row_number() over (partition by q order by score desc, i) as rank, round(score, 6) as score from f qualify rank <= 10""",
    "normalized_embeddings": f"""with n as (select vec_id, embedding, sqrt({_DOT.format('embedding', 'embedding')}) as n from embeddings)
        select vec_id, unnest(range(len(embedding))) as pos, round(unnest(embedding)::double / n, 6) as x from n""",
    "lightgcn_propagate": f"""with {SQL_I}, i as (select distinct "user" * 2 as u, item * 2 + 1 as i from i0),
        e as (select u as src, i as dst from i union all select i, u from i), g as (select src, count(*) as n from e group by src),
        w as (select e.src, e.dst, 1 / sqrt(a.n * b.n) as w from e join g a on a.src = e.src join g b on b.src = e.dst),
        l0 as (select src as node, {', '.join(f'((src * {7 + j}) % 101) / 101.0::double as x{j}' for j in range(4))} from g),
        l1 as (select dst as node, {', '.join(f'sum(w * x{j}) as x{j}' for j in range(4))} from w join l0 on l0.node = src group by dst),
        l2 as (select dst as node, {', '.join(f'sum(w * x{j}) as x{j}' for j in range(4))} from w join l1 on l1.node = src group by dst)
        select l0.node, {', '.join(f'round((l0.x{j} + l1.x{j} + l2.x{j}) / 3, 6) as x{j}' for j in range(4))} from l0 join l1 using (node) join l2 using (node)""",
    "rmse_mae_r2": f"""with {_SCORED} select round(sqrt(avg(pow(label - stars, 2))), 6) as rmse, round(avg(abs(label - stars)), 6) as mae,
        round(1 - sum(pow(label - stars, 2)) / (var_pop(label) * count(*)), 6) as r2 from s""",
    "log_loss": f"with {_SCORED} select round(avg(-case when y > 0 then ln(p) else ln(1 - p) end), 6) as log_loss from s",
    "balanced_accuracy": f"""with {_SCORED} select round((avg((p > 0.5)::int) filter (y = 1) + avg((p <= 0.5)::int) filter (y = 0)) / 2, 6) as balanced_accuracy from s""",
    "roc_auc": f"""with {_AUC.format(w='', w2='partition by')} select round((sum(mid) filter (y = 1) - sum(y)::double * (sum(y) + 1) / 2) / (sum(y)::double * sum(1 - y)), 6) as roc_auc from m""",
    "gauc": f"""with {_AUC.format(w='partition by "user"', w2='partition by "user",')},
        g as (select count(*) as n, coalesce((sum(mid) filter (y = 1) - sum(y)::double * (sum(y) + 1) / 2) / nullif(sum(y)::double * sum(1 - y), 0), 0) as a from m group by "user")
        select round(sum(a * n) / sum(n), 6) as roc_gauc from g""",
    "pr_auc": f"""with {_SCORED}, g as (select p, sum(y) as pos, count(*) as n from s group by p),
        c as (select p, sum(pos) over (order by p desc) as tp, sum(n) over (order by p desc) as seen, (select sum(y) from s)::double as np from g),
        e as (select tp / np as r, tp::double / seen as pr, lag(tp / np, 1, 0) over (order by p desc) as r0, lag(tp::double / seen, 1, 1) over (order by p desc) as pr0 from c)
        select round(sum((r - r0) * (pr + pr0) / 2), 6) as pr_auc from e""",
    "losses": f"""with {_SCORED}, z as (select y, p, p * 4 - 2 as z from s), b as (select *, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) as bce, 1 / (1 + exp(-z)) as q from z)
        select round(avg(bce), 6) as bce, round(avg(case when y = 1 then 0.25 * pow(1 - q, 2) else 0.75 * pow(q, 2) end * bce), 6) as focal,
        round(avg(ln(1 + exp(p - z))), 6) as bpr from b""",
    "list_metrics_at_k": f"with {_RECS} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(map), 6) as map, round(avg(ndcg), 6) as ndcg from m",
    "user_metrics_at_k": f"""with {_RECS} select "user", n_hits, round(precision, 6) as precision, round(recall, 6) as recall, round(map, 6) as map, round(ndcg, 6) as ndcg from m""",
    "coverage": f"with {_RECS} select round(100.0::double * (select count(distinct item) from rec) / (select count(distinct item) from i0), 6) as coverage",
    "serve_knn_item": f"""with {_sims('item', 'user', kind='jaccard')}{_TOP}{_ITEM_SCORES.format(v='1')}{_REC_OUT} where rank <= "user" % 7 + 1""",
    "serve_knn_user": f"""with {_sims('user', 'item', kind='jaccard')}{_TOP}{_USER_SCORES.format(v='1')}{_REC_OUT} where rank <= "user" % 7 + 1""",
    "kv_export": f"""with {SQL_LISTS} select 'user_consumed' as ns, "user"::varchar as key, '[' || array_to_string(items, ',') || ']' as value from l""",
    "request_payloads": """select case when trim(user_key) = '' or user_key is null then 'no user' when n_rec is null or n_rec < 1 then 'bad n_rec' end as error, count(*) as n
        from rec_requests group by 1""",
    "cold_start_popular": """with u as (select distinct try_cast(user_key as int) as "user" from rec_requests where try_cast(user_key as int) is not null),
        p as (select item, row_number() over (order by count(distinct user_id) desc, item) as rank from ratings where item is not null and user_id is not null group by item qualify rank <= 5)
        select "user", item, rank from u cross join p where "user" not in (select entity from k_sims where entity is not null)""",
}
