"""Recommendation and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import recommend
from mnemospark.operators.windows import top_per_key
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import INTERACTIONS, TASTE, interactions, taste


def _top(df, k=5, digits=6):
    return top_per_key(df.withColumn("score", F.round("score", digits)), ["user_id"], [F.desc("score"), F.asc("item_id")], k)


_COS = """n AS (SELECT user_id, sqrt(sum(rating * rating)) AS norm FROM i GROUP BY 1),
s AS (SELECT a.user_id AS a, b.user_id AS b, round(sum(a.rating * b.rating) / (any_value(x.norm) * any_value(y.norm)), 9) AS sim
  FROM i a JOIN i b ON a.item_id = b.item_id AND a.user_id <> b.user_id JOIN n x ON x.user_id = a.user_id JOIN n y ON y.user_id = b.user_id GROUP BY 1, 2)"""
_PEAR = "s AS (SELECT * FROM (SELECT a.user_id AS a, b.user_id AS b, round(CASE WHEN isnan(corr(a.rating, b.rating)) THEN 0 ELSE coalesce(corr(a.rating, b.rating), 0) END, 9) AS sim, count(*) AS n FROM i a JOIN i b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2) WHERE n >= 2)"
_UCF = """k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s WHERE sim > 0),
u AS (SELECT a AS user_id, item_id, sum(sim * rating) AS score FROM k JOIN i ON i.user_id = k.b WHERE rn <= 20 GROUP BY 1, 2),
un AS (SELECT * FROM u ANTI JOIN i ON u.user_id = i.user_id AND u.item_id = i.item_id)"""


def _ranked(src: str, cols: str, k: int = 5) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rr FROM {src}) WHERE rr <= {k}"


@query("cf_user_topk", f"WITH {TASTE}, {_COS}, {_UCF} " + _ranked("un", "user_id, item_id, round(score, 6) AS score, round(least(1.0, score / 5), 6) AS confidence"))
def cf_user_topk(spark, d):
    return _top(recommend.user_based(taste(spark, d)).withColumn("confidence", F.round("confidence", 6))).select("user_id", "item_id", "score", "confidence")


@query("cf_pearson", f"WITH {TASTE}, {_PEAR}, {_UCF} " + _ranked("un", "user_id, item_id, round(score, 6) AS score"))
def cf_pearson(spark, d):
    return _top(recommend.user_based(taste(spark, d), metric="pearson")).select("user_id", "item_id", "score")


_ICF = """ni AS (SELECT item_id, sqrt(sum(rating * rating)) AS norm FROM i GROUP BY 1),
si AS (SELECT a.item_id AS a, b.item_id AS b, round(sum(a.rating * b.rating) / (any_value(x.norm) * any_value(y.norm)), 9) AS sim
  FROM i a JOIN i b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN ni x ON x.item_id = a.item_id JOIN ni y ON y.item_id = b.item_id GROUP BY 1, 2),
ki AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM si WHERE sim > 0),
vi AS (SELECT user_id, b AS item_id, avg(sim * rating) AS score FROM i JOIN ki ON ki.a = i.item_id WHERE rn <= 10 GROUP BY 1, 2),
ui AS (SELECT * FROM vi ANTI JOIN i ON vi.user_id = i.user_id AND vi.item_id = i.item_id)"""


@query("cf_item_topk", f"WITH {TASTE}, {_ICF} " + _ranked("ui", "user_id, item_id, round(score, 6) AS score"))
def cf_item_topk(spark, d):
    return _top(recommend.item_based(taste(spark, d))).select("user_id", "item_id", "score")


def taste_features(spark, d):
    """Features of a taste item: its event type and its part of the day."""
    items = taste(spark, d).select("item_id").distinct()
    kind, part = F.substring_index("item_id", "-", 1), F.substring_index("item_id", "-", -1)
    pairs = F.explode(F.array(F.struct(F.concat(F.lit("cat_"), kind).alias("feature"), F.lit(1.0).alias("weight")), F.struct(F.concat(F.lit("tag_"), part).alias("feature"), F.lit(0.5).alias("weight"))))
    return items.select("item_id", pairs.alias("x")).select("item_id", "x.feature", "x.weight")


_FEAT = """ff AS (SELECT item_id, 'cat_' || split_part(item_id, '-', 1) AS feature, 1.0::DOUBLE AS w FROM (SELECT DISTINCT item_id FROM i) UNION ALL SELECT item_id, 'tag_' || split_part(item_id, '-', 2), 0.5::DOUBLE FROM (SELECT DISTINCT item_id FROM i)),
fu AS (SELECT item_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM ff),
fp AS (SELECT user_id, feature, sum(w * rating) AS p FROM i JOIN fu USING (item_id) GROUP BY 1, 2), fl AS (SELECT user_id, sqrt(sum(p * p)) AS m FROM fp GROUP BY 1),
fs AS (SELECT user_id, item_id, sum(p * w) / any_value(m) AS score FROM fp JOIN fu USING (feature) JOIN fl USING (user_id) GROUP BY 1, 2)"""


@query("content_topk", f"WITH {TASTE}, {_FEAT} " + _ranked("fs", "user_id, item_id, round(score, 6) AS score"))
def content_topk(spark, d):
    return _top(recommend.content_based(taste(spark, d), taste_features(spark, d))).select("user_id", "item_id", "score")


@query("hybrid_rec", f"""WITH {TASTE}, {_COS}, {_UCF}, {_ICF}, {_FEAT},
hx AS (SELECT user_id, item_id, 0.3 * score AS score FROM un UNION ALL SELECT user_id, item_id, 0.3 * score FROM ui UNION ALL SELECT user_id, item_id, 0.4 * score FROM (SELECT * FROM fs ANTI JOIN i ON fs.user_id = i.user_id AND fs.item_id = i.item_id)),
hy AS (SELECT user_id, item_id, sum(score) AS score FROM hx GROUP BY 1, 2) """ + _ranked("hy", "user_id, item_id, round(score, 6) AS score"))
def hybrid_rec(spark, d):
    r = taste(spark, d)
    parts = [(0.3, recommend.user_based(r)), (0.3, recommend.item_based(r)), (0.4, recommend.content_based(r, taste_features(spark, d), seen=False))]
    return _top(recommend.mixed(parts)).select("user_id", "item_id", "score")


@query("popular_items", f"WITH {INTERACTIONS} SELECT item_id, count(*) AS n, sum(rating) AS total FROM i GROUP BY 1 ORDER BY n DESC, item_id LIMIT 100")
def popular_items(spark, d):
    return interactions(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total")).orderBy(F.desc("n"), "item_id").limit(100)


@query("unseen_items", f"WITH {TASTE} SELECT u.user_id, x.item_id FROM (SELECT DISTINCT user_id FROM i) u CROSS JOIN (SELECT DISTINCT item_id FROM i) x WHERE (u.user_id, x.item_id) NOT IN (SELECT (user_id, item_id) FROM i)")
def unseen_items(spark, d):
    """The item list is a small dimension (event types by parts of the day)."""
    r = taste(spark, d)
    pairs = r.select("user_id").distinct().crossJoin(F.broadcast(r.select("item_id").distinct()))
    return pairs.join(r.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


@query("user_profile", f"WITH {TASTE}, {_FEAT} SELECT user_id, feature, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS share FROM fp")
def user_profile(spark, d):
    f = taste_features(spark, d)
    size = f.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    p = taste(spark, d).join(f, "item_id").join(size, "item_id").groupBy("user_id", "feature").agg(F.sum(F.col("weight") / F.col("n") * F.col("rating")).alias("p"))
    return p.select("user_id", "feature", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("user_id")), 6).alias("share"))


@query("mmr_diversified")
def mmr_diversified(spark, d):
    c = recommend.content_based(taste(spark, d), taste_features(spark, d)).withColumn("category", F.substring_index("item_id", "-", 1))
    return recommend.diversified(c.withColumn("score", F.round("score", 9)), 5)


@query("context_rerank", f"WITH {TASTE} SELECT user_id, item_id, rating * CASE WHEN item_id LIKE 'view-%' THEN 1.2 ELSE 1.0 END AS score FROM i")
def context_rerank(spark, d):
    boost = F.when(F.col("item_id").startswith("view-"), 1.2).otherwise(1.0)
    return taste(spark, d).select("user_id", "item_id", (F.col("rating") * boost).alias("score"))


_AB = "ab AS (SELECT event_id, user_id, event_type, value, CASE WHEN ('0x' || md5('exp1:' || user_id)[1:6])::BIGINT / 16777216.0 < 0.5 THEN 'control' WHEN ('0x' || md5('exp1:' || user_id)[1:6])::BIGINT / 16777216.0 < 1.0 THEN 'treatment' END AS variant FROM events)"


@query("ab_assignment", f"WITH {_AB} SELECT DISTINCT user_id, variant FROM ab")
def ab_assignment(spark, d):
    return recommend.assigned(table(spark, d, "events").select("user_id").distinct(), "exp1", {"control": 0.5, "treatment": 0.5})


@query("ab_results", f"WITH {_AB} SELECT variant, event_type AS metric, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM ab GROUP BY 1, 2")
def ab_results(spark, d):
    a = recommend.assigned(table(spark, d, "events"), "exp1", {"control": 0.5, "treatment": 0.5})
    return a.groupBy("variant", F.col("event_type").alias("metric")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
