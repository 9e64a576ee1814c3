"""Vector, text and hybrid search."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.vector import cosine, dot, doubles, euclidean, norm, normalised
from mnemospark.operators import topk
from mnemospark.operators.windows import top_per_key
from mnemospark.registry import query, table

#: A fixed probe of 64 dimensions.
PROBE = [round(math.sin(i + 1), 6) for i in range(64)]
_P = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query("vector_topk_cosine", f"WITH {_V} SELECT vec_id, round(list_cosine_similarity(e, {_P}), 6) AS score FROM v ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark, d):
    return topk.nearest(table(spark, d, "embeddings"), PROBE, 10)


@query("vector_topk_l2", f"WITH {_V} SELECT vec_id, round(1 / (1 + pow(list_distance(e, {_P}), 2)), 6) AS score FROM v WHERE round(1 / (1 + pow(list_distance(e, {_P}), 2)), 6) >= 0.01 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_l2(spark, d):
    return topk.nearest_l2(table(spark, d, "embeddings"), PROBE, 10, 0.01)


@query("vector_filtered_topk", f"WITH {_V} SELECT vec_id, round(list_cosine_similarity(e, {_P}), 6) AS score FROM v WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def vector_filtered_topk(spark, d):
    """The filter comes before the ranking, so k rows are found if they exist."""
    return topk.nearest(table(spark, d, "embeddings").where(F.col("label").isin(1, 2, 3)), PROBE, 10)


@query("vector_normalize", f"WITH {_V} SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 6) AS last FROM v")
def vector_normalize(spark, d):
    n = normalised(doubles("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n[0], 6).alias("first"), F.round(n[63], 6).alias("last"))


@query("vector_pairs_per_label", f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM v) SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS score FROM r a JOIN r b ON a.label = b.label AND b.rn = 1 AND a.rn > 1")
def vector_pairs_per_label(spark, d):
    """Each vector with the first one of its label."""
    v = table(spark, d, "embeddings").select("vec_id", "label", doubles("embedding").alias("e"))
    first = v.groupBy("label").agg(F.min_by(F.struct("vec_id", "e"), "vec_id").alias("f")).select("label", F.col("f.vec_id").alias("b"), F.col("f.e").alias("g"))
    return v.join(first, "label").where("vec_id <> b").select("label", F.col("vec_id").alias("a"), "b", F.round(cosine(F.col("e"), F.col("g")), 5).alias("score"))


@query("find_similar_ranked", f"WITH {_V}, s AS (SELECT vec_id, round(list_dot_product(e, {_P}), 5) AS score FROM v ORDER BY score DESC, vec_id LIMIT 15) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s")
def find_similar_ranked(spark, d):
    v = table(spark, d, "embeddings")
    s = v.select("vec_id", F.round(dot(doubles("embedding"), topk.literal(PROBE)), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(15)
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))


_WORDS = ["the", "of", "die"]


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{w}')) AS t{i}" for i, w in enumerate(_WORDS))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(_WORDS)))
    score = " + ".join(f"ln(1 + (nn - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / av))" for i in range(len(_WORDS)))
    return f"""
k AS (SELECT doc_id, len(w) AS n, {tf} FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents)),
st AS (SELECT count(*) AS nn, avg(n) AS av, {df} FROM k),
bm AS (SELECT * FROM (SELECT doc_id, {score} AS score FROM k, st) WHERE score > 0)"""


@query("text_bm25_topk", f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def text_bm25_topk(spark, d):
    s = topk.bm25(table(spark, d, "documents"), _WORDS)
    return s.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("hybrid_search", f"""
WITH {_V}, {_bm25_sql()},
vs AS (SELECT vec_id AS id, round(list_cosine_similarity(e, {_P}), 6) AS v FROM v ORDER BY v DESC, id LIMIT 40),
ts AS (SELECT doc_id AS id, round(score, 6) AS s FROM bm ORDER BY s DESC, id LIMIT 40),
tr AS (SELECT id, 1.0::DOUBLE / (1 + row_number() OVER (ORDER BY s DESC, id)) AS t FROM ts)
SELECT id, round(coalesce(v, 0) * 0.7 + coalesce(t, 0) * (1 - 0.7), 6) AS score FROM vs FULL JOIN tr USING (id) ORDER BY score DESC, id LIMIT 20""")
def hybrid_search(spark, d):
    """Vectors and documents share ids."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.round(cosine(doubles("embedding"), topk.literal(PROBE)), 6).alias("score"))
    t = topk.bm25(table(spark, d, "documents"), _WORDS).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    return topk.hybrid(v, t, 20, "id")


@query("ivf_fixed_centroids", f"""
WITH {_V}, x AS (SELECT label, unnest(range(64)) AS i, unnest(e) AS x FROM v), c AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
cc AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY 1),
best AS (SELECT label FROM cc ORDER BY round(list_distance(c, {_P}), 9), label LIMIT 3)
SELECT vec_id, round(list_cosine_similarity(e, {_P}), 6) AS score FROM v WHERE label IN (SELECT label FROM best) ORDER BY score DESC, vec_id LIMIT 10""")
def ivf_fixed_centroids(spark, d):
    """The three label means nearest to the probe give the candidates; no cap within them."""
    v = table(spark, d, "embeddings")
    mean = v.select("label", F.posexplode(doubles("embedding")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    best = centre.orderBy(F.round(euclidean(F.col("c"), topk.literal(PROBE)), 9), "label").limit(3).select("label")
    return topk.nearest(v.join(F.broadcast(best), "label", "left_semi"), PROBE, 10)


@query("keyword_concepts", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed') OR contains(lower(p_type), 'brass') ORDER BY p_partkey LIMIT 50")
def keyword_concepts(spark, d):
    p = table(spark, d, "part")
    return p.where(F.lower("p_name").contains("ed") | F.lower("p_type").contains("brass")).orderBy("p_partkey").limit(50).select("p_partkey", "p_name")


@query("name_or_alias_lookup", "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7' OR contains(n_name, '1') OR contains('see NATION_3 there', n_name)")
def name_or_alias_lookup(spark, d):
    n = table(spark, d, "nation")
    k = F.lit("see NATION_3 there")
    return n.where((F.col("n_name") == "NATION_7") | F.col("n_name").contains("1") | k.contains(F.col("n_name"))).select("n_nationkey", "n_name")


@query("vector_magnitudes", f"WITH {_V} SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(e, e))), 6) AS magnitude FROM v GROUP BY 1")
def vector_magnitudes(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm(doubles("embedding"))), 6).alias("magnitude"))


@query("fused_recall", f"""
WITH {_V}, s AS (SELECT vec_id AS id, 0.5 * round(list_cosine_similarity(e, {_P}), 6) AS w FROM v),
t AS (SELECT event_id AS id, 0.3 AS w FROM events WHERE ts < '2024-01-02'), c AS (SELECT event_id AS id, 0.2 AS w FROM events WHERE event_type = 'purchase'),
u AS (SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM c)
SELECT id, round(sum(w), 7) AS score FROM u GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")
def fused_recall(spark, d):
    """Semantic, temporal and concept recall, weighed and summed."""
    v, e = table(spark, d, "embeddings"), table(spark, d, "events")
    s = v.select(F.col("vec_id").alias("id"), (F.round(cosine(doubles("embedding"), topk.literal(PROBE)), 6) * 0.5).alias("w"))
    t = e.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).select(F.col("event_id").alias("id"), F.lit(0.3).alias("w"))
    c = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.lit(0.2).alias("w"))
    return s.unionByName(t).unionByName(c).groupBy("id").agg(F.round(F.sum("w"), 7).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("embedding_clusters", f"WITH {_V} SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM v GROUP BY 1")
def embedding_clusters(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def kmeans(vectors, k: int = 5, seed: int = 42, vector: str = "embedding"):
    """``vectors`` with cluster, by Spark's k-means."""
    x = vectors.withColumn("__f", array_to_vector(doubles(vector)))
    return KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(x).transform(x).drop("__f")


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return kmeans(table(spark, d, "embeddings")).groupBy("cluster").agg(F.count("*").alias("n"))


@query("best_per_label", f"WITH {_V}, r AS (SELECT label, vec_id, round(list_cosine_similarity(e, {_P}), 6) AS score FROM v), q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM r) SELECT label, vec_id, score FROM q WHERE rn <= 2")
def best_per_label(spark, d):
    s = table(spark, d, "embeddings").select("label", "vec_id", F.round(cosine(doubles("embedding"), topk.literal(PROBE)), 6).alias("score"))
    return top_per_key(s, ["label"], [F.desc("score"), F.asc("vec_id")], 2)
