"""Distances between concepts, fused scores, and what models are plugged into."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.score import fused
from mnemospark.functions.vector import doubles, euclidean
from mnemospark.operators import graph, models, topk
from mnemospark.queries.search import _P, _V, PROBE
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import HIERARCHY, hierarchy


@query("semantic_distance", f"""
WITH RECURSIVE {HIERARCHY}, {_V}, x AS (SELECT 's' || vec_id AS node, e FROM v),
r(start, node, hops) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION SELECT start, dst, hops + 1 FROM r JOIN h ON h.src = r.node WHERE hops < 10),
p AS (SELECT 's' || s_suppkey AS a, unnest(['world', 'r1', 'n' || s_nationkey, 's' || (s_suppkey + 1)]) AS b FROM supplier)
SELECT a, b, round(CASE WHEN y.e IS NOT NULL AND z.e IS NOT NULL THEN 1 - list_cosine_similarity(y.e, z.e) ELSE coalesce((SELECT min(hops) FROM r WHERE start = a AND node = b) / 10.0, 1.0) END, 6) AS distance
FROM p LEFT JOIN x y ON y.node = a LEFT JOIN x z ON z.node = b""")
def semantic_distance(spark, d):
    """Suppliers have vectors as far as there are some; all else is as far as its relations lead."""
    s = table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    ends = F.array(F.lit("world"), F.lit("r1"), name("n", F.col("s_nationkey")), name("s", F.col("s_suppkey") + 1))
    pairs = s.select(name("s", F.col("s_suppkey")).alias("a"), F.explode(ends).alias("b"))
    vectors = table(spark, d, "embeddings").select(name("s", F.col("vec_id")).alias("node"), doubles("embedding").alias("vector"))
    return graph.semantic_distance(pairs, hierarchy(spark, d), vectors).withColumn("distance", F.round("distance", 6))


@query("fuse_scores", "SELECT event_id, round(0.3 * least(1.0, value / 100) + 0.2 * (hour(ts) / 23.0) + 0.3 * ((user_id % 10) / 9.0) + 0.2 * ((event_id % 5) / 4.0), 6) AS score FROM events")
def fuse_scores(spark, d):
    e = table(spark, d, "events")
    score = fused(F.least(F.lit(1.0), F.col("value") / 100), F.hour("ts") / 23.0, (F.col("user_id") % 10) / 9.0, (F.col("event_id") % 5) / 4.0)
    return e.select("event_id", F.round(score, 6).alias("score"))


@query("vector_topk_exp", f"WITH {_V} SELECT vec_id, round(exp(-list_distance(e, {_P}) / 10), 6) AS score FROM v ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_exp(spark, d):
    away = euclidean(doubles("embedding"), topk.literal(PROBE))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.exp(-away / 10), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("vector_blobs", f"WITH {_V} SELECT vec_id, 4 * len(e) AS n_bytes, true AS same FROM v")
def vector_blobs(spark, d):
    """Vectors packed to 32-bit floats and back."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", models.to_blob(F.col("embedding")).alias("blob"))
    back = models.from_blob(F.col("blob"))
    return v.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (back == F.col("embedding").cast("array<float>")).alias("same"))


@query("hybrid_mentions")
def hybrid_mentions(spark, d):
    """Rules on every document, and a recogniser where they find few mentions or the text is long."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return models.hybrid_mentions(docs, "doc_id", "text").groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query("cached_embeddings", "SELECT item_id, md5(text || ':lengths') AS cache_key, length(text)::DOUBLE AS first FROM benchmark")
def cached_embeddings(spark, d):
    """Texts embedded by a plugged-in function, the second time out of the cache."""
    lengths = lambda texts: [[float(len(t)), 1.0] for t in texts]
    items = table(spark, d, "benchmark")
    _, cache = models.embedded(items, "item_id", "text", lengths, "lengths")
    again, _ = models.embedded(items, "item_id", "text", lambda texts: [[-1.0]] * len(texts), "lengths", cache)
    return again.select("item_id", "cache_key", F.col("embedding")[0].alias("first"))
