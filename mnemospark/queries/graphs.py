"""Concept hierarchies and social graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import graph
from mnemospark.operators.components import connected_components
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import HIERARCHY, KNOWS, hierarchy, knows


def social(spark, d):
    return graph.undirected(knows(spark, d))


_U = f"{KNOWS}, un AS (SELECT DISTINCT * FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"


@query("knows_two_hop", f"WITH {KNOWS} SELECT a.src, b.dst, round(max(a.confidence * b.confidence) * 0.8, 6) AS confidence FROM e a JOIN e b ON a.dst = b.src AND a.src <> b.dst GROUP BY 1, 2")
def knows_two_hop(spark, d):
    return graph.two_hop(knows(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("infer_isa_transitive", f"WITH {HIERARCHY} SELECT a.src, b.dst, round(a.confidence * b.confidence * 0.9, 6) AS confidence FROM h a JOIN h b ON a.dst = b.src WHERE (a.src, b.dst) NOT IN (SELECT (src, dst) FROM h)")
def infer_isa_transitive(spark, d):
    h = hierarchy(spark, d)
    new = h.join(h.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("confidence").alias("c2")), "dst")
    new = new.select("src", F.col("far").alias("dst"), F.round(F.col("confidence") * F.col("c2") * 0.9, 6).alias("confidence"))
    return new.join(h.select("src", "dst"), ["src", "dst"], "left_anti")


@query("inherit_properties", "SELECT s_suppkey, n_name AS property, round(0.95::DOUBLE * 0.95::DOUBLE, 6) AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inherit_properties(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("property"))
    return table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select("s_suppkey", "property", F.round(F.lit(0.95) * 0.95, 6).alias("confidence"))


_CLOSE = f"WITH RECURSIVE {HIERARCHY}, c AS (SELECT src, dst FROM h UNION SELECT c.src, h.dst FROM c JOIN h ON c.dst = h.src)"


@query("super_concepts_closure", f"{_CLOSE} SELECT src, dst FROM c")
def super_concepts_closure(spark, d):
    return graph.closure(hierarchy(spark, d))


@query("sub_concepts_closure", f"{_CLOSE} SELECT dst AS concept, count(*) AS n FROM c GROUP BY 1")
def sub_concepts_closure(spark, d):
    return graph.closure(hierarchy(spark, d)).groupBy(F.col("dst").alias("concept")).agg(F.count("*").alias("n"))


_REACH = f"""WITH RECURSIVE {_U}, r(node, hops) AS (SELECT 7::BIGINT, 0 UNION SELECT un.dst, hops + 1 FROM r JOIN un ON un.src = r.node WHERE hops < 3)"""


@query("bfs_khop", f"{_REACH} SELECT node, min(hops) AS hops FROM r GROUP BY 1")
def bfs_khop(spark, d):
    start = spark.createDataFrame([(7,)], "node long")
    return graph.reach(social(spark, d), start, 3).select("node", "hops")


@query("shortest_path_hops", f"{_REACH} SELECT node, min(hops) AS hops FROM r WHERE node IN (1, 20, 55, 90) GROUP BY 1")
def shortest_path_hops(spark, d):
    start = spark.createDataFrame([(7,)], "node long")
    return graph.reach(social(spark, d), start, 3).where("node in (1, 20, 55, 90)").select("node", "hops")


@query("relations_between", f"WITH {KNOWS} SELECT src, dst, round(confidence, 6) AS confidence FROM e WHERE (src < 20 AND dst BETWEEN 100 AND 120) OR (dst < 20 AND src BETWEEN 100 AND 120)")
def relations_between(spark, d):
    a, b = F.col("src"), F.col("dst")
    return knows(spark, d).where(((a < 20) & b.between(100, 120)) | ((b < 20) & a.between(100, 120))).withColumn("confidence", F.round("confidence", 6))


@query("query_relations", f"WITH {KNOWS} SELECT 'out' AS direction, dst AS other, round(confidence, 6) AS confidence FROM e WHERE src = 7 AND confidence >= 0.6 UNION ALL SELECT 'in', src, round(confidence, 6) FROM e WHERE dst = 7 AND confidence >= 0.6")
def query_relations(spark, d):
    e = knows(spark, d).where("confidence >= 0.6").withColumn("confidence", F.round("confidence", 6))
    out = e.where("src = 7").select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "confidence")
    return out.unionByName(e.where("dst = 7").select(F.lit("in").alias("direction"), F.col("src").alias("other"), "confidence"))


@query("merge_concepts", f"WITH {HIERARCHY}, r AS (SELECT CASE src WHEN 'n3' THEN 'n5' ELSE src END AS src, CASE dst WHEN 'n3' THEN 'n5' ELSE dst END AS dst, confidence FROM h) SELECT src, dst, max(confidence) AS confidence FROM r WHERE src <> dst GROUP BY 1, 2")
def merge_concepts(spark, d):
    return graph.merged(hierarchy(spark, d), "n5", "n3")


@query("split_concept", f"WITH {HIERARCHY} SELECT src, CASE WHEN dst = 'n5' AND src LIKE '%1' THEN 'n5b' ELSE dst END AS dst, confidence FROM h UNION ALL SELECT 'n5b', 'n5', 1.0::DOUBLE")
def split_concept(spark, d):
    h = hierarchy(spark, d)
    moved = h.withColumn("dst", F.when((F.col("dst") == "n5") & F.col("src").endswith("1"), "n5b").otherwise(F.col("dst")))
    return moved.unionByName(spark.createDataFrame([("n5b", "n5", 1.0)], "src string, dst string, confidence double"))


@query("delete_concept_cascade", f"WITH {HIERARCHY} SELECT src, dst FROM h WHERE src <> 'n5' AND dst <> 'n5'")
def delete_concept_cascade(spark, d):
    return hierarchy(spark, d).where("src <> 'n5' and dst <> 'n5'").select("src", "dst")


@query("import_stats", "WITH x AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0), y AS (SELECT l_partkey % 3000 AS id FROM lineitem GROUP BY 1) SELECT CASE WHEN x.id IS NULL THEN 'created' ELSE 'skipped' END AS action, count(*) AS n FROM y LEFT JOIN x ON x.id = y.id GROUP BY 1")
def import_stats(spark, d):
    old = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("known"))
    new = table(spark, d, "lineitem").select((F.col("l_partkey") % 3000).alias("id")).distinct()
    return new.join(old, "id", "left").groupBy(F.when(F.col("known").isNull(), "created").otherwise("skipped").alias("action")).agg(F.count("*").alias("n"))


def _ranks_sql(rounds: int) -> str:
    out = ["dg AS (SELECT src, count(*) AS n FROM un GROUP BY 1)", "nn AS (SELECT count(*)::DOUBLE AS size FROM dg)", "p0 AS (SELECT src AS node, 1 / size AS rank FROM dg, nn)"]
    for i in range(1, rounds + 1):
        out.append(f"g{i} AS (SELECT un.dst AS node, sum(rank / dg.n) AS got FROM un JOIN p{i - 1} ON un.src = node JOIN dg ON dg.src = un.src GROUP BY 1)")
        out.append(f"w{i} AS (SELECT dg.src AS node, 0.15 / size + 0.85 * coalesce(got, 0) AS raw FROM dg LEFT JOIN g{i} ON g{i}.node = dg.src, nn)")
        out.append(f"p{i} AS (SELECT node, raw / sum(raw) OVER () AS rank FROM w{i})")
    return ", ".join(out)


@query("pagerank_10", f"WITH {_U}, {_ranks_sql(10)} SELECT node, round(rank, 7) AS rank FROM p10")
def pagerank_10(spark, d):
    return graph.pagerank(social(spark, d), 10).select("node", F.round("rank", 7).alias("rank"))


@query("degree_centrality", f"WITH {_U}, c AS (SELECT src AS node, count(*) AS degree FROM un GROUP BY 1) SELECT node, degree, round(degree / max(degree) OVER (), 6) AS centrality FROM c")
def degree_centrality(spark, d):
    c = social(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return c.crossJoin(F.broadcast(c.agg(F.max("degree").alias("top")))).select("node", "degree", F.round(F.col("degree") / F.col("top"), 6).alias("centrality"))


@query("influencers", f"WITH {_U}, {_ranks_sql(5)}, c AS (SELECT src AS node, count(*) AS degree FROM un GROUP BY 1), s AS (SELECT node, round((rank + degree / max(degree) OVER ()) / 2, 6) AS score FROM p5 JOIN c USING (node)) SELECT node, score FROM s ORDER BY score DESC, node LIMIT 10")
def influencers(spark, d):
    s = social(spark, d)
    c = s.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    c = c.crossJoin(F.broadcast(c.agg(F.max("degree").alias("top")))).select("node", (F.col("degree") / F.col("top")).alias("centrality"))
    score = F.round((F.col("rank") + F.col("centrality")) / 2, 6).alias("score")
    return graph.pagerank(s, 5).join(c, "node").select("node", score).orderBy(F.desc("score"), "node").limit(10)


def _labels_sql(rounds: int) -> str:
    out = ["l0 AS (SELECT DISTINCT src AS node, src AS label FROM un)"]
    for i in range(1, rounds + 1):
        out.append(f"v{i} AS (SELECT un.src AS node, label, count(*) AS n FROM un JOIN l{i - 1} ON un.dst = node GROUP BY 1, 2)")
        out.append(f"l{i} AS (SELECT node, arg_min(label, (-n, label)) AS label FROM v{i} GROUP BY 1)")
    return ", ".join(out)


@query("lpa_sync_5", f"WITH {_U}, {_labels_sql(5)} SELECT node, label FROM l5")
def lpa_sync_5(spark, d):
    return graph.communities(social(spark, d), 5)


@query("bridges", f"WITH {_U}, {_labels_sql(2)} SELECT un.src AS node, count(DISTINCT label) AS communities FROM un JOIN l2 ON un.dst = node GROUP BY 1 HAVING count(DISTINCT label) > 1")
def bridges(spark, d):
    s = social(spark, d)
    labels = graph.communities(s, 2).withColumnRenamed("node", "dst")
    return s.join(labels, "dst").groupBy(F.col("src").alias("node")).agg(F.count_distinct("label").alias("communities")).where("communities > 1")


@query("network_stats", f"WITH {_U}, c AS (SELECT src, count(*) AS degree FROM un GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 6) AS mean_degree, max(degree) AS top_degree FROM c")
def network_stats(spark, d):
    c = social(spark, d).groupBy("src").agg(F.count("*").alias("degree"))
    return c.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("top_degree"))


@query("similar_concepts", f"WITH {KNOWS} SELECT other, max(c) AS confidence FROM (SELECT dst AS other, round(confidence, 6) AS c FROM e WHERE src = 11 UNION ALL SELECT src, round(confidence, 6) FROM e WHERE dst = 11) WHERE c >= 0.6 GROUP BY 1")
def similar_concepts(spark, d):
    e = knows(spark, d).withColumn("c", F.round("confidence", 6)).where("c >= 0.6")
    both = e.where("src = 11").select(F.col("dst").alias("other"), "c").unionByName(e.where("dst = 11").select(F.col("src").alias("other"), "c"))
    return both.groupBy("other").agg(F.max("c").alias("confidence"))


@query("connected_users")
def connected_users(spark, d):
    """Components of the graph of users who are strongly linked."""
    e = knows(spark, d).where("confidence >= 0.7")
    return connected_components(e, "src", "dst").groupBy(F.col("root").alias("component")).agg(F.count("*").alias("n"))


@query("one_edge_per_pair", f"WITH {KNOWS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS directions FROM e GROUP BY 1, 2")
def one_edge_per_pair(spark, d):
    return knows(spark, d).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("directions"))


@query("concept_rank_per_region", "WITH c AS (SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_regionkey, n_name, n, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS INTEGER) AS place FROM c")
def concept_rank_per_region(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", "n_name")
    c = table(spark, d, "customer").join(F.broadcast(n), "c_nationkey").groupBy("n_regionkey", "n_name").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.rank().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n"))))
