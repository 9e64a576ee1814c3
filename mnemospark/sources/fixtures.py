"""The given tables seen as memories, vectors, concepts, relations and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.registry import table


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memories; end, place, tags and expiry follow from the event's own numbers."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").alias("memory_id"),
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("memory_type"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("k"))).alias("end_time"),
        F.when(F.col("k") % 3 == 0, F.col("ts") + F.make_dt_interval(days=F.lit(7))).alias("expiration"),
        F.when(F.col("user_id") % 7 != 0, F.lit(39.0) + (F.col("event_id") % 100) / 100.0).alias("lat"),
        F.when(F.col("user_id") % 7 != 0, F.lit(116.0) + (F.col("user_id") % 100) / 100.0).alias("lon"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("content"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), (F.col("k") % 5).cast("string"))).alias("tags"),
        F.least(F.lit(1.0), F.col("value") / 500.0).alias("confidence"),
        (F.col("k") % 3).alias("memory_layer"),
        F.col("value"),
        F.col("k"),
    )


MEMORIES = """
m AS (SELECT event_id AS memory_id, user_id AS entity_id, event_type AS memory_type, ts AS event_time, k,
  ts + to_minutes(k) AS end_time, CASE WHEN k % 3 = 0 THEN ts + INTERVAL 7 DAY END AS expiration,
  CASE WHEN user_id % 7 <> 0 THEN 39.0 + (event_id % 100) / 100.0 END::DOUBLE AS lat,
  CASE WHEN user_id % 7 <> 0 THEN 116.0 + (user_id % 100) / 100.0 END::DOUBLE AS lon,
  event_type || ' by user ' || user_id AS content, [event_type, 'k' || (k % 5)] AS tags,
  least(1.0, value / 500.0) AS confidence, k % 3 AS memory_layer, value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))
"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): a customer's last quantity of each part; a full order of rows breaks ties."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_linenumber", "l_extendedprice")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))["l_quantity"].alias("rating"))
    )


INTERACTIONS = """
i AS (SELECT o_custkey AS user_id, l_partkey AS item_id,
  max({'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice, 'e': l_quantity}).e AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""


def taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): users' number of events of a type and hour of four; small and dense."""
    e = table(spark, sf_dir, "events")
    item = F.concat("event_type", F.lit("-"), F.floor(F.hour("ts") / 4).cast("string"))
    return e.groupBy("user_id", item.alias("item_id")).agg(F.count("*").cast("double").alias("rating"))


TASTE = """
i AS (SELECT user_id, event_type || '-' || (hour(ts) // 4) AS item_id, count(*)::DOUBLE AS rating FROM events GROUP BY 1, 2)
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IS_A edges (src, dst, confidence): suppliers to nations to regions to the world."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit(0.9).alias("confidence"))
    top = r.select(name("r", "r_regionkey").alias("src"), F.lit("world").alias("dst"), F.lit(0.8).alias("confidence"))
    low = s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit(0.95).alias("confidence"))
    return up.unionByName(top).unionByName(low)


HIERARCHY = """
h AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 0.9::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world', 0.8::DOUBLE FROM region
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.95::DOUBLE FROM supplier)
"""


def knows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNOWS edges (src, dst, confidence) between users: to the next user active in an hour with an event of one type."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    nxt = e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    kept = nxt.where(F.col("src") != F.col("dst"))
    return kept.groupBy("src", "dst").agg(F.count("*").alias("n")).select("src", "dst", F.least(F.lit(1.0), F.lit(0.5) + F.col("n") / 10.0).alias("confidence"))


KNOWS = """
e AS (SELECT src, dst, least(1.0, 0.5 + count(*) / 10.0)::DOUBLE AS confidence FROM (
  SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events)
  WHERE src <> dst GROUP BY 1, 2)
"""
