"""Memory lookups along type, tag, time and place, and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.geo import haversine
from mnemospark.plans.memory_query import MemoryQuery, page
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import MEMORIES, memories

SHOWN = ("memory_id", "entity_id", "memory_type", "event_time")
_COLS = ", ".join(SHOWN)


def _with(sql: str) -> str:
    return f"WITH {MEMORIES} {sql}"


@query("memory_query_filtered", _with(f"SELECT {_COLS} FROM m WHERE memory_type = 'click' AND event_time BETWEEN '2024-01-05' AND '2024-01-20' AND confidence >= 0.05 ORDER BY event_time DESC, memory_id LIMIT 100"))
def memory_query_filtered(spark, d):
    return MemoryQuery("click", since="2024-01-05", until="2024-01-20", least_confidence=0.05).plan(memories(spark, d)).select(*SHOWN)


@query("memory_query_paged", _with(f"SELECT {_COLS}, (SELECT count(*) FROM m WHERE memory_type = 'view') AS total FROM m WHERE memory_type = 'view' ORDER BY confidence DESC, memory_id LIMIT 50 OFFSET 100"))
def memory_query_paged(spark, d):
    return page(memories(spark, d), MemoryQuery("view", sort="importance", limit=50, offset=100)).select(*SHOWN, "total")


@query("memory_by_entity", _with(f"SELECT {_COLS} FROM m WHERE entity_id = 7 ORDER BY event_time DESC, memory_id LIMIT 20"))
def memory_by_entity(spark, d):
    return MemoryQuery(entity_id=7, limit=20).plan(memories(spark, d)).select(*SHOWN)


@query("memory_by_concept", _with(f"SELECT {_COLS} FROM m WHERE list_contains(tags, 'k3') ORDER BY event_time, memory_id LIMIT 40"))
def memory_by_concept(spark, d):
    return MemoryQuery(tags=["k3"], sort="time_asc", limit=40).plan(memories(spark, d)).select(*SHOWN)


@query("memory_keyword_or_tag", _with("SELECT memory_id FROM m WHERE contains(content, 'user 12') OR len(list_filter(tags, lambda t: contains(t, 'user 12'))) > 0"))
def memory_keyword_or_tag(spark, d):
    return MemoryQuery(keyword="user 12", limit=None).plan(memories(spark, d)).select("memory_id")


@query("memory_tags_all", _with("SELECT memory_id, tags[2] AS tag FROM m WHERE list_has_all(tags, ['error', 'k1'])"))
def memory_tags_all(spark, d):
    return MemoryQuery(tags=["error", "k1"], limit=None).plan(memories(spark, d)).select("memory_id", F.col("tags")[1].alias("tag"))


@query("memory_bbox_null_pass", _with("SELECT memory_id, lat, lon FROM m WHERE lat IS NULL OR (lat BETWEEN 39.2 AND 39.4 AND lon BETWEEN 116.1 AND 116.5)"))
def memory_bbox_null_pass(spark, d):
    return MemoryQuery(box=(39.2, 39.4, 116.1, 116.5), limit=None).plan(memories(spark, d)).select("memory_id", "lat", "lon")


@query("memory_expired", _with("SELECT memory_id, expiration FROM m WHERE expiration < TIMESTAMP '2024-01-20 00:00:00'"))
def memory_expired(spark, d):
    return memories(spark, d).where(F.col("expiration") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("memory_id", "expiration")


@query("spatiotemporal_and", _with("SELECT memory_id, event_time, lat, lon FROM m WHERE event_time BETWEEN '2024-01-10' AND '2024-01-12' AND lat BETWEEN 39.2 AND 39.6 AND lon BETWEEN 116.1 AND 116.6"))
def spatiotemporal_and(spark, d):
    q = MemoryQuery(since="2024-01-10", until="2024-01-12", box=(39.2, 39.6, 116.1, 116.6), limit=None)
    return q.plan(memories(spark, d)).where(F.col("lat").isNotNull()).select("memory_id", "event_time", "lat", "lon")


_DIST = "2 * 6371000.0 * atan2(sqrt(pow(sin(radians(lat - 39.5) / 2), 2) + cos(radians(39.5)) * cos(radians(lat)) * pow(sin(radians(lon - 116.4) / 2), 2)), sqrt(1 - (pow(sin(radians(lat - 39.5) / 2), 2) + cos(radians(39.5)) * cos(radians(lat)) * pow(sin(radians(lon - 116.4) / 2), 2))))"


def _distance():
    return haversine(F.lit(39.5), F.lit(116.4), F.col("lat"), F.col("lon"))


@query("spatial_radius", _with(f"SELECT memory_id, round({_DIST}, 3) AS metres FROM m WHERE {_DIST} <= 5000"))
def spatial_radius(spark, d):
    """A box around the circle goes to the scan's filters first; the distance decides."""
    dlat = 5000 / 111_000
    near = memories(spark, d).where(F.col("lat").between(39.5 - dlat, 39.5 + dlat) & F.col("lon").between(116.4 - 2 * dlat, 116.4 + 2 * dlat))
    return near.where(_distance() <= 5000).select("memory_id", F.round(_distance(), 3).alias("metres"))


@query("spatial_knn", _with(f"SELECT memory_id, round({_DIST}, 3) AS metres FROM m WHERE lat IS NOT NULL ORDER BY round({_DIST}, 3), memory_id LIMIT 25"))
def spatial_knn(spark, d):
    at = memories(spark, d).where(F.col("lat").isNotNull()).select("memory_id", F.round(_distance(), 3).alias("metres"))
    return at.orderBy("metres", "memory_id").limit(25)


@query("nearest_time", _with("SELECT memory_id, abs(epoch_us(event_time) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) AS micros FROM m ORDER BY micros, memory_id LIMIT 15"))
def nearest_time(spark, d):
    gap = F.abs(F.unix_micros(F.col("event_time").cast("timestamp")) - F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")))
    return memories(spark, d).select("memory_id", gap.alias("micros")).orderBy("micros", "memory_id").limit(15)


def best_tier(tiers, key="memory_id", tier="tier"):
    """One row per key, from the first tier that has it."""
    w = Window.partitionBy(key).orderBy(tier)
    return tiers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _tiers(spark, d):
    m = memories(spark, d).select("memory_id", "memory_type", "k")
    parts = [m.where(F.col("k") % 2 == 0).withColumn("tier", F.lit(0)), m.where(F.col("k") % 3 == 0).withColumn("tier", F.lit(1)), m.where(F.col("k") % 5 == 0).withColumn("tier", F.lit(2))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TIERS = "t AS (SELECT memory_id, k, 0 AS tier FROM m WHERE k % 2 = 0 UNION ALL SELECT memory_id, k, 1 FROM m WHERE k % 3 = 0 UNION ALL SELECT memory_id, k, 2 FROM m WHERE k % 5 = 0)"


@query("retrieve_tiered", f"WITH {MEMORIES}, {_TIERS} SELECT memory_id, min(tier) AS tier FROM t WHERE memory_id IN (3, 30, 31, 45, 60, 75, 99, 9999999) GROUP BY 1")
def retrieve_tiered(spark, d):
    wanted = spark.createDataFrame([(i,) for i in (3, 30, 31, 45, 60, 75, 99, 9999999)], "memory_id long")
    return best_tier(_tiers(spark, d).join(F.broadcast(wanted), "memory_id", "left_semi")).select("memory_id", "tier")


@query("union_tiers_dedup", f"WITH {MEMORIES}, {_TIERS} SELECT memory_id, min(tier) AS tier FROM t GROUP BY 1")
def union_tiers_dedup(spark, d):
    return _tiers(spark, d).groupBy("memory_id").agg(F.min("tier").alias("tier"))


def upsert(old, new, key, seq):
    """All rows by key, the one of the highest ``seq`` winning; new rows must come with higher ones."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (key, seq)]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


@query("upsert_last_wins", "SELECT event_id % 500 AS slot, arg_max(event_type, event_id) AS kind, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def upsert_last_wins(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("slot"), F.col("event_type").alias("kind"), "user_id", F.col("event_id").alias("seq"))
    return upsert(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), "slot", "seq")


@query("delete_anti", _with("SELECT memory_id, memory_type FROM m WHERE memory_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error' OR user_id < 20)"))
def delete_anti(spark, d):
    gone = table(spark, d, "events").where("event_type = 'error' or user_id < 20").select(F.col("event_id").alias("memory_id"))
    return memories(spark, d).select("memory_id", "memory_type").join(gone, "memory_id", "left_anti")


@query("tier_migration", _with("SELECT memory_id, CASE WHEN confidence > 0.7 OR k > 95 THEN 2 WHEN memory_layer = 0 AND event_time < TIMESTAMP '2024-01-20' THEN 1 ELSE memory_layer END AS layer FROM m"))
def tier_migration(spark, d):
    """Important or often used memories become long-term, old working ones short-term."""
    old = F.col("event_time") < F.lit("2024-01-20").cast("timestamp_ntz")
    layer = F.when((F.col("confidence") > 0.7) | (F.col("k") > 95), 2).when((F.col("memory_layer") == 0) & old, 1).otherwise(F.col("memory_layer"))
    return memories(spark, d).select("memory_id", layer.alias("layer"))


@query("forget_rule", _with("SELECT memory_id FROM m WHERE NOT (memory_layer = 0 AND confidence < 0.2 AND k < 2) AND NOT (memory_layer = 1 AND confidence < 0.15 AND k < 1)"))
def forget_rule(spark, d):
    weak = ((F.col("memory_layer") == 0) & (F.col("confidence") < 0.2) & (F.col("k") < 2)) | ((F.col("memory_layer") == 1) & (F.col("confidence") < 0.15) & (F.col("k") < 1))
    return memories(spark, d).where(~weak).select("memory_id")


@query("parameter_fold", """
WITH RECURSIVE p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, max(n) AS version FROM p GROUP BY 1),
r(version, confidence) AS (SELECT 1::BIGINT, 0.5::DOUBLE UNION ALL SELECT version + 1, least(0.99, confidence * 0.99 + 0.1) FROM r WHERE version < 60)
SELECT user_id, c.version, round(confidence, 6) AS confidence FROM c JOIN r ON r.version = least(c.version, 60)
""")
def parameter_fold(spark, d):
    """Confidence of a parameter after each user's updates: 0.5, then min(0.99, 0.99 c + 0.1); at its cap by 60."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("version"))
    fold = F.aggregate(F.sequence(F.lit(1), F.least(F.col("version"), F.lit(60)).cast("int")), F.lit(0.0), lambda c, i: F.when(i == 1, 0.5).otherwise(F.least(F.lit(0.99), c * 0.99 + 0.1)))
    return n.select("user_id", "version", F.round(fold, 6).alias("confidence"))
