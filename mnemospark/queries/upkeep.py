"""Tier upkeep, entity linking, projections, trajectories and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import score
from mnemospark.functions.time import seconds
from mnemospark.operators.trajectories import dtw_similarity
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import MEMORIES, memories


def _with(sql: str) -> str:
    return f"WITH {MEMORIES} {sql}"


@query("activation_scores", _with("SELECT memory_id, round(least(1.0, confidence * exp(-(1706659200000 - epoch_ms(event_time)) / 864000000.0::DOUBLE) + least(1.0, 0.1 * (k % 13))), 6) AS activation FROM m"))
def activation_scores(spark, d):
    """Activation at the end of the month with a decay of ten days."""
    age = F.lit(1706659200000) - F.unix_millis(F.col("event_time").cast("timestamp"))
    return memories(spark, d).select("memory_id", F.round(score.activation(F.col("confidence"), age, F.col("k") % 13, 864_000_000.0), 6).alias("activation"))


@query("consolidation_rule", _with("SELECT memory_id, CASE WHEN k % 5 >= 3 OR (confidence > 0.7 AND k % 2 = 0) OR event_time < TIMESTAMP '2024-01-10' THEN 'consolidate' ELSE 'keep' END AS action FROM m"))
def consolidation_rule(spark, d):
    """Rehearsed three times, or strong and out of focus, or old."""
    old = F.col("event_time") < F.lit("2024-01-10").cast("timestamp_ntz")
    rule = (F.col("k") % 5 >= 3) | ((F.col("confidence") > 0.7) & (F.col("k") % 2 == 0)) | old
    return memories(spark, d).select("memory_id", F.when(rule, "consolidate").otherwise("keep").alias("action"))


@query("attention_filter", _with("SELECT memory_id, k AS attention FROM m WHERE k >= 60 AND event_time >= TIMESTAMP '2024-01-25 00:00:00'"))
def attention_filter(spark, d):
    fresh = F.col("event_time") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return memories(spark, d).where((F.col("k") >= 60) & fresh).select("memory_id", F.col("k").alias("attention"))


@query("ring_buffer_tail", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def ring_buffer_tail(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("chunk_importance", "WITH c AS (SELECT o_orderkey % 20 AS chunk, o_orderkey AS item FROM orders), a AS (SELECT event_id AS item, least(1.0, value / 100) AS activation FROM events) SELECT chunk, round(coalesce(sum(activation), 0) / count(*), 6) AS importance FROM c LEFT JOIN a USING (item) GROUP BY 1")
def chunk_importance(spark, d):
    """Activation of a chunk's present members over the number of its members."""
    c = table(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("chunk"), F.col("o_orderkey").alias("item"))
    a = table(spark, d, "events").select(F.col("event_id").alias("item"), F.least(F.lit(1.0), F.col("value") / 100).alias("activation"))
    return c.join(a, "item", "left").groupBy("chunk").agg(F.round(F.coalesce(F.sum("activation"), F.lit(0.0)) / F.count("*"), 6).alias("importance"))


@query("api_rows", "SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS body FROM events")
def api_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"))


@query("concept_detail", "SELECT event_type AS concept, count(*) AS memory_count, list_slice(list(event_id ORDER BY event_id), 1, 3)[3] AS third FROM events GROUP BY 1")
def concept_detail(spark, d):
    """A concept with its number of memories and the third of them; only three ids are kept per task."""
    e = table(spark, d, "events")
    w = Window.partitionBy("event_type").orderBy("event_id")
    third = e.withColumn("n", F.row_number().over(w)).where("n = 3").select("event_type", F.col("event_id").alias("third"))
    return e.groupBy("event_type").agg(F.count("*").alias("memory_count")).join(third, "event_type", "left").select(F.col("event_type").alias("concept"), "memory_count", "third")


# Names as they are said, and what they stand for.
ALIASES = {"张伟": "中伟", "老李": "李四", "星爸爸": "星巴克"}


@query("alias_disambiguation", "WITH w(id, name) AS (VALUES (1, '张伟'), (2, '老李'), (3, '星爸爸'), (4, '王五')) SELECT CAST(id AS INTEGER) AS id, CASE name WHEN '张伟' THEN '中伟' WHEN '老李' THEN '李四' WHEN '星爸爸' THEN '星巴克' ELSE name END AS name FROM w")
def alias_disambiguation(spark, d):
    names = spark.createDataFrame([(1, "张伟"), (2, "老李"), (3, "星爸爸"), (4, "王五")], "id int, name string")
    known = F.create_map(*(F.lit(x) for p in ALIASES.items() for x in p))
    return names.select("id", F.coalesce(known[F.col("name")], F.col("name")).alias("name"))


#: Letters by which texts and what may hold them meet.
GRAM = 3


def _holding(long, whole, short, part):
    """Pairs of rows whose text ``whole`` holds the text ``part``."""
    n = F.length(whole)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(F.col(whole), i, k))).otherwise(F.array().cast("array<string>"))))
    held = long.select("*", F.explode(F.array_distinct(grams)).alias("gram"))
    begun = short.where(F.length(part) > 0).select("*", F.substring(part, 1, GRAM).alias("gram"))
    return held.join(begun, "gram").where(F.col(whole).contains(F.col(part))).drop("gram")


def linked(mentions, concepts, synonyms):
    """(mention, concept_id): by exact name, else by synonym, else the first concept that holds the mention or is held by it.

    Exact and synonym matches are equi-joins. What holds a text holds its first GRAM letters,
    so the rest meets the concepts by these.
    """
    exact = concepts.select(F.col("name").alias("mention"), F.col("concept_id").alias("by_name"))
    syn = synonyms.select(F.col("synonym").alias("mention"), F.col("concept_id").alias("by_synonym"))
    first = mentions.join(exact, "mention", "left").join(syn, "mention", "left").withColumn("found", F.coalesce("by_name", "by_synonym"))
    rest = first.where("found is null").select("mention").distinct()
    names = concepts.select("concept_id", "name")
    pairs = _holding(names, "name", rest, "mention").unionByName(_holding(rest, "mention", names, "name"))
    part = pairs.groupBy("mention").agg(F.min("concept_id").alias("by_part"))
    return first.join(part, "mention", "left").select("mention", F.coalesce("found", "by_part").alias("concept_id"))


@query("entity_linking", """
WITH c AS (SELECT n_nationkey AS concept_id, n_name AS name FROM nation), s AS (SELECT r_name AS synonym, 100 + r_regionkey AS concept_id FROM region),
w(mention) AS (VALUES ('NATION_7'), ('AFRICA'), ('ASIA'), ('REGION_1'), ('the NATION_12 one'), ('ATION_2'), ('nothing'))
SELECT mention, CAST(coalesce(a.concept_id, s.concept_id, (SELECT min(concept_id) FROM c WHERE contains(c.name, mention) OR contains(mention, c.name))) AS INTEGER) AS concept_id
FROM w LEFT JOIN c a ON a.name = mention LEFT JOIN s ON s.synonym = mention""")
def entity_linking(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("concept_id"), F.col("n_name").alias("name"))
    s = table(spark, d, "region").select(F.col("r_name").alias("synonym"), (F.col("r_regionkey") + 100).alias("concept_id"))
    w = spark.createDataFrame([(x,) for x in ("NATION_7", "AFRICA", "ASIA", "REGION_1", "the NATION_12 one", "ATION_2", "nothing")], "mention string")
    return linked(w, c, s)


@query("encrypted_round_trip", "SELECT c_custkey, c_name FROM customer")
def encrypted_round_trip(spark, d):
    """Fields sealed with AES-GCM and opened again."""
    key = F.lit("0123456789abcdef")
    c = table(spark, d, "customer").select("c_custkey", F.base64(F.aes_encrypt("c_name", key)).alias("sealed"))
    return c.select("c_custkey", F.aes_decrypt(F.unbase64("sealed"), key).cast("string").alias("c_name"))


@query("preference_update", "SELECT user_id, round(0.5 + 0.01 * sum(CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN -1.0 ELSE 0.1 END), 6) AS preference FROM events GROUP BY 1")
def preference_update(spark, d):
    """A preference moved by each event's gradient; steps add, so their order doesn't matter."""
    g = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.1)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.lit(0.5) + F.sum(g) * 0.01, 6).alias("preference"))


@query("similar_trajectories")
def similar_trajectories(spark, d):
    """The ten users whose values, from first to last, move most like user 7's."""
    e = table(spark, d, "events").withColumn("t", seconds(F.col("ts")))
    path = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))), lambda x: x["value"]).alias("path"))
    ref = path.where("user_id = 7").select(F.col("path").alias("ref"))
    s = path.where("user_id <> 7").crossJoin(F.broadcast(ref)).select("user_id", F.round(dtw_similarity()("path", "ref"), 6).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "user_id").limit(10)


@query("interval_algebra", _with("SELECT memory_id, round((epoch_us(end_time) - epoch_us(event_time)) / 1e6, 1) AS seconds, greatest(event_time, TIMESTAMP '2024-01-15 00:00:00') AS start, least(end_time, TIMESTAMP '2024-01-16 00:00:00') AS stop FROM m WHERE event_time <= TIMESTAMP '2024-01-16 00:00:00' AND end_time >= TIMESTAMP '2024-01-15 00:00:00'"))
def interval_algebra(spark, d):
    """Memories that touch a day, with their part of it."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-15 00:00:00", "2024-01-16 00:00:00"))
    m = memories(spark, d).where((F.col("event_time") <= hi) & (F.col("end_time") >= lo))
    return m.select("memory_id", F.round(seconds(F.col("end_time")) - seconds(F.col("event_time")), 1).alias("seconds"), F.greatest("event_time", lo).alias("start"), F.least("end_time", hi).alias("stop"))


@query("health_summary", "WITH c AS (SELECT event_type, count(*) FILTER (value > 400) AS failed, count(*) AS n FROM events GROUP BY 1) SELECT count(*) FILTER (failed > 0) AS failing, CASE WHEN count(*) FILTER (failed > 0) = 0 THEN 'healthy' WHEN count(*) FILTER (failed > 0) * 2 < count(*) THEN 'degraded' ELSE 'unhealthy' END AS state FROM c")
def health_summary(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 400).alias("failed"))
    f = F.count_if(F.col("failed") > 0)
    return c.agg(f.alias("failing"), F.when(f == 0, "healthy").when(f * 2 < F.count("*"), "degraded").otherwise("unhealthy").alias("state"))


@query("recommendation_reasons", "WITH c AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, event_type) AS rn FROM c WHERE share > 0.1) SELECT user_id, string_agg(event_type, ', ' ORDER BY rn) AS reason FROM r WHERE rn <= 2 GROUP BY 1")
def recommendation_reasons(spark, d):
    """The two strongest preferences of each user above 0.1."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).where("share > 0.1")
    packed = s.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "event_type"))).alias("x"))
    return packed.select("user_id", F.array_join(F.transform(F.slice("x", 1, 2), lambda r: r["event_type"]), ", ").alias("reason"))


@query("variant_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def variant_properties(spark, d):
    """Open properties through the VARIANT type."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.variant_get(v, "$.k", "int").alias("k"))


@query("stale_relations", "SELECT user_id, event_type, max(ts) AS last_ts FROM events GROUP BY 1, 2 HAVING max(ts) < TIMESTAMP '2024-01-20 00:00:00'")
def stale_relations(spark, d):
    """Relations that the cleanup would drop: not seen since a date, and no others."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"))
    return last.where(F.col("last_ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
