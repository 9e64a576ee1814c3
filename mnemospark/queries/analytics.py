"""Statistics, patterns, windows and joins over memories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import geo, score
from mnemospark.functions.time import allen, day_type, seconds, time_of_day
from mnemospark.operators.joins import band_join, following_first, grid_pairs, interval_pairs
from mnemospark.operators.windows import revisits, sessions, top_per_key, transitions
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import INTERACTIONS, MEMORIES, interactions, memories


def events(spark, d):
    return table(spark, d, "events").withColumn("t", seconds(F.col("ts")))


_T = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


@query("store_stats", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def store_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("concept_type_distribution", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def concept_type_distribution(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type")
    return p.groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count("*").alias("n"))


@query("vector_stats", "SELECT count(*) AS n, count(DISTINCT label) AS labels, CAST(min(len(embedding)) AS INTEGER) AS dims FROM embeddings")
def vector_stats(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min(F.size("embedding")).alias("dims"))


@query("tier_stats", f"WITH {MEMORIES} SELECT memory_layer, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT entity_id) AS entities FROM m GROUP BY 1")
def tier_stats(spark, d):
    return memories(spark, d).groupBy("memory_layer").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_distinct("entity_id").alias("entities"))


@query("access_stats", "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def access_stats(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("concept_new_vs_linked", f"WITH {MEMORIES}, c AS (SELECT tags[2] || '/' || entity_id AS concept, count(*) AS n FROM m GROUP BY 1) SELECT count(*) FILTER (n = 1) AS fresh, count(*) FILTER (n > 1) AS linked FROM c")
def concept_new_vs_linked(spark, d):
    c = memories(spark, d).groupBy(F.concat(F.col("tags")[1], F.lit("/"), "entity_id").alias("concept")).agg(F.count("*").alias("n"))
    return c.agg(F.count_if(F.col("n") == 1).alias("fresh"), F.count_if(F.col("n") > 1).alias("linked"))


@query("habit_patterns", "SELECT user_id, event_type, count(*) AS n, least(count(*) / 10.0, 0.9) AS confidence FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def habit_patterns(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 3")
    return n.withColumn("confidence", score.capped(F.col("n"), 10.0, 0.9))


@query("predictions_top5", "SELECT event_type, n, least(n / 10.0, 0.9) AS confidence FROM (SELECT event_type, count(*) AS n, min(event_id) AS seq FROM events GROUP BY 1 HAVING count(*) >= 3) ORDER BY seq LIMIT 5")
def predictions_top5(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seq")).where("n >= 3")
    return n.orderBy("seq").limit(5).select("event_type", "n", score.capped(F.col("n"), 10.0, 0.9).alias("confidence"))


@query("schedule_density", "SELECT user_id, count(*) AS n FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) < 86400000000 GROUP BY 1 HAVING count(*) >= 3")
def schedule_density(spark, d):
    near = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-15 00:00:00").cast("timestamp"))) < 86_400_000_000
    return table(spark, d, "events").where(near).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("social_reminder", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2 ORDER BY min(event_id) LIMIT 1")
def social_reminder(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("seq")).where("n >= 2")
    return n.orderBy("seq").limit(1).select("user_id", "n")


@query("temporal_bucket_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def temporal_bucket_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query("heatmap_cells", f"WITH {MEMORIES} SELECT CAST(floor(lat / 0.1) AS BIGINT) AS cell_y, CAST(floor(lon / 0.1) AS BIGINT) AS cell_x, count(*) AS n FROM m WHERE lat IS NOT NULL GROUP BY 1, 2")
def heatmap_cells(spark, d):
    m = memories(spark, d).where("lat is not null")
    return m.groupBy(F.floor(F.col("lat") / 0.1).alias("cell_y"), F.floor(F.col("lon") / 0.1).alias("cell_x")).agg(F.count("*").alias("n"))


@query("timeline_by_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds FROM (SELECT ts, event_type FROM events UNION ALL SELECT o_orderdate, o_orderstatus FROM orders) GROUP BY 1")
def timeline_by_day(spark, d):
    both = table(spark, d, "events").select("ts", "event_type").unionByName(table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("event_type")))
    return both.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("hourly_access_weights", "SELECT CAST(hour(ts) AS INTEGER) AS hour, round(count(*) / sum(count(*)) OVER (), 8) AS weight FROM events GROUP BY 1")
def hourly_access_weights(spark, d):
    n = table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return n.select("hour", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("weight"))


@query("access_entropy", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def access_entropy(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("importance_v1", """
SELECT user_id, round(0.4 * CASE WHEN idle / 86400 < 1 THEN 1.0 ELSE 1 / (1 + idle / 86400) END + 0.6 * least(1.0, n / 100.0), 6) AS importance
FROM (SELECT user_id, count(*) AS n, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6 AS idle FROM events GROUP BY 1)""")
def importance_v1(spark, d):
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) / 1e6
    n = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), (now - F.max("t")).alias("idle"))
    return n.select("user_id", F.round(score.importance(F.col("n"), F.col("idle")), 6).alias("importance"))


@query("importance_v2", f"""
WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM e),
g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM r WHERE rn <= 100),
s AS (SELECT user_id, count(*) AS n, max(t) AS last_t, var_pop(gap / 3600) AS v FROM g GROUP BY 1)
SELECT user_id, round(0.3 * exp(-(1706659200 - last_t) / 86400) + 0.4 * least(1.0, n / 100.0) + 0.3 * CASE WHEN n < 2 THEN 0.5 ELSE exp(-coalesce(v, 0) / 1e6) END, 5) AS importance FROM s""")
def importance_v2(spark, d):
    """Recency, frequency and the regularity of the last hundred gaps (in hours)."""
    last = top_per_key(events(spark, d), ["user_id"], [F.desc("t"), F.desc("event_id")], 100)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = last.withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("user_id").agg(F.count("*").alias("n"), F.max("t").alias("last_t"), F.var_pop(F.col("gap") / 3600).alias("v"))
    recency = F.exp(-(F.lit(1706659200) - F.col("last_t")) / 86400)
    mixed = recency * 0.3 + F.least(F.lit(1.0), F.col("n") / 100.0) * 0.4 + score.regularity(F.col("v"), F.col("n")) * 0.3
    return s.select("user_id", F.round(mixed, 5).alias("importance"))


_TOD = "CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 13 THEN 'noon' WHEN hour(ts) BETWEEN 14 AND 17 THEN 'afternoon' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END"


@query("time_of_day_pattern", f"""
WITH c AS (SELECT user_id, event_type, {_TOD} AS tod, count(*) AS n FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, tod) AS rn, sum(n) OVER (PARTITION BY user_id, event_type) AS total FROM c)
SELECT user_id, event_type, tod, round(n / total, 6) AS confidence FROM r WHERE rn = 1 AND n / total > 0.5""")
def time_of_day_pattern(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type", time_of_day(F.col("ts")).alias("tod")).agg(F.count("*").alias("n"))
    best = c.groupBy("user_id", "event_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "tod")).alias("b"), F.sum("n").alias("total"))
    share = -F.col("b.n") / F.col("total")
    return best.where(share > 0.5).select("user_id", "event_type", F.col("b.tod").alias("tod"), F.round(share, 6).alias("confidence"))


@query("day_type_counts", "SELECT event_type, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS n FROM events GROUP BY 1, 2")
def day_type_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", day_type(F.col("ts")).alias("day_type")).agg(F.count("*").alias("n"))


@query("category_weights", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 8) AS weight FROM events GROUP BY 1")
def category_weights(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("weight"))


@query("mention_dedup_best", "SELECT user_id, event_type, max(value) AS value, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY 1, 2")
def mention_dedup_best(spark, d):
    return top_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_type", "value", "event_id")


@query("first_seen_dedup", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def first_seen_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query("last_write_rating", f"WITH {INTERACTIONS} SELECT user_id, item_id, rating FROM i")
def last_write_rating(spark, d):
    return interactions(spark, d)


@query("last_n_accesses", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def last_n_accesses(spark, d):
    return top_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("lru_working_set", "SELECT user_id, last_ts, rn FROM (SELECT user_id, max(ts) AS last_ts, CAST(row_number() OVER (ORDER BY max(ts) DESC, user_id) AS INTEGER) AS rn FROM events GROUP BY 1) WHERE rn <= 7")
def lru_working_set(spark, d):
    """The seven users used last; order and limit first, so one small task numbers them."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "user_id").limit(7)
    return last.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("last_ts"), "user_id")))


@query("interval_regularity", f"WITH {_T}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e) SELECT user_id, round(avg(gap), 3) AS mean_gap, round(stddev_pop(gap), 2) AS sd_gap FROM g GROUP BY 1")
def interval_regularity(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("user_id").agg(F.round(F.avg("gap"), 3).alias("mean_gap"), F.round(F.stddev_pop("gap"), 2).alias("sd_gap"))


@query("revisit_interval", f"WITH {_T} SELECT user_id, event_type, count(*) AS visits, round((max(t) - min(t)) / (count(*) - 1) / 3600, 5) AS avg_hours, round(max(t) + (max(t) - min(t)) / (count(*) - 1), 2) AS next_t FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def revisit_interval(spark, d):
    r = revisits(events(spark, d), ["user_id", "event_type"], "t")
    return r.select("user_id", "event_type", "visits", F.round(F.col("avg_gap") / 3600, 5).alias("avg_hours"), F.round("next_at", 2).alias("next_t"))


@query("sessionize_2h", f"""
WITH {_T}, s AS (SELECT user_id, event_id, t, sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e))
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM s GROUP BY 1, 2""")
def sessionize_2h(spark, d):
    s = sessions(events(spark, d), ["user_id"], "t", [F.asc("t"), F.asc("event_id")], 7200.0)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


_NEXT = "n AS (SELECT user_id, event_type AS s, lead(event_type) OVER w AS nxt, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("markov_transitions", f"WITH {_NEXT}, c AS (SELECT s AS state, nxt AS next_state, count(*) AS n FROM n WHERE nxt IS NOT NULL GROUP BY 1, 2) SELECT state, next_state, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM c")
def markov_transitions(spark, d):
    t = transitions(table(spark, d, "events"), ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")])
    return t.withColumn("p", F.round("p", 6))


@query("markov_order2", f"WITH {_NEXT}, c AS (SELECT prev || '>' || s AS state, nxt AS next_state, count(*) AS n FROM n WHERE nxt IS NOT NULL AND prev IS NOT NULL GROUP BY 1, 2) SELECT state, next_state, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM c")
def markov_order2(spark, d):
    t = transitions(table(spark, d, "events"), ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")], 2)
    return t.withColumn("p", F.round("p", 6))


@query("markov_next_topk", f"""
WITH {_NEXT}, c AS (SELECT s AS state, nxt AS next_state, count(*) AS n FROM n WHERE nxt IS NOT NULL GROUP BY 1, 2),
r AS (SELECT state, next_state, round(n / sum(n) OVER (PARTITION BY state), 6) AS p, row_number() OVER (PARTITION BY state ORDER BY n DESC, next_state) AS rn FROM c)
SELECT state, next_state, p, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 3""")
def markov_next_topk(spark, d):
    t = transitions(table(spark, d, "events"), ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")])
    return top_per_key(t, ["state"], [F.desc("n"), F.asc("next_state")], 3, "rn").select("state", "next_state", F.round("p", 6).alias("p"), "rn")


@query("markov_rollout", f"""
WITH RECURSIVE {_NEXT}, c AS (SELECT s, nxt, count(*) AS n FROM n WHERE nxt IS NOT NULL GROUP BY 1, 2),
b AS (SELECT s, arg_min(nxt, (-n, nxt)) AS nxt FROM c GROUP BY 1),
r(step, state) AS (SELECT 0, 'view' UNION ALL SELECT step + 1, nxt FROM r JOIN b ON r.state = b.s WHERE step < 5)
SELECT step, state FROM r WHERE step > 0""")
def markov_rollout(spark, d):
    """The five likeliest steps from a state, one after the other."""
    t = transitions(table(spark, d, "events"), ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")])
    best = t.groupBy("state").agg(F.min(F.struct((-F.col("n")).alias("n"), "next_state"))["next_state"].alias("next_state"))
    at, out = spark.createDataFrame([(0, "view")], "step int, state string"), None
    for _ in range(5):
        at = at.join(F.broadcast(best), "state").select((F.col("step") + 1).alias("step"), F.col("next_state").alias("state"))
        out = at if out is None else out.unionByName(at)
    return out


@query("band_conflicts_1h", f"WITH {_T} SELECT a.event_id AS a, b.event_id AS b, 0.85::DOUBLE AS confidence FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.t - b.t) < 3600")
def band_conflicts_1h(spark, d):
    e = events(spark, d)
    right = e.select("user_id", F.col("event_id").alias("b"), F.col("t").alias("tb"))
    met = band_join(e.select("user_id", F.col("event_id").alias("a"), F.col("t").alias("ta")), right, "ta", "tb", 3600.0, ["user_id"])
    return met.where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < 3600)).select("a", "b", F.lit(0.85).alias("confidence"))


_METRES = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"


@query("interval_overlap_conflicts", f"""
WITH {MEMORIES}, p AS (SELECT a.memory_id AS a, b.memory_id AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
  FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.memory_id < b.memory_id AND a.event_time <= b.end_time AND b.event_time <= a.end_time WHERE a.lat IS NOT NULL)
SELECT a, b, round({_METRES}, 2) AS metres FROM p WHERE {_METRES} > 1000""")
def interval_overlap_conflicts(spark, d):
    m = memories(spark, d).where("lat is not null").select("memory_id", "entity_id", seconds(F.col("event_time")).alias("s"), seconds(F.col("end_time")).alias("e"), "lat", "lon")
    p = interval_pairs(m, "memory_id", "s", "e", 7200.0, ["entity_id"])
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    return p.select(F.col("memory_id").alias("a"), F.col("other_memory_id").alias("b"), metres.alias("metres")).where("metres > 1000").withColumn("metres", F.round("metres", 2))


@query("asof_effect_24h", f"""
WITH {_T}, p AS (SELECT c.event_id AS cause, x.event_id AS effect, x.t - c.t AS gap, row_number() OVER (PARTITION BY c.event_id ORDER BY x.t, x.event_id) AS rn
  FROM e c JOIN e x ON c.user_id = x.user_id AND x.t > c.t AND x.t - c.t < 86400 WHERE c.event_type = 'click' AND x.event_type = 'purchase')
SELECT cause, effect, round(gap, 3) AS gap FROM p WHERE rn = 1""")
def asof_effect_24h(spark, d):
    e = events(spark, d)
    c = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("cause"), "t")
    x = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("effect"), F.col("t").alias("tx"))
    met = following_first(c, x, "t", "tx", 86400.0, ["user_id"], ["cause"], [F.asc("tx"), F.asc("effect")])
    return met.select("cause", "effect", F.round(F.col("tx") - F.col("t"), 3).alias("gap"))


@query("allen_relations", f"""
WITH {MEMORIES}, x AS (SELECT memory_id, entity_id, date_trunc('hour', event_time) AS s, date_trunc('hour', end_time) AS e FROM m),
p AS (SELECT a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM x a JOIN x b ON a.entity_id = b.entity_id AND CAST(a.s AS DATE) = CAST(b.s AS DATE) AND a.memory_id < b.memory_id)
SELECT CASE WHEN e1 < s2 THEN 'before' WHEN e2 < s1 THEN 'after' WHEN s1 = s2 AND e1 = e2 THEN 'equals' WHEN e1 = s2 THEN 'meets' WHEN e2 = s1 THEN 'met_by'
  WHEN s1 = s2 AND e1 < e2 THEN 'starts' WHEN s1 = s2 THEN 'started_by' WHEN e1 = e2 AND s1 > s2 THEN 'finishes' WHEN e1 = e2 THEN 'finished_by'
  WHEN s1 > s2 AND e1 < e2 THEN 'during' WHEN s1 < s2 AND e1 > e2 THEN 'contains' WHEN s1 < s2 THEN 'overlaps' ELSE 'overlapped_by' END AS relation, count(*) AS n FROM p GROUP BY 1""")
def allen_relations(spark, d):
    """Counts of the relations between a user's memories that begin on one day, by hours."""
    x = memories(spark, d).select("memory_id", "entity_id", F.date_trunc("hour", "event_time").alias("s"), F.date_trunc("hour", "end_time").alias("e")).withColumn("day", F.to_date("s"))
    y = x.select("entity_id", "day", F.col("memory_id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    p = x.join(y, ["entity_id", "day"]).where("memory_id < other")
    return p.groupBy(allen(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).alias("relation")).agg(F.count("*").alias("n"))


@query("causal_candidates_window", f"WITH {_T} SELECT x.event_id AS effect, c.event_id AS cause FROM e x JOIN e c ON c.t >= x.t - 60 AND c.t < x.t WHERE x.event_type = 'error'")
def causal_candidates_window(spark, d):
    e = events(spark, d)
    x = e.where("event_type = 'error'").select(F.col("event_id").alias("effect"), F.col("t").alias("tx"))
    met = band_join(x, e.select(F.col("event_id").alias("cause"), F.col("t").alias("tc")), "tx", "tc", 60.0)
    return met.where((F.col("tc") < F.col("tx")) & (F.col("tc") >= F.col("tx") - 60)).select("effect", "cause")


@query("co_located_events", f"""
WITH {MEMORIES}, x AS (SELECT *, CAST(event_time AS DATE) AS day FROM m WHERE lat IS NOT NULL), p AS (SELECT a.memory_id AS a, b.memory_id AS b,
  pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
  FROM x a JOIN x b ON a.day = b.day AND a.memory_id < b.memory_id AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.03)
SELECT a, b, round({_METRES}, 2) AS metres FROM p WHERE {_METRES} <= 1200""")
def co_located_events(spark, d):
    """Memories of one day within 1200 m, met over grid cells wider than that."""
    m = memories(spark, d).where("lat is not null").select("memory_id", F.to_date("event_time").alias("day"), "lat", "lon")
    p = grid_pairs(m, "memory_id", "lat", "lon", 0.012, 0.0165, ["day"])
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))
    return p.select(F.col("memory_id").alias("a"), F.col("other_memory_id").alias("b"), metres.alias("metres")).where("metres <= 1200").withColumn("metres", F.round("metres", 2))


@query("tag_semi_join", "SELECT vec_id FROM embeddings WHERE label IN (SELECT o_orderkey % 50 FROM orders WHERE o_orderstatus = 'F')")
def tag_semi_join(spark, d):
    tags = table(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 50).alias("label"))
    return table(spark, d, "embeddings").join(tags, "label", "left_semi").select("vec_id")


@query("dangling_relations", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)")
def dangling_relations(spark, d):
    kept = table(spark, d, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(kept, "l_suppkey", "left_anti")


@query("set_operations", "SELECT id, 'both' AS part FROM (SELECT user_id AS id FROM events WHERE event_type = 'click' AND value > 200 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 200) UNION ALL SELECT id, 'first' FROM (SELECT user_id AS id FROM events WHERE event_type = 'click' AND value > 200 EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def set_operations(spark, d):
    e = table(spark, d, "events").where("value > 200")
    a, b = (e.where(F.col("event_type") == k).select(F.col("user_id").alias("id")) for k in ("click", "error"))
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("first")))


@query("trajectory_summary", f"""
WITH {MEMORIES}, s AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM m WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY event_time, memory_id)),
g AS (SELECT *, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) AS h FROM s)
SELECT entity_id, count(*) AS points, min(event_time) AS first_ts, max(event_time) AS last_ts, min(lat) AS south, max(lat) AS north, round(sum({_METRES}), 0) AS metres FROM g GROUP BY 1""")
def trajectory_summary(spark, d):
    w = Window.partitionBy("entity_id").orderBy("event_time", "memory_id")
    m = memories(spark, d).where("lat is not null")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return m.withColumn("step", step).groupBy("entity_id").agg(
        F.count("*").alias("points"), F.min("event_time").alias("first_ts"), F.max("event_time").alias("last_ts"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.round(F.sum("step"), 0).alias("metres")
    )


@query("unreachable_moves", f"""
WITH {MEMORIES}, s AS (SELECT *, epoch_us(event_time) / 1e6 AS t, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(epoch_us(event_time) / 1e6) OVER w AS lt FROM m WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY event_time, memory_id)),
g AS (SELECT *, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) AS h FROM s)
SELECT memory_id, round({_METRES} / 13.9 - (t - lt), 1) AS late_s, 0.85::DOUBLE AS confidence FROM g WHERE {_METRES} / 13.9 > t - lt""")
def unreachable_moves(spark, d):
    """Memories that can't be reached in time from the one before at 13.9 m/s."""
    w = Window.partitionBy("entity_id").orderBy("event_time", "memory_id")
    m = memories(spark, d).where("lat is not null").withColumn("t", seconds(F.col("event_time")))
    need = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / 13.9
    s = m.select("memory_id", need.alias("need"), (F.col("t") - F.lag("t").over(w)).alias("gap"))
    return s.where("need > gap").select("memory_id", F.round(F.col("need") - F.col("gap"), 1).alias("late_s"), F.lit(0.85).alias("confidence"))


@query("degree_radius", "WITH c AS (SELECT user_id, count(DISTINCT event_type || hour(ts)) AS degree FROM events GROUP BY 1) SELECT user_id, degree, greatest(6, least(20, 6 + 2 * degree)) AS radius FROM c")
def degree_radius(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type", F.hour("ts")).alias("degree"))
    return c.select("user_id", "degree", F.greatest(F.lit(6).cast("long"), F.least(F.lit(20).cast("long"), F.col("degree") * 2 + 6)).alias("radius"))
