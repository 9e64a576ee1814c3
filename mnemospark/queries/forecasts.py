"""Time series, routines and people."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.time import seconds
from mnemospark.operators import forecast
from mnemospark.operators.windows import top_per_key
from mnemospark.registry import query, table


def hourly(spark, d):
    """Hourly sums of each event type, numbered."""
    h = table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("moment")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return forecast.numbered(h.select("series", "moment", (F.col("cents") / 100.0).alias("value")), "series", "moment")


_S = """
h AS (SELECT event_type AS series, date_trunc('hour', ts) AS moment, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100.0 AS value FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY moment) - 1 AS idx FROM h)"""
_D = f"""{_S},
f AS (SELECT series, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept FROM s GROUP BY 1),
t AS (SELECT s.*, slope, intercept, intercept + slope * idx AS trend FROM s JOIN f USING (series)),
p AS (SELECT *, avg(value - trend) OVER (PARTITION BY series, idx % 24) AS seasonal FROM t),
r AS (SELECT *, value - trend - seasonal AS residual FROM p)"""


@query("ts_decompose", f"WITH {_D} SELECT series, moment, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(residual, 4) AS residual FROM r")
def ts_decompose(spark, d):
    return forecast.decomposed(hourly(spark, d)).select("series", "moment", *(F.round(c, 4).alias(c) for c in ("trend", "seasonal", "residual")))


@query("ts_forecast", f"""
WITH {_D}, g AS (SELECT series, max(idx) AS last, any_value(slope) AS slope, any_value(intercept) AS intercept, sqrt(avg(residual * residual)) AS rms FROM r GROUP BY 1),
y AS (SELECT series, idx % 24 AS phase, any_value(seasonal) AS seasonal FROM r GROUP BY 1, 2), a AS (SELECT g.*, unnest(range(1, 13)) AS step FROM g)
SELECT a.series, CAST(step AS INTEGER) AS step, round(intercept + slope * (last + step) + seasonal, 4) AS value,
  round(intercept + slope * (last + step) + seasonal - 1.96 * rms * (1 + 0.1 * step), 4) AS low, round(intercept + slope * (last + step) + seasonal + 1.96 * rms * (1 + 0.1 * step), 4) AS high
FROM a JOIN y ON a.series = y.series AND (last + step) % 24 = phase""")
def ts_forecast(spark, d):
    return forecast.forecast(forecast.decomposed(hourly(spark, d)), 12).select("series", "step", *(F.round(c, 4).alias(c) for c in ("value", "low", "high")))


@query("ts_anomalies", f"WITH {_D}, g AS (SELECT *, sqrt(avg(residual * residual) OVER (PARTITION BY series)) AS rms FROM r) SELECT series, moment, round(residual / rms, 4) AS score FROM g WHERE abs(residual / rms) > 2.0")
def ts_anomalies(spark, d):
    parts = forecast.decomposed(hourly(spark, d))
    rms = F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(Window.partitionBy("series")))
    return parts.withColumn("score", F.try_divide(F.col("residual"), rms)).where(F.abs("score") > 2.0).select("series", "moment", F.round("score", 4).alias("score"))


_M = ", ".join(f"avg(value * l{i}) AS m{i}" for i in range(1, 11))
_L = ", ".join(f"lag(value, {i}) OVER w AS l{i}" for i in range(1, 11))
_TOTAL = " + ".join(f"abs(m{i})" for i in range(1, 11))
_W = f"""l AS (SELECT series, value, {_L} FROM s WINDOW w AS (PARTITION BY series ORDER BY idx)),
m AS (SELECT series, {_M} FROM l GROUP BY 1 HAVING count(*) >= 20), w AS (SELECT series, {", ".join(f"m{i} / ({_TOTAL}) AS w{i}" for i in range(1, 11))} FROM m)"""


@query("ar_weights", f"WITH {_S}, {_W} SELECT series, {', '.join(f'round(w{i}, 6) AS w{i}' for i in range(1, 11))} FROM w")
def ar_weights(spark, d):
    return forecast.lag_weights(hourly(spark, d)).select("series", *(F.round(f"w{i}", 6).alias(f"w{i}") for i in range(1, 11)))


def _unrolled() -> str:
    out = []
    for k in range(1, 6):
        value = " + ".join(f"w{i} * {f'x{i - k + 1}' if i >= k else f'f{k - i}'}" for i in range(1, 11))
        out.append(f"q{k} AS (SELECT *, {value} AS f{k} FROM {'q0' if k == 1 else f'q{k - 1}'})")
    return ", ".join(out)


@query("ar_forecast", f"""
WITH {_S}, {_W}, b AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS rn, value FROM s),
q0 AS (SELECT w.*, {", ".join(f"max(CASE WHEN rn = {i} THEN value END) AS x{i}" for i in range(1, 11))} FROM b JOIN w USING (series) WHERE rn <= 10 GROUP BY ALL), {_unrolled()}
SELECT series, step, round(CASE step {" ".join(f"WHEN {k} THEN f{k}" for k in range(1, 6))} END, 4) AS value FROM (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM q5)""")
def ar_forecast(spark, d):
    s = hourly(spark, d)
    return forecast.recursive_forecast(s, forecast.lag_weights(s), 5).select("series", "step", F.round("value", 4).alias("value"))


@query("person_next_meeting", """
WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events),
p AS (SELECT user_id, count(*) AS n, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), c AS (SELECT user_id, count(*) AS m FROM e WHERE event_type = 'view' GROUP BY 1), a AS (SELECT count(*) AS total FROM e)
SELECT p.user_id, round(n / total * exp(-floor((1706659200 - hi) / 86400) / 30) * (1 + coalesce(m, 0) / n), 7) AS probability, CASE WHEN n > 1 THEN round((hi + (hi - lo) / (n - 1) - 1704067200) / 86400, 5) END AS next_day
FROM p LEFT JOIN c USING (user_id) CROSS JOIN a""")
def person_next_meeting(spark, d):
    """Share of all meetings, decayed by whole days, raised by the share in context; days counted from 2024-01-01."""
    e = table(spark, d, "events").select("user_id", "event_type", seconds(F.col("ts")).alias("t"))
    p = e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_if(F.col("event_type") == "view").alias("m"))
    total = e.agg(F.count("*").alias("total"))
    prob = F.col("n") / F.col("total") * F.exp(-F.floor((F.lit(1706659200) - F.col("hi")) / 86400) / 30.0) * (F.lit(1.0) + F.col("m") / F.col("n"))
    nxt = F.when(F.col("n") > 1, F.round((F.col("hi") + (F.col("hi") - F.col("lo")) / (F.col("n") - 1) - 1704067200) / 86400, 5))
    return p.crossJoin(F.broadcast(total)).select("user_id", F.round(prob, 7).alias("probability"), nxt.alias("next_day"))


@query("person_for_context", "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rn FROM c) SELECT event_type, user_id, round(n / total, 6) AS share FROM r WHERE rn <= 5")
def person_for_context(spark, d):
    c = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    total = c.groupBy("event_type").agg(F.sum("n").alias("total"))
    best = top_per_key(c, ["event_type"], [F.desc("n"), F.asc("user_id")], 5)
    return best.join(F.broadcast(total), "event_type").select("event_type", "user_id", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("location_stats", """
WITH p AS (SELECT event_type, count(*) AS visits, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span FROM events GROUP BY 1)
SELECT event_type, visits, round(visits / sum(visits) OVER (), 6) AS share, round(span / (visits - 1), 6) AS avg_interval_h, round(visits / (span / 168), 4) AS per_week, first_ts, last_ts FROM p WHERE visits > 1""")
def location_stats(spark, d):
    span = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 3.6e9
    p = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("visits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), span.alias("span")).where("visits > 1")
    share = F.col("visits") / F.sum("visits").over(Window.partitionBy())
    return p.select("event_type", "visits", F.round(share, 6).alias("share"), F.round(F.col("span") / (F.col("visits") - 1), 6).alias("avg_interval_h"), F.round(F.col("visits") / (F.col("span") / 168), 4).alias("per_week"), "first_ts", "last_ts")


@query("network_insights", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, sum(n) AS n, arg_min(event_type, (-n, event_type)) AS context FROM c GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, context FROM p ORDER BY n DESC, user_id LIMIT 10""")
def network_insights(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = c.groupBy("user_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"].alias("context"))
    return p.orderBy(F.desc("total"), "user_id").limit(10).select("user_id", F.col("total").alias("n"), "context")


@query("relationship_strength", "SELECT user_id, date_trunc('week', ts) AS week, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'strong' WHEN count(*) >= 2 THEN 'regular' ELSE 'weak' END AS strength FROM events GROUP BY 1, 2")
def relationship_strength(spark, d):
    n = table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"))
    return n.withColumn("strength", F.when(F.col("n") >= 5, "strong").when(F.col("n") >= 2, "regular").otherwise("weak"))


@query("daily_routine", """
WITH c AS (SELECT hour(ts) AS h, event_type, count(*) AS n FROM events WHERE hour(ts) IN (7, 9, 12, 18, 22) GROUP BY 1, 2)
SELECT CAST(h AS INTEGER) AS hour, arg_min(event_type, (-n, event_type)) AS event_type, round(max(n) / sum(n), 6) AS probability FROM c GROUP BY 1""")
def daily_routine(spark, d):
    c = table(spark, d, "events").where(F.hour("ts").isin(7, 9, 12, 18, 22)).groupBy(F.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"]
    return c.groupBy("hour").agg(best.alias("event_type"), F.round(F.max("n") / F.sum("n"), 6).alias("probability"))


@query("ewma_hours", """
WITH RECURSIVE c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (hour(ts) < 12) AS m FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM c),
r(i, v) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT o.i, 0.9 * v + 0.1 * m / n FROM r JOIN o ON o.i = r.i + 1)
SELECT i, round(v, 8) AS v FROM r WHERE i > 0""")
def ewma_hours(spark, d):
    """Running 0.9 v + 0.1 x over days of the share of events before noon; one value per day, folded in order."""
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.hour("ts") < 12) / F.count("*")).alias("x"))
    xs = c.agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("xs"))
    fold = F.aggregate("xs", F.array().cast("array<double>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) * 0.9 + s["x"] * 0.1)))
    return xs.select(F.posexplode(fold).alias("at", "v")).select((F.col("at") + 1).cast("long").alias("i"), F.round("v", 8).alias("v"))
