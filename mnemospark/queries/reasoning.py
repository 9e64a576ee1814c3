"""Causes, rules, sequences and counterfactuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.time import seconds
from mnemospark.operators import mining
from mnemospark.operators.windows import sessions
from mnemospark.registry import query, table
from mnemospark.sources.fixtures import MEMORIES, memories


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("t"))


_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"
_CAUSAL = f"""{_E}, p AS (SELECT c.event_type AS cause, x.event_type AS effect, c.event_id, min(x.t - c.t) AS gap
  FROM e c JOIN e x ON c.user_id = x.user_id AND c.event_type < x.event_type AND x.t > c.t AND x.t - c.t < 86400 GROUP BY 1, 2, 3),
k AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
cp AS (SELECT cause, effect, count(*) AS hits, round(count(*) / any_value(a.n), 6) AS confidence, round(count(*) / any_value(b.n), 6) AS support, round(avg(gap), 2) AS avg_gap
  FROM p JOIN k a ON a.event_type = cause JOIN k b ON b.event_type = effect GROUP BY 1, 2)"""


def causal(spark, d):
    """Ordered type pairs: each cause with its first effect within 24 h; shares of causes and effects."""
    e = events(spark, d)
    c = e.select("user_id", F.col("event_type").alias("cause"), F.col("event_id").alias("id"), F.col("t").alias("tc"), F.explode(F.array(F.floor(F.col("t") / 86400), F.floor(F.col("t") / 86400) + 1)).alias("b"))
    x = e.select("user_id", F.col("event_type").alias("effect"), F.col("t").alias("tx"), F.floor(F.col("t") / 86400).alias("b"))
    gap = F.col("tx") - F.col("tc")
    met = c.join(x, ["user_id", "b"]).where((F.col("cause") < F.col("effect")) & (gap > 0) & (gap < 86400)).groupBy("cause", "effect", "id").agg(F.min(gap).alias("gap"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    na, nb = n.select(F.col("event_type").alias("cause"), F.col("n").alias("a")), n.select(F.col("event_type").alias("effect"), F.col("n").alias("b"))
    pairs = met.groupBy("cause", "effect").agg(F.count("*").alias("hits"), F.avg("gap").alias("gap")).join(F.broadcast(na), "cause").join(F.broadcast(nb), "effect")
    return pairs.select("cause", "effect", "hits", F.round(F.col("hits") / F.col("a"), 6).alias("confidence"), F.round(F.col("hits") / F.col("b"), 6).alias("support"), F.round("gap", 2).alias("avg_gap"))


@query("causal_pairs", f"WITH {_CAUSAL} SELECT cause, effect, hits, confidence, support, avg_gap FROM cp WHERE confidence >= 0.3 AND support >= 0.1")
def causal_pairs(spark, d):
    return causal(spark, d).where("confidence >= 0.3 and support >= 0.1")


@query("causal_chains", f"""WITH {_CAUSAL}, q AS (SELECT cause, effect, confidence FROM cp WHERE confidence >= 0.3)
SELECT cause || '>' || effect AS path, round(confidence, 6) AS confidence FROM q
UNION ALL SELECT a.cause || '>' || a.effect || '>' || b.effect, round(a.confidence * b.confidence, 6) FROM q a JOIN q b ON a.effect = b.cause
UNION ALL SELECT a.cause || '>' || a.effect || '>' || b.effect || '>' || c.effect, round(a.confidence * b.confidence * c.confidence, 6) FROM q a JOIN q b ON a.effect = b.cause JOIN q c ON b.effect = c.cause""")
def causal_chains(spark, d):
    return mining.chains(causal(spark, d).where("confidence >= 0.3")).select("path", F.round("confidence", 6).alias("confidence"))


@query("causal_explanations", f"WITH {_CAUSAL} SELECT printf('%s leads to %s in %d cases', cause, effect, hits) AS text FROM cp WHERE confidence >= 0.3")
def causal_explanations(spark, d):
    return causal(spark, d).where("confidence >= 0.3").select(F.format_string("%s leads to %s in %d cases", "cause", "effect", "hits").alias("text"))


def session_sequences(spark, d, gap_s=21600.0):
    """Event types of each user's sessions, in order."""
    s = sessions(events(spark, d), ["user_id"], "t", [F.asc("t"), F.asc("event_id")], gap_s)
    rows = s.groupBy("user_id", "session").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("x"))
    return rows.select("user_id", "session", F.transform("x", lambda r: r["event_type"]).alias("seq"))


_SEQ = f"""{_E}, sx AS (SELECT *, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)),
n AS (SELECT count(*) AS total FROM (SELECT DISTINCT user_id, session FROM sx)),
r AS (SELECT user_id, session, event_type, row_number() OVER (PARTITION BY user_id, session ORDER BY t, event_id) AS i FROM sx),
i1 AS (SELECT event_type AS a, count(DISTINCT (user_id, session)) AS n1 FROM r GROUP BY 1 HAVING count(DISTINCT (user_id, session)) >= 5),
i2 AS (SELECT x.event_type AS a, y.event_type AS b, count(DISTINCT (x.user_id, x.session)) AS n2 FROM r x JOIN r y ON x.user_id = y.user_id AND x.session = y.session AND x.i < y.i AND x.event_type < y.event_type
  WHERE x.event_type IN (SELECT a FROM i1) AND y.event_type IN (SELECT a FROM i1) GROUP BY 1, 2 HAVING count(DISTINCT (x.user_id, x.session)) >= 5)"""


@query("sequence_apriori_len2", f"WITH {_SEQ} SELECT i2.a || '>' || b AS pattern, n2 AS n, round(n2 / total, 6) AS support, round(n2 / n1, 6) AS confidence FROM i2 JOIN i1 ON i1.a = i2.a, n")
def sequence_apriori_len2(spark, d):
    f = mining.frequent_sequences(session_sequences(spark, d), 5, 2)
    return f.select("pattern", "n", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


@query("sequence_apriori_len3", f"""WITH {_SEQ},
i3 AS (SELECT x.event_type AS a, y.event_type AS b, z.event_type AS c, count(DISTINCT (x.user_id, x.session)) AS n3 FROM r x JOIN r y ON x.user_id = y.user_id AND x.session = y.session AND x.i < y.i AND x.event_type < y.event_type
  JOIN r z ON x.user_id = z.user_id AND x.session = z.session AND y.i < z.i AND y.event_type < z.event_type GROUP BY 1, 2, 3 HAVING count(DISTINCT (x.user_id, x.session)) >= 5)
SELECT i3.a || '>' || i3.b || '>' || c AS pattern, n3 AS n, round(n3 / total, 6) AS support, round(n3 / i2.n2, 6) AS confidence FROM i3 JOIN i2 ON i2.a = i3.a AND i2.b = i3.b JOIN i2 o ON o.a = i3.a AND o.b = i3.c, n""")
def sequence_apriori_len3(spark, d):
    f = mining.frequent_sequences(session_sequences(spark, d), 5, 3).where(F.size(F.split("pattern", ">")) == 3)
    return f.select("pattern", "n", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


@query("prefix_trie_counts", f"""WITH {_SEQ}, g AS (SELECT user_id, session, list(event_type ORDER BY i) AS s FROM r GROUP BY 1, 2),
p AS (SELECT s[1:k] AS p, count(*) AS n FROM (SELECT s, unnest(range(1, least(len(s), 3) + 1)) AS k FROM g) GROUP BY 1)
SELECT array_to_string(p.p, '>') AS prefix, p.n, CASE WHEN len(p.p) = 1 THEN 1.0 ELSE round(p.n / q.n, 6) END AS confidence FROM p LEFT JOIN p q ON q.p = p.p[1:len(p.p) - 1]""")
def prefix_trie_counts(spark, d):
    return mining.prefixes(session_sequences(spark, d), 3).select("prefix", "n", F.round("confidence", 6).alias("confidence"))


@query("sequence_insights", f"WITH {_SEQ} SELECT i2.a || '>' || b AS pattern, n2 AS n FROM i2 ORDER BY n2 DESC, pattern LIMIT 3")
def sequence_insights(spark, d):
    return mining.frequent_sequences(session_sequences(spark, d), 5, 2).orderBy(F.desc("n"), "pattern").limit(3).select("pattern", "n")


@query("counterfactual_nearest", f"""
WITH {MEMORIES}, c AS (SELECT entity_id % 10 AS a, k % 10 AS b, memory_layer AS l, memory_type AS outcome, memory_id FROM m),
s AS (SELECT outcome, memory_id, ((a = 3)::INT + (b = 4)::INT + (l = 1)::INT) / 3 AS sim FROM c)
SELECT outcome, round(max(sim), 6) AS sim, arg_min(memory_id, (-sim, memory_id)) AS memory_id, least(1.0, count(*) FILTER (sim > 0.5) / 10) AS confidence FROM s GROUP BY 1""")
def counterfactual_nearest(spark, d):
    """For each outcome the earliest case most like the given conditions."""
    want = {"a": F.col("entity_id") % 10 == 3, "b": F.col("k") % 10 == 4, "l": F.col("memory_layer") == 1}
    sim = sum((c.cast("int") for c in want.values()), F.lit(0)) / 3
    s = memories(spark, d).select(F.col("memory_type").alias("outcome"), "memory_id", sim.alias("sim"))
    best = F.min(F.struct((-F.col("sim")).alias("s"), "memory_id"))
    g = s.groupBy("outcome").agg(F.round(F.max("sim"), 6).alias("sim"), best.alias("b"), F.least(F.lit(1.0), F.count_if(F.col("sim") > 0.5) / 10).alias("confidence"))
    return g.select("outcome", "sim", F.col("b.memory_id").alias("memory_id"), "confidence")


def rule_results(spark, d, rules):
    """Results of named rules as one table (rule, subject, confidence); a rule takes the memories."""
    out = None
    m = memories(spark, d)
    for name, rule in rules.items():
        part = rule(m).select(F.lit(name).alias("rule"), F.col("subject").cast("string").alias("subject"), "confidence")
        out = part if out is None else out.unionByName(part)
    return out


#: Built-in rules; callers add their own.
RULES = {
    "habit": lambda m: m.groupBy("entity_id", "memory_type").agg(F.count("*").alias("n")).where("n >= 20").select(F.concat_ws(":", "entity_id", "memory_type").alias("subject"), F.least(F.col("n") / 10.0, F.lit(0.9)).alias("confidence")),
    "night_owl": lambda m: m.groupBy("entity_id").agg((F.count_if(F.hour("event_time") < 5) / F.count("*")).alias("confidence")).where("confidence > 0.25").select(F.col("entity_id").alias("subject"), F.round("confidence", 6).alias("confidence")),
    "big_value": lambda m: m.where("value > 400").select(F.col("memory_id").alias("subject"), F.lit(0.95).alias("confidence")),
}


@query("rule_inference", f"""WITH {MEMORIES}
SELECT 'habit' AS rule, entity_id || ':' || memory_type AS subject, least(count(*) / 10.0, 0.9)::DOUBLE AS confidence FROM m GROUP BY entity_id, memory_type HAVING count(*) >= 20
UNION ALL SELECT 'night_owl', entity_id::VARCHAR, round(count(*) FILTER (hour(event_time) < 5) / count(*), 6) FROM m GROUP BY entity_id HAVING count(*) FILTER (hour(event_time) < 5) / count(*) > 0.25
UNION ALL SELECT 'big_value', memory_id::VARCHAR, 0.95::DOUBLE FROM m WHERE value > 400""")
def rule_inference(spark, d):
    return rule_results(spark, d, RULES)


@query("recommendation_kinds", """
WITH u AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts, count(*) FILTER (hour(ts) BETWEEN 6 AND 8) AS early FROM events GROUP BY 1),
k AS (SELECT user_id, 'social' AS kind, 3 AS priority FROM u WHERE last_ts < TIMESTAMP '2024-01-29' UNION ALL SELECT user_id, 'time', 1 FROM u WHERE early * 5 > n UNION ALL SELECT user_id, 'habit', 2 FROM u WHERE n >= 80)
SELECT user_id, kind, priority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority) AS rn FROM k) WHERE rn = 1""")
def recommendation_kinds(spark, d):
    """The most urgent kind of advice for each user."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.count_if(F.hour("ts").between(6, 8)).alias("early"))
    kinds = F.array(
        F.when(F.col("early") * 5 > F.col("n"), F.struct(F.lit(1).alias("priority"), F.lit("time").alias("kind"))),
        F.when(F.col("n") >= 80, F.struct(F.lit(2).alias("priority"), F.lit("habit").alias("kind"))),
        F.when(F.col("last_ts") < F.lit("2024-01-29").cast("timestamp_ntz"), F.struct(F.lit(3).alias("priority"), F.lit("social").alias("kind"))),
    )
    return u.select("user_id", F.array_min(F.array_compact(kinds)).alias("k")).where("k is not null").select("user_id", "k.kind", "k.priority")


@query("query_router", """
WITH q(id, text) AS (VALUES (1, 'what did user 12 do'), (2, 'events yesterday'), (3, 'near the office'), (4, 'tell me a story'), (5, 'user 7 at noon'))
SELECT CAST(id AS INTEGER) AS id, CASE WHEN regexp_matches(text, 'user [0-9]+') THEN 'concept' WHEN regexp_matches(text, 'yesterday|today|tomorrow|noon') THEN 'temporal' WHEN regexp_matches(text, 'near|at the|office|home') THEN 'spatial' ELSE 'semantic' END AS strategy FROM q""")
def query_router(spark, d):
    """Strategy by what a question mentions: a person, then a time, then a place, else its meaning."""
    q = spark.createDataFrame([(1, "what did user 12 do"), (2, "events yesterday"), (3, "near the office"), (4, "tell me a story"), (5, "user 7 at noon")], "id int, text string")
    t = F.col("text")
    s = F.when(t.rlike("user [0-9]+"), "concept").when(t.rlike("yesterday|today|tomorrow|noon"), "temporal").when(t.rlike("near|at the|office|home"), "spatial").otherwise("semantic")
    return q.select("id", s.alias("strategy"))
