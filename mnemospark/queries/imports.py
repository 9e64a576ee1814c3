"""Importers on given texts, and typed readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.geo import degrees, in_polygon, valid_point
from mnemospark.plans.lineage import shared_path
from mnemospark.registry import query, table
from mnemospark.sources import importers, stores

ICS = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:a1
SUMMARY:Team meeting\\, weekly
DTSTART;TZID=Asia/Shanghai:20240115T080000
DTEND:20240115T090000Z
LOCATION:Room 5
ATTENDEE;CN=Ann:mailto:ann@x.org
ATTENDEE;CN=Bob:mailto:bob@x.org
END:VEVENT
BEGIN:VEVENT
DTSTART:20240116
END:VEVENT
BEGIN:VEVENT
UID:bad
SUMMARY:No start
END:VEVENT
END:VCALENDAR"""
CSV = "time,sender,content\n2024-01-15 08:00:00,Ann,hello, all\n2024/01/15 09:30,Bob,hi\nbad,Eve,x"
TXT = "2024-01-15 08:00:00 Ann: hello: all\nnoise\n2024-01-15 09:30 Bob: hi"
JSON = '[{"time":"1705305600","sender":"Ann","content":"hello","msg_id":"m1"},{"time":"2024-01-15 09:30:00","content":"hi","msg_id":"m2"}]'
POSTS = '{"cards":[{"mblog":{"id":"p1","created_at":"Mon Jan 15 08:00:00 +0000 2024","text":"<b>Hello</b> world of people who write posts that are longer than fifty","user":{"screen_name":"ann"},"reposts_count":3}},{"mblog":{"id":"p2","created_at":"2024-01-15 09:00:00","text":"short","user":{"screen_name":"bob"},"comments_count":2,"attitudes_count":5}}]}'
EML = b"From: Ann <ann@x.org>\r\nTo: Bob <bob@x.org>, ann@x.org\r\nSubject: Plan\r\nDate: Mon, 15 Jan 2024 08:00:00 +0000\r\nMessage-ID: <1@x.org>\r\nContent-Type: text/html\r\n\r\n<p>Hello <b>Bob</b></p>"


def one(spark, text):
    return spark.createDataFrame([(text,)], "text string")


@query("ics_parse", "SELECT 'a1' AS event_id, 'Team meeting, weekly' AS title, TIMESTAMP '2024-01-15 08:00:00' AS start_time, TIMESTAMP '2024-01-15 09:00:00' AS end_time, 'Room 5' AS location, 'ann@x.org,bob@x.org' AS people UNION ALL SELECT 'event_1', '无标题', TIMESTAMP '2024-01-16 00:00:00', NULL, NULL, ''")
def ics_parse(spark, d):
    return importers.parse_ics(one(spark, ICS)).select("event_id", "title", "start_time", "end_time", "location", F.array_join("participants", ",").alias("people"))


@query("chat_csv_parse", "SELECT TIMESTAMP '2024-01-15 08:00:00' AS sent_at, 'Ann' AS sender, 'hello, all' AS content UNION ALL SELECT TIMESTAMP '2024-01-15 09:30:00', 'Bob', 'hi'")
def chat_csv_parse(spark, d):
    return importers.parse_chat(one(spark, CSV))


@query("chat_text_parse", "SELECT TIMESTAMP '2024-01-15 08:00:00' AS sent_at, 'Ann' AS sender, 'hello: all' AS content UNION ALL SELECT TIMESTAMP '2024-01-15 09:30:00', 'Bob', 'hi'")
def chat_text_parse(spark, d):
    return importers.parse_chat(one(spark, TXT))


@query("chat_json_parse", "SELECT TIMESTAMP '2024-01-15 08:00:00' AS sent_at, 'Ann' AS sender, 'hello' AS content, 'm1' AS msg_id UNION ALL SELECT TIMESTAMP '2024-01-15 09:30:00', '未知', 'hi', 'm2'")
def chat_json_parse(spark, d):
    return importers.parse_chat_json(one(spark, JSON))


@query("weibo_json_parse", "SELECT 'p1' AS event_id, 'Hello world of people who write posts that are lon...' AS title, TIMESTAMP '2024-01-15 08:00:00' AS posted_at, 'ann' AS author, 3::BIGINT AS reposts, 0::BIGINT AS comments, 0::BIGINT AS likes UNION ALL SELECT 'p2', 'short', TIMESTAMP '2024-01-15 09:00:00', 'bob', 0, 2, 5")
def weibo_json_parse(spark, d):
    return importers.parse_posts(one(spark, POSTS)).drop("content")


@query("eml_parse", "SELECT '<1@x.org>' AS event_id, 'Plan' AS title, TIMESTAMP '2024-01-15 08:00:00' AS sent_at, 'ann@x.org,bob@x.org' AS people, 'Hello Bob' AS body")
def eml_parse(spark, d):
    return importers.parse_eml(spark.createDataFrame([(bytearray(EML),)], "content binary")).select("event_id", "title", "sent_at", F.array_join("participants", ",").alias("people"), "body")


@query("contacts_rollup", "SELECT role AS contact, count(*) AS interaction_count, max(turn) AS last_interaction FROM conversations GROUP BY 1")
def contacts_rollup(spark, d):
    return importers.contacts(table(spark, d, "conversations"), F.array("role"), "turn")


@query("events_between", "SELECT event_id, ts FROM events WHERE event_type = 'view' AND ts BETWEEN '2024-01-05' AND '2024-01-06'")
def events_between(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz"))).select("event_id", "ts")


@query("json_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def json_round_trip(spark, d):
    """Rows as JSON texts and back by an explicit schema."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return e.select(F.from_json(F.to_json(F.struct("*")), e.schema.simpleString()[len("struct<") : -1].replace(":", " ")).alias("r")).select("r.*")


@query("export_import_files", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_import_files(spark, d):
    """A table written as JSON lines and as CSV, read back and compared by intersection."""
    n = table(spark, d, "nation")
    a, b = shared_path(spark, "json"), shared_path(spark, "csv")
    n.write.json(a)
    n.write.option("header", True).csv(b)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    return spark.read.schema(schema).json(a).intersect(spark.read.schema(schema).option("header", True).csv(b))


@query("saved_events", "SELECT event_id % 300 AS slot, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def saved_events(spark, d):
    """Two saves into one table; of equal keys the newest row stays."""
    e = table(spark, d, "events").select((F.col("event_id") % 300).alias("slot"), "event_id", "event_type")
    path = shared_path(spark, "saved")
    importers.save(e.where("event_id < 5000"), path, "slot", "event_id")
    importers.save(e.where("event_id >= 5000"), path, "slot", "event_id")
    return spark.read.parquet(path).select("slot", "event_id", "event_type")


@query("gps_degrees", "WITH m AS (SELECT event_id, event_id % 90 AS d, event_id % 60 AS mi, user_id % 60 AS s, CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END AS ref FROM events) SELECT event_id, round(CASE ref WHEN 'S' THEN -1 ELSE 1 END * (d + mi / 60.0::DOUBLE + s / 3600.0::DOUBLE), 6) AS lat FROM m")
def gps_degrees(spark, d):
    e = table(spark, d, "events")
    ref = F.when(F.col("event_id") % 2 == 0, "N").otherwise("S")
    return e.select("event_id", F.round(degrees(F.col("event_id") % 90, F.col("event_id") % 60, F.col("user_id") % 60, ref), 6).alias("lat"))


@query("points_in_polygon", """
WITH p AS (SELECT event_id, (event_id % 97) / 10.0::DOUBLE AS y, (user_id % 89) / 10.0::DOUBLE AS x FROM events),
e(y1, x1, y2, x2) AS (VALUES (1.05::DOUBLE, 1.05::DOUBLE, 1.05::DOUBLE, 7.05::DOUBLE), (1.05, 7.05, 6.05, 7.05), (6.05, 7.05, 3.05, 4.05), (3.05, 4.05, 6.05, 1.05), (6.05, 1.05, 1.05, 1.05))
SELECT event_id FROM p, e GROUP BY event_id, y, x HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * ((x2 - x1) / nullif(y2 - y1, 0))) % 2 = 1""")
def points_in_polygon(spark, d):
    ring = [(1.05, 1.05), (1.05, 7.05), (6.05, 7.05), (3.05, 4.05), (6.05, 1.05)]
    p = table(spark, d, "events").select("event_id", ((F.col("event_id") % 97) / 10.0).alias("y"), ((F.col("user_id") % 89) / 10.0).alias("x"))
    return p.where(in_polygon(F.col("y"), F.col("x"), ring)).select("event_id")


@query("valid_points", "SELECT event_id FROM events WHERE (event_id % 200) - 100 BETWEEN -90 AND 90 AND (user_id % 400) - 200 BETWEEN -180 AND 180")
def valid_points(spark, d):
    e = table(spark, d, "events")
    return e.where(valid_point((F.col("event_id") % 200 - 100).cast("double"), (F.col("user_id") % 400 - 200).cast("double"))).select("event_id")


@query("quarantine", "SELECT CASE WHEN try_cast(p_name[1:2] AS INTEGER) IS NULL THEN 'not_a_number' ELSE 'ok' END AS error_code, count(*) AS n FROM part GROUP BY 1")
def quarantine(spark, d):
    """Rows that can't be read are counted by error, not lost."""
    code = F.when(F.expr("try_cast(substring(p_name, 1, 2) as int)").isNull(), "not_a_number").otherwise("ok")
    return table(spark, d, "part").groupBy(code.alias("error_code")).agg(F.count("*").alias("n"))


VCARD = "BEGIN:VCARD\nFN:Ann Lee\nEMAIL;TYPE=work:ann@x.org\nTEL:+1 555\nEND:VCARD\nBEGIN:VCARD\nFN:Bob\nEND:VCARD"


@query("vcard_parse", "SELECT 'Ann Lee' AS name, 'ann@x.org' AS email, '+1 555' AS phone UNION ALL SELECT 'Bob', NULL, NULL")
def vcard_parse(spark, d):
    return stores.parse_vcards(one(spark, VCARD))


@query("snapshot_restore", "SELECT r_regionkey, r_name FROM region")
def snapshot_restore(spark, d):
    path = shared_path(spark, "snapshot")
    stores.snapshot({"region": table(spark, d, "region")}, path)
    return stores.restore(spark, path, ["region"])["region"].select("r_regionkey", "r_name")


@query("kv_store", "SELECT 'user:' || user_id AS key, max(event_id) AS seq, left(sha256('user:' || user_id), 16) AS slot FROM events GROUP BY user_id")
def kv_store(spark, d):
    """Records put in two parts, then the newest of each key."""
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), F.to_json(F.struct("event_type")).alias("value"), F.col("event_id").alias("seq"))
    path = shared_path(spark, "records")
    stores.put_records(e.where("seq % 2 = 0"), path)
    stores.put_records(e.where("seq % 2 = 1"), path)
    return stores.get_records(spark, path).select("key", "seq", "slot")


@query("hashed_embeddings", """
WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w, md5(text || ':hash64') AS cache_key FROM benchmark),
n AS (SELECT item_id, cache_key, len(w) AS n FROM t)
SELECT item_id, cache_key, n > 0 AS filled FROM n""")
def hashed_embeddings(spark, d):
    h = stores.hashed_embeddings(table(spark, d, "benchmark"), "item_id", "text")
    return h.select("item_id", "cache_key", F.exists("embedding", lambda x: x > 0).alias("filled"))
