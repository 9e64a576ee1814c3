"""Text rules, privacy and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.functions.time import relative_day
from mnemospark.operators import mentions
from mnemospark.registry import query, table

#: Notes of one person, for rules on Chinese text.
NOTES = [
    (1, "早上9点和王小明在华为大厦开了例会，讨论新的预算", "2024-01-15T08:00:00", 39.9042, 116.4074),
    (2, "下午4点陪妈妈去协和医院，见了陈教授", "2024-01-15T15:00:00", 39.96, 116.30),
    (3, "晚上跟同事去看电影，地铁上遇到林老师", "2024-01-15T19:30:00", 39.915, 116.415),
    (4, "昨天跑步5公里，在公园门口碰见Alice", "2024-01-14T18:00:00", 39.92, 116.40),
    (5, "2024年1月10日出差到上海，住在江边酒店", "2024-01-10T10:00:00", 39.93, 116.42),
    (6, "周五约了赵敏女士谈合同，电话13912345678", "2024-01-09T10:00:00", 39.93, 116.42),
]
_NOTES = "notes(id, text, stamp, lat, lon) AS (VALUES " + ", ".join(f"({i}, '{t}', '{s}', {a}::DOUBLE, {o}::DOUBLE)" for i, t, s, a, o in NOTES) + ")"


def notes(spark):
    return spark.createDataFrame(NOTES, "id int, text string, stamp string, lat double, lon double")


@query("mask_pii", r"""SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1) AS found,
 CASE WHEN length(split_part(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '@', 1)) <= 2 THEN repeat('*', length(split_part(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '@', 1)))
 ELSE left(split_part(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '@', 1), 1) || repeat('*', length(split_part(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '@', 1)) - 2) || right(split_part(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '@', 1), 1) END
 || '@' || split_part(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), '@', 2) AS masked
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')""")
def mask_pii(spark, d):
    m = F.regexp_extract("text", f"({tx.EMAIL})", 1)
    return table(spark, d, "documents").where(F.col("text").rlike(tx.EMAIL)).select("doc_id", m.alias("found"), tx.masked_email(m).alias("masked"))


@query("anonymize_ids", "SELECT c_custkey, left(sha256(c_name), 16) AS token FROM customer")
def anonymize_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.anonymous(F.col("c_name")).alias("token"))


_LEVEL = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(p)}') THEN '{k}'" for k, p in tx.LEVELS.items())


@query("classify_documents", f"SELECT doc_id, CASE {_LEVEL} ELSE 'PUBLIC' END AS level FROM documents WHERE text IS NOT NULL")
def classify_documents(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.classification(F.col("text")).alias("level"))


_KEYS = ("Kind", "access_token", "Home_Address", "location", "credential")


@query("redact_map", "SELECT event_id, event_type AS kind, '***REDACTED***' AS access_token, '***REDACTED***' AS home_address, '***REDACTED***' AS location, CAST(user_id AS VARCHAR) AS credential FROM events")
def redact_map(spark, d):
    values = (F.col("event_type"), F.col("user_id").cast("string"), F.col("event_type"), F.col("event_type"), F.col("user_id").cast("string"))
    m = F.create_map(*(x for k, v in zip(_KEYS, values, strict=True) for x in (F.lit(k), v)))
    return table(spark, d, "events").select("event_id", tx.redacted(m).alias("m")).select("event_id", *(F.col("m")[k].alias(k.lower()) for k in _KEYS))


@query("language_detect", f"WITH {_NOTES}, t AS (SELECT CAST(id AS BIGINT) AS id, text FROM notes UNION ALL SELECT 1000 + doc_id, text FROM documents WHERE text IS NOT NULL) SELECT id, CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) / nullif(length(replace(text, ' ', '')), 0) > 0.3 THEN 'zh' ELSE 'en' END AS language FROM t")
def language_detect(spark, d):
    t = notes(spark).select(F.col("id").cast("long").alias("id"), "text").unionByName(table(spark, d, "documents").where("text is not null").select((F.col("doc_id") + 1000).alias("id"), "text"))
    return t.select("id", tx.language(F.col("text")).alias("language"))


_COMPLEX = " + ".join(f"contains(lower(text), '{w}')::INT" for w in tx.COMPLEX_WORDS)


@query("complexity_class", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{'|'.join(tx.SIMPLE_STARTS)}') OR length(text) < 20 THEN 'SIMPLE' WHEN ({_COMPLEX}) >= 2 OR len(regexp_extract_all(text, '[?？,]')) >= 2 OR length(text) > 200 THEN 'COMPLEX'
WHEN ({_COMPLEX}) >= 1 OR length(text) > 100 THEN 'MODERATE' ELSE 'SIMPLE' END AS class FROM conversations WHERE text IS NOT NULL""")
def complexity_class(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", tx.complexity(F.col("text")).alias("class"))


@query("html_to_text", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages WHERE html IS NOT NULL")
def html_to_text(spark, d):
    return table(spark, d, "pages").where("html is not null").select("page_id", F.md5(tx.without_tags(F.col("html"))).alias("digest"))


@query("extract_emails", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS email FROM documents")
def extract_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.emails(F.col("text"))).alias("email"))


@query("ner_regex_contacts", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, 'https?://[^\s]+')) AS urls, len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ips FROM documents WHERE text IS NOT NULL")
def ner_regex_contacts(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").where("text is not null").select("doc_id", n(tx.EMAIL).alias("emails"), n(r"https?://[^\s]+").alias("urls"), n(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}").alias("ips"))


@query("ner_english_names", r"SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{1,10}'))) AS name FROM benchmark")
def ner_english_names(spark, d):
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{1,10})")))
    return table(spark, d, "benchmark").select("item_id", F.explode(names).alias("name"))


@query("ner_inline_zh")
def ner_inline_zh(spark, d):
    return mentions.mentions(notes(spark), "id", "text")


@query("relation_triples")
def relation_triples(spark, d):
    n = notes(spark)
    return mentions.relations(mentions.mentions(n, "id", "text"), n, "id", "text")


@query("notes_on_day", f"WITH {_NOTES} SELECT id FROM notes WHERE stamp LIKE '2024-01-15%'")
def notes_on_day(spark, d):
    return notes(spark).where(F.to_date(F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd'T'HH:mm:ss"))) == F.lit("2024-01-15").cast("date")).select("id")


@query("relative_dates", "WITH w(id, word) AS (VALUES (1, '今天'), (2, '昨天'), (3, '明天'), (4, '后天'), (5, '前天')) SELECT CAST(id AS INTEGER) AS id, CASE word WHEN '今天' THEN '2024-01-15' WHEN '昨天' THEN '2024-01-14' WHEN '明天' THEN '2024-01-16' WHEN '后天' THEN '2024-01-17' ELSE word END AS value FROM w")
def relative_dates(spark, d):
    w = spark.createDataFrame([(1, "今天"), (2, "昨天"), (3, "明天"), (4, "后天"), (5, "前天")], "id int, word string")
    return w.select("id", relative_day(F.col("word"), F.lit("2024-01-15").cast("date")).alias("value"))


@query("concept_ids", "SELECT DISTINCT event_type, lower(event_type) || '_' || left(md5(event_type), 8) AS concept_id FROM events")
def concept_ids(spark, d):
    return table(spark, d, "events").select("event_type").distinct().select("event_type", tx.concept_id(F.col("event_type"), F.col("event_type")).alias("concept_id"))


@query("memory_titles", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS title FROM documents WHERE text IS NOT NULL")
def memory_titles(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.title(F.col("text")).alias("title"))
