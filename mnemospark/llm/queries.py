"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, chat, decontaminate, html, media, pii, simhash, toxicity, warc, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary that the contracts of queries 5 and 6 name.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, VOCABULARY, more=()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from the shard files."""
    return wavelet.read_shards(wavelet.write_shards(_table(spark, sf_dir, "documents"), VOCABULARY))


@_query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    found = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("__spans")

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "term")
    return pii.sanitise(docs).select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    leaks = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


_SHINGLES = """
SELECT id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (
  SELECT id, w, len(w) AS n, unnest(range(len(w) - 4)) AS p FROM (
    SELECT {id} AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}))
"""
ORACLES["op8_decontamination"] = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
k AS (SELECT id AS item_id, n, g, count(*) AS c FROM b GROUP BY ALL),
hit AS (SELECT d.id AS doc_id, d.n AS doc_n, p, d.g, item_id, k.n AS n, c FROM d JOIN k ON d.g = k.g),
s AS (SELECT DISTINCT doc_id, doc_n, item_id, n, p AS start_word FROM hit),
o AS (SELECT s.doc_id, s.doc_n, s.item_id, s.n, start_word, hit.g, least(count(*), any_value(c)) AS m
      FROM s JOIN hit ON s.doc_id = hit.doc_id AND s.item_id = hit.item_id AND p >= start_word AND p < start_word + s.n - 4 GROUP BY ALL),
r AS (SELECT doc_id, item_id, n, start_word, sum(m) AS shared, least(n - 4, doc_n - 4 - start_word) AS a FROM o GROUP BY ALL),
q AS (SELECT *, shared / (n - 4 + a - shared) AS similarity FROM r)
SELECT doc_id, item_id, CAST(arg_min(start_word, (-similarity, start_word)) AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, round(max(similarity), 6) AS similarity
FROM q WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id, n
"""


#: Documents are rejected from this score on.
TOXIC = 0.7


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= TOXIC).cast("int").alias("predicted"), F.col("__evidence").alias("evidence")
    )


@_query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


@_query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its text form, and of one that quotes marks."""
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_turns(chat.turns_of_table(rows)))


ORACLES["op7_chat_format"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT * FROM r)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + length(replace(replace(text, '\', '\\'), '<|', '\l|')) + length(replace(replace(replace(replace(role, '\', '\\'), '<|', '\l|'), '|', '\p'), chr(10), '\n'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@_query
def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy class of every vector of ``embeddings``, drawn as an image, and the class's size; no table holds images."""
    return media.copies(media.rendered(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
