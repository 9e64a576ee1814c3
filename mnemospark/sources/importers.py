"""Calendars, mail, chats, posts and photos as event rows.

Each parser takes a frame with one text or file per row and returns rows; files come in
through Spark's text and binaryFile readers, so any store that Spark reads will do.
"""

from __future__ import annotations

import email
import email.policy
import re
import struct
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import title, without_tags
from mnemospark.functions.time import parsed
from mnemospark.plans.lineage import cut

CALENDAR_TIMES = ("yyyyMMdd'T'HHmmss", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss")
CHAT_TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole text files below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _line(block: Column, name: str) -> Column:
    """Value of a calendar line, parameters aside; null if absent."""
    v = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    return F.when(v != "", F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")))


def parse_ics(files: DataFrame, text: str = "text") -> DataFrame:
    """(event_id, title, start_time, end_time, location, description, participants) of calendar files; events without a start are dropped."""
    blocks = files.select(F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"))).alias("n", "b"))
    when = lambda name: parsed(F.regexp_replace(_line(F.col("b"), name), "Z$", ""), *CALENDAR_TIMES)
    people = F.array_distinct(F.regexp_extract_all("b", F.lit(r"(?i)ATTENDEE[^\r\n]*mailto:([^\r\n;]+)")))
    rows = blocks.select(
        F.coalesce(_line(F.col("b"), "UID"), F.concat(F.lit("event_"), F.col("n").cast("string"))).alias("event_id"),
        F.coalesce(_line(F.col("b"), "SUMMARY"), F.lit("无标题")).alias("title"),
        when("DTSTART").alias("start_time"),
        when("DTEND").alias("end_time"),
        _line(F.col("b"), "LOCATION").alias("location"),
        _line(F.col("b"), "DESCRIPTION").alias("description"),
        people.alias("participants"),
    )
    return rows.where("start_time is not null")


def parse_chat_csv(files: DataFrame, text: str = "text") -> DataFrame:
    """(sent_at, sender, content) of lines time,sender,content; the header is left out and commas in the content stay."""
    lines = files.select(F.posexplode(F.split(text, r"\r?\n")).alias("n", "line")).where("n > 0 and line <> ''")
    parts = F.split("line", ",", 3)
    rows = lines.select(parsed(F.trim(parts[0]), *CHAT_TIMES).alias("sent_at"), F.trim(F.get(parts, F.lit(1))).alias("sender"), F.get(parts, F.lit(2)).alias("content"))
    return rows.where("sent_at is not null and content is not null")


def parse_chat_text(files: DataFrame, text: str = "text") -> DataFrame:
    """(sent_at, sender, content) of lines "time sender: content"."""
    p = r"^(\d{4}[-/]\d{2}[-/]\d{2} \d{2}:\d{2}(?::\d{2})?) ([^:：]+)[:：] ?(.*)$"
    lines = files.select(F.explode(F.split(text, r"\r?\n")).alias("line")).where(F.col("line").rlike(p))
    return lines.select(parsed(F.regexp_extract("line", p, 1), *CHAT_TIMES).alias("sent_at"), F.regexp_extract("line", p, 2).alias("sender"), F.regexp_extract("line", p, 3).alias("content"))


def parse_chat_json(files: DataFrame, text: str = "text") -> DataFrame:
    """(sent_at, sender, content, msg_id) of a JSON list; times are epoch seconds or texts."""
    rows = files.select(F.explode(F.from_json(text, "array<struct<time:string,sender:string,content:string,msg_id:string>>")).alias("m"))
    epoch = F.timestamp_seconds(F.expr("try_cast(m.time as double)")).cast("timestamp_ntz")
    return rows.select(F.coalesce(epoch, parsed(F.col("m.time"), *CHAT_TIMES)).alias("sent_at"), F.coalesce("m.sender", F.lit("未知")).alias("sender"), F.col("m.content").alias("content"), F.col("m.msg_id").alias("msg_id"))


def parse_chat(files: DataFrame, text: str = "text") -> DataFrame:
    """(sent_at, sender, content) of exports in any of the three forms, told apart by their beginning."""
    t = F.ltrim(F.col(text))
    is_json = t.startswith("[")
    is_text = ~is_json & t.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2} [^,\r\n]*[:：] ?")
    cols = ("sent_at", "sender", "content")
    return parse_chat_json(files.where(is_json), text).select(*cols).unionByName(parse_chat_text(files.where(is_text), text)).unionByName(parse_chat_csv(files.where(~is_json & ~is_text), text))


POST = "struct<id:string,created_at:string,text:string,user:struct<screen_name:string>,reposts_count:bigint,comments_count:bigint,attitudes_count:bigint>"


def parse_posts(files: DataFrame, text: str = "text") -> DataFrame:
    """(event_id, title, posted_at, author, content, reposts, comments, likes) of a list of posts or of cards that hold posts."""
    plain = F.from_json(text, f"array<{POST}>", {"mode": "PERMISSIVE"})
    cards = F.transform(F.from_json(text, f"struct<cards:array<struct<mblog:{POST}>>>")["cards"], lambda c: c["mblog"])
    posts = files.select(F.explode(F.when(F.ltrim(F.col(text)).startswith("["), plain).otherwise(cards)).alias("p"))
    body = without_tags(F.col("p.text"))
    # the week day isn't needed, and Spark's formats don't read it
    stamp = F.regexp_replace("p.created_at", r"^[A-Z][a-z]{2} ", "")
    zoned = F.try_to_timestamp(stamp, F.lit("MMM dd HH:mm:ss Z yyyy")).cast("timestamp_ntz")
    return posts.select(
        F.col("p.id").alias("event_id"),
        title(body).alias("title"),
        F.coalesce(zoned, parsed(F.col("p.created_at"), *CHAT_TIMES)).alias("posted_at"),
        F.col("p.user.screen_name").alias("author"),
        body.alias("content"),
        *(F.coalesce(F.col(f"p.{a}_count"), F.lit(0).cast("long")).alias(b) for a, b in (("reposts", "reposts"), ("comments", "comments"), ("attitudes", "likes"))),
    )


MAIL = "event_id string, title string, sent_at timestamp_ntz, participants array<string>, body string"


def parse_mail(data: bytes | None) -> tuple:
    """One message: id, subject, time, distinct addresses, body of at most 2000 characters."""
    m = email.message_from_bytes(data or b"", policy=email.policy.default)
    people: dict[str, None] = {}
    for field in ("From", "To", "Cc", "Bcc"):
        people |= {a.lower(): None for _, a in getaddresses([str(v) for v in m.get_all(field, [])]) if "@" in a}
    part = m.get_body(("plain", "html"))
    body = "" if part is None else part.get_content()
    if part is not None and part.get_content_subtype() == "html":
        body = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", body)).strip()
    try:
        at = parsedate_to_datetime(str(m["Date"])).replace(tzinfo=None)
    except (TypeError, ValueError):
        at = None
    return (str(m["Message-ID"] or ""), str(m["Subject"] or "") or "无主题", at, list(people), body[:2000])


def parse_eml(files: DataFrame, content: str = "content") -> DataFrame:
    """Event rows of mail files (bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parse_mail(bytes(x) if x is not None else None) for x in f.iloc[:, 0]], columns=["event_id", "title", "sent_at", "participants", "body"])

    return files.select(content).mapInPandas(run, MAIL)


def contacts(messages: DataFrame, person: Column, at: str) -> DataFrame:
    """(contact, interaction_count, last_interaction) of message rows with an array of people."""
    return messages.select(F.explode(person).alias("contact"), F.col(at).alias("at")).groupBy("contact").agg(F.count("*").alias("interaction_count"), F.max("at").alias("last_interaction"))


def exif(data: bytes) -> dict[str, object]:
    """Time, maker, model and place of a JPEG file's EXIF block; empty if there is none."""
    at = data.find(b"Exif\0\0")
    if data[:2] != b"\xff\xd8" or at < 0:
        return {}
    t = data[at + 6 :]
    e = "<" if t[:2] == b"II" else ">"
    out: dict[str, object] = {}

    def entries(offset: int) -> dict[int, object]:
        found = {}
        for k in range(struct.unpack_from(e + "H", t, offset)[0]):
            tag, kind, n, _ = struct.unpack_from(e + "HHII", t, offset + 2 + 12 * k)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}.get(kind, 1) * n
            where = offset + 10 + 12 * k if size <= 4 else struct.unpack_from(e + "I", t, offset + 10 + 12 * k)[0]
            if kind == 2:
                found[tag] = t[where : where + n].split(b"\0")[0].decode("ascii", "replace")
            elif kind == 5:
                r = struct.unpack_from(e + "II" * n, t, where)
                found[tag] = [a / b if b else 0.0 for a, b in zip(r[::2], r[1::2], strict=True)]
            elif kind in (3, 4):
                found[tag] = struct.unpack_from(e + {3: "H", 4: "I"}[kind], t, where)[0]
        return found

    try:
        main = entries(struct.unpack_from(e + "I", t, 4)[0])
        sub = entries(main[0x8769]) if 0x8769 in main else {}
        gps = entries(main[0x8825]) if 0x8825 in main else {}
    except struct.error:
        return {}
    out = {"taken": sub.get(0x9003) or main.get(0x0132), "make": main.get(0x010F), "model": main.get(0x0110)}
    for name, value, ref in (("lat", 2, 1), ("lon", 4, 3)):
        if isinstance(v := gps.get(value), list) and len(v) == 3:
            out[name] = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if gps.get(ref) in ("S", "W") else 1)
    return out


PHOTO = "path string, taken_time timestamp_ntz, make string, model string, lat double, lon double"


def photos(files: DataFrame) -> DataFrame:
    """(path, taken_time, make, model, lat, lon) of binaryFile rows; the file's own time stands in for a missing one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, changed, data in zip(f.path, f.modificationTime, f.content, strict=True):
                x = exif(bytes(data))
                taken = pd.to_datetime(x.get("taken"), format="%Y:%m:%d %H:%M:%S", errors="coerce") if x.get("taken") else pd.NaT
                rows.append((path, changed if pd.isna(taken) else taken, x.get("make"), x.get("model"), x.get("lat"), x.get("lon")))
            yield pd.DataFrame(rows, columns=["path", "taken_time", "make", "model", "lat", "lon"])

    shown = files.where(F.lower("path").rlike(r"\.(jpe?g|png|heic|gif|tiff?)$"))
    return shown.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime"), "content").mapInPandas(run, PHOTO)


def save(rows: DataFrame, path: str, key: str, seq: str) -> None:
    """Insert or replace by key into a Parquet table: the row of the highest ``seq`` stays."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else rows.limit(0)
    cut(newest(old.unionByName(rows), key, seq), "save").write.mode("overwrite").parquet(path)


def newest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: that of the highest ``seq``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("__r")).select(*(F.col(f"__r.{c}").alias(c) for c in rows.columns))
