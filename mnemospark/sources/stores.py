"""Snapshots, key-value records, configuration and further import forms."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.vector import normalised
from mnemospark.sources.importers import save


def snapshot(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write each table below ``path``; ``restore`` reads them back."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def put_records(records: DataFrame, path: str) -> None:
    """Save (key, value JSON, seq) records; of equal keys the highest seq stays. Readers find a key by its hash."""
    save(records.withColumn("slot", F.substring(F.sha2("key", 256), 1, 16)), path, "key", "seq")


def get_records(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if keys is None else rows.where(F.col("key").isin(keys))


def merged_settings(*layers: Mapping[str, object], prefix: str = "MEMO_", environment: Mapping[str, str] | None = None) -> dict[str, object]:
    """Nested settings, later layers over earlier ones, then PREFIX_A__B variables as a.b, typed like what they replace."""

    def over(a: Mapping[str, object], b: Mapping[str, object]) -> dict[str, object]:
        out = dict(a)
        for k, v in b.items():
            out[k] = over(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
        return out

    out: dict[str, object] = {}
    for layer in layers:
        out = over(out, layer)
    for name, text in sorted((environment if environment is not None else os.environ).items()):
        if name.startswith(prefix):
            *path, last = name[len(prefix) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            old = at.get(last)
            at[last] = text.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text) if isinstance(old, (int, float)) else text
    return out


def parse_vcards(files: DataFrame, text: str = "text") -> DataFrame:
    """(name, email, phone) of contact cards."""
    cards = files.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)BEGIN:VCARD(.*?)END:VCARD"))).alias("c"))

    def field(name: str) -> Column:
        v = F.regexp_extract("c", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
        return F.when(v != "", v)

    return cards.select(field("FN").alias("name"), field("EMAIL").alias("email"), field("TEL").alias("phone"))


def photos_as_events(photos: DataFrame) -> DataFrame:
    """Event rows of photo rows; a place without a name is shown by its degrees."""
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string("(%.4f, %.4f)", "lat", "lon"))
    return photos.select(F.concat(F.lit("photo_"), F.substring(F.md5("path"), 1, 12)).alias("event_id"), F.substring_index("path", "/", -1).alias("title"), F.col("taken_time").alias("start_time"), place.alias("location"))


def hashed_embeddings(docs: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, cache_key, embedding): unit vectors of hashed word counts; each different text is embedded once."""
    words = F.filter(F.split(F.lower(F.col("__t")), "[^a-z0-9]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    keyed = docs.select(key, F.col(text).alias("__t"), F.md5(F.concat(F.col(text), F.lit(f":hash{dims}"))).alias("cache_key"))
    once = keyed.groupBy("cache_key").agg(F.first("__t").alias("__t")).select("cache_key", normalised(vector).alias("embedding"))
    return keyed.select(key, "cache_key").join(once, "cache_key", "left")
