"""Models that users plug in: a function from a batch of texts, run in Arrow batches on the executors.

An embedder maps texts to vectors, a recogniser maps texts to mentions. Each different
text meets an embedder once, and texts whose vectors a cache table holds not at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import mentions
from mnemospark.plans.lineage import cut

Embedder = Callable[[list[str]], list[list[float]]]
#: Texts -> lists of (start, end, label, confidence).
Recogniser = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
#: Texts with fewer mentions, or longer than that, are shown to a recogniser.
FEW_MENTIONS, LONG_TEXT = 2, 30


def embedded(docs: DataFrame, key: str, text: str, model: Embedder, name: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, cache_key, embedding) of all rows, and the new cache (cache_key, embedding); null texts have no vector.

    ``cache`` is what an earlier call returned; cache_key is a digest of the text and the model's name.
    """
    keyed = docs.select(key, F.col(text).alias("t"), F.md5(F.concat(F.col(text), F.lit(":" + name))).alias("cache_key"))
    lacking = keyed.where("t is not null").groupBy("cache_key").agg(F.first("t").alias("t"))
    if cache is not None:
        lacking = lacking.join(cache, "cache_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = model(b.column(1).to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["cache_key", "embedding"])

    made = cut(lacking.select("cache_key", "t").mapInArrow(run, "cache_key string, embedding array<double>"), "embeddings")
    known = made if cache is None else made.unionByName(cache)
    return keyed.select(key, "cache_key").join(known, "cache_key", "left").select(key, "cache_key", "embedding"), known


def capitalised(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """A recogniser without a model: runs of capitalised words are concepts of little trust."""
    return [[(m.start(), m.end(), "CONCEPT", 0.5) for m in re.finditer(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", t)] for t in texts]


def hybrid_mentions(docs: DataFrame, key: str, text: str, model: Recogniser = capitalised) -> DataFrame:
    """(key, start, end, text, label, confidence): the rules' mentions, and the model's where rules find few or a text is long.

    Of mentions that overlap the one that starts first stays, and of those the most trusted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("neg", pa.float64()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [mentions.find(t) for t in texts]
            ask = [i for i, (t, f) in enumerate(zip(texts, found, strict=True)) if t and (len(f) < FEW_MENTIONS or len(t) > LONG_TEXT)]
            for i, more in zip(ask, model([texts[i] for i in ask]) if ask else [], strict=True):
                found[i] = sorted([*found[i], *((s, -c, e, texts[i][s:e], label) for s, e, label, c in more)])
            names = ("start", "neg", "end", "text", "label")
            rows = [[dict(zip(names, r, strict=True)) for r in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [key, "spans"])

    spans = docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {mentions.SPAN}")
    one = spans.select(key, F.explode(mentions.resolved(F.col("spans"))).alias("m"))
    return one.select(key, "m.start", "m.end", "m.text", "m.label", (-F.col("m.neg")).alias("confidence"))


def to_blob(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def from_blob(blob: Column) -> Column:
    """The vector that ``to_blob`` packed."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(blob)
