"""Nearest vectors, text ranking and their mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.vector import cosine, doubles, euclidean
from mnemospark.plans.lineage import cut


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def nearest(vectors: DataFrame, probe: list[float], k: int, vector: str = "embedding", key: str = "vec_id", digits: int = 6) -> DataFrame:
    """Exact top k by cosine, ties by key; every row is scored and each task keeps k."""
    return vectors.select(key, F.round(cosine(doubles(vector), literal(probe)), digits).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_l2(vectors: DataFrame, probe: list[float], k: int, least: float, vector: str = "embedding", key: str = "vec_id", digits: int = 6) -> DataFrame:
    """Top k by 1 / (1 + squared distance) of at least ``least``."""
    d = euclidean(doubles(vector), literal(probe))
    scored = vectors.select(key, F.round(F.lit(1.0) / (F.lit(1.0) + d * d), digits).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def bm25(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold a word of the query.

    Only the query's words are counted, in place; the corpus gives two scalars and one
    document frequency per query word, so no posting is shuffled.
    """
    def count(word: str) -> Column:
        return F.size(F.filter("__t", lambda t: t == word))

    # texts are split once; the narrow counts are written, as both the statistics and the scores read them
    split = docs.select(key, F.split(F.lower(F.col(text)), "[^a-z0-9]+").alias("__t"))
    rows = cut(split.select(key, F.size("__t").alias("__n"), *(count(w).alias(f"__{i}") for i, w in enumerate(words))), "counts")
    stats = rows.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__mean"), *(F.count_if(F.col(f"__{i}") > 0).alias(f"__df{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"__{i}"), F.col(f"__df{i}")
        score = score + F.log(F.lit(1.0) + (F.col("__docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("__n") / F.col("__mean")))
    return rows.crossJoin(F.broadcast(stats)).withColumn("score", score).where("score > 0").select(key, "score")


def hybrid(vector_scores: DataFrame, text_scores: DataFrame, k: int, key: str, weight: float = 0.7) -> DataFrame:
    """weight * vector + (1 - weight) * 1 / (1 + rank) over 2k of either side; a missing side counts 0."""
    v = vector_scores.select(key, F.col("score").alias("v")).orderBy(F.desc("v"), key).limit(2 * k)
    # the 2k best are few; one task ranks them
    t = text_scores.select(key, F.col("score").alias("s")).orderBy(F.desc("s"), key).limit(2 * k)
    t = t.select(key, (F.lit(1.0) / (F.lit(1.0) + F.row_number().over(Window.orderBy(F.desc("s"), key)))).alias("t"))
    mixed = F.coalesce("v", F.lit(0.0)) * weight + F.coalesce("t", F.lit(0.0)) * (1 - weight)
    return v.join(t, key, "full_outer").select(key, F.round(mixed, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
