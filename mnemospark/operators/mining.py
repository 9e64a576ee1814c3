"""Causes, sequences and counterfactuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.lineage import cut


def contains_in_order(sequence: Column, pattern: list[Column]) -> Column:
    """Whether the pattern's items occur in a sequence in order, gaps allowed."""
    # how many leading items of the pattern have been met so far
    met = F.aggregate(sequence, F.lit(0), lambda n, x: F.when(F.element_at(F.array(*pattern, F.lit(None).cast("string")), n + 1) == x, n + 1).otherwise(n))
    return met == len(pattern)


def frequent_sequences(sequences: DataFrame, least: int, most_length: int = 3, seq: str = "seq") -> DataFrame:
    """(pattern, n, support, confidence) of item sequences of length two and more in at least ``least`` rows.

    Items of a pattern ascend in their order of introduction (by name here), as only such
    pairs are joined; confidence divides by the count of the pattern less its last item.
    """
    total = sequences.agg(F.count("*").alias("total"))
    # a row for each item that a sequence holds: candidates meet sequences by their last item
    held = cut(sequences.select(F.col(seq).alias("seq"), F.explode(F.array_distinct(seq)).alias("last")), "held")
    level = cut(held.groupBy("last").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.array("last").alias("pattern"), "n"), "level")
    out = None
    for length in range(2, most_length + 1):
        head = F.slice("pattern", 1, length - 2) if length > 2 else F.array().cast("array<string>")
        a = level.select(head.alias("head"), F.element_at("pattern", -1).alias("x"), F.col("n").alias("before"))
        b = level.select(head.alias("head"), F.element_at("pattern", -1).alias("y"))
        cands = a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("pattern"), "before", F.col("y").alias("last"))
        test = contains_in_order(F.col("seq"), [F.col("pattern")[i] for i in range(length)])
        met = held.where(F.size("seq") >= length).join(cands, "last").where(test)
        level = cut(met.groupBy("pattern", "before").agg(F.count("*").alias("n")).where(F.col("n") >= least), "level")
        found = level.crossJoin(F.broadcast(total)).select(F.array_join("pattern", ">").alias("pattern"), "n", (F.col("n") / F.col("total")).alias("support"), (F.col("n") / F.col("before")).alias("confidence"))
        out = found if out is None else out.unionByName(found)
        level = level.select("pattern", "n")
    return out


def prefixes(sequences: DataFrame, most_length: int, seq: str = "seq") -> DataFrame:
    """(prefix, n, confidence): how many sequences begin so, and of those that begin with all but the last item."""
    n = sequences.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(seq), F.lit(most_length))), lambda k: F.slice(seq, 1, k))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    shorter = n.select(F.col("p").alias("q"), F.col("n").alias("before"))
    joined = n.withColumn("q", F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0)))).join(shorter, "q", "left")
    return joined.select(F.array_join("p", ">").alias("prefix"), "n", F.when(F.size("p") == 1, 1.0).otherwise(F.col("n") / F.col("before")).alias("confidence"))


def chains(pairs: DataFrame, most_length: int = 3) -> DataFrame:
    """(path, confidence) of causal chains of up to ``most_length`` pairs (cause, effect, confidence); cycles are allowed."""
    level = pairs.select(F.concat_ws(">", "cause", "effect").alias("path"), F.col("effect").alias("end"), "confidence")
    out = level
    step = pairs.select(F.col("cause").alias("end"), F.col("effect").alias("next"), F.col("confidence").alias("c"))
    for _ in range(most_length - 1):
        level = level.join(step, "end").select(F.concat_ws(">", "path", "next").alias("path"), F.col("next").alias("end"), (F.col("confidence") * F.col("c")).alias("confidence"))
        out = out.unionByName(level)
    return out.select("path", "confidence")
