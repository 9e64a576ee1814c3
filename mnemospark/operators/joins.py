"""Joins that Spark would plan as nested loops, rewritten as equi-joins over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs whose positions (doubles) differ by at most ``width``.

    The left side is dealt to the buckets beside its own, each right row has one bucket,
    so a pair meets once. Columns of the two sides must not share names but those of ``on``.
    """
    own = F.floor(F.col(right_at) / width)
    first = F.floor(F.col(left_at) / width)
    spread = left.withColumn("__b", F.explode(F.array(first - 1, first, first + 1)))
    return spread.join(right.withColumn("__b", own), ["__b", *(on or [])]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("__b")


def following_first(causes: DataFrame, effects: DataFrame, at: str, effect_at: str, within: float, on: list[str], keys: list[str], effect_order: list[Column]) -> DataFrame:
    """Each cause (``keys``) with its first effect of equal ``on`` after it and less than ``within`` later, strict at both ends."""
    first = F.floor(F.col(at) / within)
    spread = causes.withColumn("__b", F.explode(F.array(first, first + 1)))
    met = spread.join(effects.withColumn("__b", F.floor(F.col(effect_at) / within)), [*on, "__b"])
    gap = F.col(effect_at) - F.col(at)
    w = Window.partitionBy(*keys).orderBy(*effect_order)
    return met.where((gap > 0) & (gap < within)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__b")


def interval_pairs(df: DataFrame, key: str, start: str, end: str, width: float, on: list[str]) -> DataFrame:
    """Pairs (key < other_key) of rows whose closed intervals (in doubles) share a point; each pair once.

    Intervals are dealt to all buckets that they touch; a pair counts in the bucket where the later one starts.
    """
    lo, hi = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    a = df.withColumn("__b", F.explode(F.sequence(lo, hi)))
    b = a.select(*on, "__b", *(F.col(c).alias(f"other_{c}") for c in df.columns if c not in on))
    met = a.join(b, [*on, "__b"]).where(F.col(key) < F.col(f"other_{key}"))
    meet = (F.col(start) <= F.col(f"other_{end}")) & (F.col(f"other_{start}") <= F.col(end))
    return met.where(meet & (F.col("__b") == F.floor(F.greatest(F.col(start), F.col(f"other_{start}")) / width))).drop("__b")


def grid_pairs(df: DataFrame, key: str, x: str, y: str, cell_x: float, cell_y: float, on: list[str]) -> DataFrame:
    """Pairs (key < other_key) of rows in the same or touching cells of a plane grid; each pair once."""
    cx, cy = F.floor(F.col(x) / cell_x), F.floor(F.col(y) / cell_y)
    around = F.explode(F.array(*(F.struct((cx + i).alias("x"), (cy + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = df.withColumn("__c", around)
    b = df.select(*on, F.struct(cx.alias("x"), cy.alias("y")).alias("__c"), *(F.col(c).alias(f"other_{c}") for c in df.columns if c not in on))
    return a.join(b, [*on, "__c"]).where(F.col(key) < F.col(f"other_{key}")).drop("__c")
