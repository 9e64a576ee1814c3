"""Window-like operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes each task's rows before the shuffle."""
    name = rank or "__n"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def sessions(df: DataFrame, keys: list[str], at: str, order: list[Column], gap_s: float) -> DataFrame:
    """``df`` with session, numbered from 0 by key; a new one starts when more than ``gap_s`` has passed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (F.col(at) - F.lag(at).over(w) > gap_s).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w).cast("long"))


def revisits(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, visits, avg_gap, next_at): the mean gap is the span over the gaps, the next visit one gap after the last."""
    s = df.groupBy(*keys).agg(F.count("*").alias("visits"), F.min(at).alias("__lo"), F.max(at).alias("__hi")).where("visits > 1")
    gap = (F.col("__hi") - F.col("__lo")) / (F.col("visits") - 1)
    return s.select(*keys, "visits", gap.alias("avg_gap"), (F.col("__hi") + gap).alias("next_at"))


def transitions(df: DataFrame, keys: list[str], state: str, order: list[Column], memory: int = 1) -> DataFrame:
    """(state, next_state, n, p): counts and shares of what follows ``memory`` consecutive states."""
    w = Window.partitionBy(*keys).orderBy(*order)
    parts = [F.lag(state, memory - 1 - i).over(w) if i < memory - 1 else F.col(state) for i in range(memory)]
    known = df.select(*(p.alias(f"__s{i}") for i, p in enumerate(parts)), F.lead(state).over(w).alias("next_state")).dropna()
    n = known.groupBy(F.concat_ws(">", *(f"__s{i}" for i in range(memory))).alias("state"), "next_state").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def without_overlap(spans: Column) -> Column:
    """A sorted array of structs with start and end, less each that starts inside the one kept before it."""
    empty = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(spans, empty, lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))
