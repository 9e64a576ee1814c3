"""Structured Streaming over event files."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.plans.lineage import shared_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time as a zoned timestamp."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("at", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream gives once all input there is has been read; each batch replaces (complete) or adds."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    write = "overwrite" if mode == "complete" else "append"

    def put(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(path if write == "overwrite" else f"{path}/batch={batch_id}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("at", width)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    s = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy(s.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key, as long as repeats come within the delay."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def fold_memory(items: dict[str, list[float]], rows: list[tuple[float, int, str]], capacity: int, decay_s: float, least: float) -> tuple[dict[str, list[float]], list[tuple]]:
    """Working memory after rows (time, id, item), and what left it.

    An item has an activation that decays; a repeated item is rehearsed (+0.1 and at most
    1). At capacity the weakest item leaves and is consolidated if it is above 0.3; items
    below ``least`` fade, and are consolidated if they were rehearsed.
    """
    out = []
    now = lambda x, t: x[0] * math.exp(-(t - x[1]) / decay_s)
    for t, _, item in sorted(rows):
        for name in [n for n, x in items.items() if n != item and now(x, t) < least]:
            gone = items.pop(name)
            out.append((t, name, "faded", gone[2] > 0))
        if item in items:
            x = items[item]
            items[item] = [min(1.0, now(x, t) + 0.1), t, x[2] + 1]
            continue
        if len(items) >= capacity:
            name = min(items, key=lambda n: (now(items[n], t), n))
            strength = now(items.pop(name), t)
            out.append((t, name, "evicted", strength > 0.3))
        items[item] = [1.0, t, 0]
    return items, out


LEFT = "user_id long, t double, item string, reason string, consolidated boolean"


def working_memory(events: DataFrame, item: str, capacity: int = 7, decay_s: float = 21600.0, least: float = 0.1) -> DataFrame:
    """Rows for items that leave each user's bounded working memory; state is a few numbers per item and user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, strengths, times, counts = state.get if state.exists else ([], [], [], [])
        items = {n: [s, t, c] for n, s, t, c in zip(names, strengths, times, counts, strict=True)}
        rows = [r for f in frames for r in zip(f.t.tolist(), f.event_id.tolist(), f.item.tolist(), strict=True)]
        items, out = fold_memory(items, rows, capacity, decay_s, least)
        state.update((list(items), [x[0] for x in items.values()], [x[1] for x in items.values()], [int(x[2]) for x in items.values()]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["user_id", "t", "item", "reason", "consolidated"])

    rows = events.select("user_id", "event_id", (F.unix_micros("at") / 1e6).alias("t"), F.col(item).alias("item"))
    return rows.groupBy("user_id").applyInPandasWithState(step, LEFT, "names array<string>, strengths array<double>, times array<double>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def maintained(events: DataFrame, act: Callable[[DataFrame, int], None], every: str = "60 seconds", checkpoint: str | None = None):
    """Start a query that hands each minute's batch to ``act`` (batch, id), which must be repeatable by id."""
    where = checkpoint or shared_path(events.sparkSession, "maintenance")
    return events.writeStream.foreachBatch(act).option("checkpointLocation", where).trigger(processingTime=every).start()
