"""Additive decomposition, lag weights and forecasts of one series per key.

A series is ordered and numbered within its key, so many series are fitted at once; a
single long series should be aggregated to its step first, as here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, key: str, at: str) -> DataFrame:
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1).cast("long"))


def decomposed(series: DataFrame, key: str = "series", value: str = "value", season: int = 24) -> DataFrame:
    """``series`` (with idx) with trend, seasonal and residual: least squares on idx, then means by idx modulo season."""
    fit = series.groupBy(key).agg(F.regr_slope(value, "idx").alias("slope"), F.regr_intercept(value, "idx").alias("intercept"))
    t = series.join(F.broadcast(fit), key).withColumn("trend", F.col("intercept") + F.col("slope") * F.col("idx"))
    rest = F.col(value) - F.col("trend")
    t = t.withColumn("seasonal", F.avg(rest).over(Window.partitionBy(key, F.col("idx") % season)))
    return t.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def forecast(parts: DataFrame, steps: int, z: float = 1.96, key: str = "series", season: int = 24) -> DataFrame:
    """(series, step, value, low, high) after the last row of each decomposed series."""
    s = parts.groupBy(key).agg(F.max("idx").alias("last"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    by = parts.groupBy(key, (F.col("idx") % season).alias("phase")).agg(F.first("seasonal").alias("seasonal"))
    ahead = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    ahead = ahead.withColumn("phase", (F.col("last") + F.col("step")) % season).join(by, [key, "phase"], "left")
    value = F.col("intercept") + F.col("slope") * (F.col("last") + F.col("step")) + F.coalesce("seasonal", F.lit(0.0))
    margin = F.col("rms") * z * (F.lit(1.0) + F.col("step") * 0.1)
    return ahead.select(key, "step", value.alias("value"), (value - margin).alias("low"), (value + margin).alias("high"))


def lag_weights(series: DataFrame, key: str = "series", value: str = "value", lags: int = 10) -> DataFrame:
    """(series, w1 .. wn): mean lagged products over the sum of their sizes; series of at least 2n rows."""
    w = Window.partitionBy(key).orderBy("idx")
    lagged = series.select(key, value, *(F.lag(value, i).over(w).alias(f"l{i}") for i in range(1, lags + 1)))
    means = lagged.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(F.col(value) * F.col(f"l{i}")).alias(f"m{i}") for i in range(1, lags + 1))).where(F.col("n") >= 2 * lags)
    total = sum((F.abs(F.col(f"m{i}")) for i in range(1, lags + 1)), F.lit(0.0))
    return means.select(key, *((F.col(f"m{i}") / F.nullif(total, F.lit(0.0))).alias(f"w{i}") for i in range(1, lags + 1)))


def recursive_forecast(series: DataFrame, weights: DataFrame, steps: int, key: str = "series", value: str = "value", lags: int = 10) -> DataFrame:
    """(series, step, value): each step is the weighted sum of the values before it, forecasts included."""
    top = series.groupBy(key).agg(F.max("idx").alias("__last"))
    tail = series.join(top, key).where(F.col("idx") > F.col("__last") - lags).groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v"))))).alias("t"))
    w = F.array(*(F.col(f"w{i}") for i in range(1, lags + 1)))
    start = F.transform("t", lambda s: s["v"])  # latest first

    def step(h, i):
        nxt = F.aggregate(F.zip_with(F.slice(h, 1, lags), w, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
        return F.concat(F.array(nxt), h)

    out = tail.join(weights, key).select(key, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("h"))
    return out.select(key, F.posexplode(F.reverse(F.slice("h", 1, steps))).alias("at", "value")).select(key, (F.col("at") + 1).alias("step"), "value")
