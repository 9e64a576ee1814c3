"""Times of day, intervals and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double, fractions kept; the zone plays no part for naive times."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 14), "noon").when((h >= 14) & (h < 18), "afternoon").when((h >= 18) & (h < 22), "evening").otherwise("night")
    )


def day_type(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), "weekend").otherwise("weekday")


def parsed(text: Column, *formats: str) -> Column:
    """The first of the formats that reads the text, as a naive time; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats))


def allen(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Which of Allen's thirteen relations the first interval has to the second."""
    return (
        F.when(e1 < s2, "before")
        .when(e2 < s1, "after")
        .when((s1 == s2) & (e1 == e2), "equals")
        .when(e1 == s2, "meets")
        .when(e2 == s1, "met_by")
        .when((s1 == s2) & (e1 < e2), "starts")
        .when(s1 == s2, "started_by")
        .when((e1 == e2) & (s1 > s2), "finishes")
        .when(e1 == e2, "finished_by")
        .when((s1 > s2) & (e1 < e2), "during")
        .when((s1 < s2) & (e1 > e2), "contains")
        .when(s1 < s2, "overlaps")
        .otherwise("overlapped_by")
    )


def relative_day(word: Column, today: Column) -> Column:
    """ISO date of the words for today, yesterday, tomorrow and the day after; other words stay."""
    days = {"今天": 0, "昨天": -1, "明天": 1, "后天": 2}
    out = F.when(F.lit(False), word)
    for w, n in days.items():
        out = out.when(word == w, F.date_format(F.date_add(today, n), "yyyy-MM-dd"))
    return out.otherwise(word)
