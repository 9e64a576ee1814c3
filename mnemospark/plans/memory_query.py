"""A declarative memory query and the plan it compiles to."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.geo import in_box

SORTS = {
    "time_desc": [F.desc, "event_time"],
    "time_asc": [F.asc, "event_time"],
    "importance": [F.desc, "confidence"],
    "access_count": [F.desc, "k"],
}


@dataclass
class MemoryQuery:
    """Conditions that all hold, then order, offset and limit; ids break ties."""

    memory_type: str | None = None
    keyword: str | None = None
    since: str | None = None
    until: str | None = None
    box: tuple[float, float, float, float] | None = None  # south, north, west, east
    tags: list[str] = field(default_factory=list)
    least_confidence: float | None = None
    entity_id: int | None = None
    sort: str = "time_desc"
    limit: int | None = 100
    offset: int = 0

    def condition(self) -> Column:
        parts = [F.lit(True)]
        if self.memory_type is not None:
            parts.append(F.col("memory_type") == self.memory_type)
        if self.keyword is not None:
            parts.append(F.col("content").contains(self.keyword) | F.exists("tags", lambda t: t.contains(self.keyword)))
        if self.since is not None:
            parts.append(F.col("event_time") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until is not None:
            parts.append(F.col("event_time") <= F.lit(self.until).cast("timestamp_ntz"))
        if self.box is not None:
            # a memory without a place passes, as in the general query; spatial queries proper ask for one
            parts.append(F.col("lat").isNull() | in_box(F.col("lat"), F.col("lon"), *self.box))
        if self.tags:
            parts.append(F.size(F.array_except(F.array(*map(F.lit, self.tags)), F.col("tags"))) == 0)
        if self.least_confidence is not None:
            parts.append(F.col("confidence") >= self.least_confidence)
        if self.entity_id is not None:
            parts.append(F.col("entity_id") == self.entity_id)
        return reduce(lambda a, b: a & b, parts)

    def plan(self, memories: DataFrame) -> DataFrame:
        order, by = SORTS[self.sort]
        out = memories.where(self.condition())
        if self.limit is None and not self.offset:
            return out
        out = out.orderBy(order(by), "memory_id")
        out = out.offset(self.offset) if self.offset else out
        return out if self.limit is None else out.limit(self.limit)


def page(memories: DataFrame, query: MemoryQuery) -> DataFrame:
    """The query's page with total, the number of all matching rows, in each row."""
    total = memories.where(query.condition()).agg(F.count("*").alias("total"))
    return query.plan(memories).crossJoin(F.broadcast(total))
