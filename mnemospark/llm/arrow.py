"""Passing columns to Python in batches of bounded memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows that a worker gets at a time; whole texts can be long.
ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    """Give freed memory back to the system; a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, for columns of any names.

    Lowers the session's batch size to ROWS if it is above; Spark reads that setting when the
    plan runs, so it can't be put back here.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= ROWS:
        conf.set(_SETTING, str(ROWS))

    names = df.columns

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.rename_columns(names) for b in batches)
        release()

    # mapInArrow looks columns up by unquoted names
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(released, schema)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores appended until no frame has a column of that name (names differ by more than case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(schema: StructType, more: dict[str, str]) -> StructType:
    """``schema`` with columns of the named types at its end."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out
