"""Files that tasks write to and read from the folder all executors share."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame

#: Most tasks that one list of files is dealt to.
MOST_TASKS = 4096


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark names it (file:/x and bare paths included)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a whole new file; its name must be unique to the attempt that writes it."""
    where, path = open_fs(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path, compression=None) as f:
        f.write(data)


def read_file(uri: str) -> bytes:
    where, path = open_fs(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


def spread_files(files: DataFrame) -> DataFrame:
    """Rows of a small table of file names, dealt to a task each (or to MOST_TASKS of them).

    The number is explicit, since Spark would put a list this small into one task.
    """
    n = max(1, min(files.count(), MOST_TASKS))
    return files.repartition(n, "path")
