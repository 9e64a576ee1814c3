"""Durable intermediate tables and access to the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster use --py-files or an installed wheel)."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder named by spark.checkpoint.dir.

    Where the setting is absent a local master gets a temporary folder of its own;
    any other master must name one, since its executors share no local disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        where = _LOCAL["dir"]
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later stages restart from there.

    Its shuffle files are deleted once it is written, since nothing reads them any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned, once nothing reads them any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
