"""The folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder where that is unset and all runs on one machine."""
    global _own
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="spanloom-index-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        at = "file://" + _own
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage and plan end there. Its path is .scratch."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "lz4").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path  # type: ignore[attr-defined]
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
