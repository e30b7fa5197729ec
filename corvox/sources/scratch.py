"""Written intermediate tables in the folder that the driver and all executors share.

Spark cannot tell when the last reader of such a table is done, so whoever owns
spark.checkpoint.dir clears the corvox-* folders in it after a job, or calls cleared().
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: Rows in memory take up to so many times the bytes of their Parquet files.
EXPANSION = "10"
FACTOR = "spark.sql.sources.fileCompressionFactor"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, on a local session only.

    Also tells a session that has no factor of its own what Parquet takes in memory, as Spark
    else broadcasts tables through the driver by their size on disk.
    """
    if spark.conf.get(FACTOR, "1.0") == "1.0":
        spark.conf.set(FACTOR, EXPANSION)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/corvox-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place for a table below folder()."""
    return f"{folder(spark)}/corvox-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read again: lineage ends there, so a lost executor costs only the current stage."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, tag: str, **values: Column) -> tuple:
    """stored(), and aggregates of its rows that are taken while they are written, without a job of their own; of no rows, counts are 0 and the rest is null."""
    path, seen = scratch(df.sparkSession, tag), Observation()
    df.observe(seen, *(v.alias(k) for k, v in values.items())).write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    got = seen.get
    if set(got) != set(values):  # a plan that was found empty beforehand has no one to observe it
        got = kept.agg(*(v.alias(k) for k, v in values.items())).first().asDict()
    return kept, *(got[k] for k in values)


def cleared(spark: SparkSession) -> int:
    """Deletes all written intermediate tables; results that still read them are lost. Returns how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in system.listStatus(path) if x.getPath().getName().startswith("corvox-")] if system.exists(path) else []
    for x in found:
        system.delete(x, True)
    return len(found)
