"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Without one a local
    session gets a temporary folder; on a cluster that would lose rows without an error, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pagelens-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: lineage ends here, and a lost executor costs
    the tasks it ran, not the whole plan."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """A written table that stays until release(): results are lazy and may read it."""
    return written(df, name)[0]


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; call it when its results have been saved."""
    remove(spark, _scratch(spark))
