"""Scratch tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; under a local one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints/lexengine"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to a scratch table and read back."""
    path = f"{scratch_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes this application's scratch tables; what reads them must have been written elsewhere by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
