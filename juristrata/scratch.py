"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it is unset, a local session gets a folder
    of its own, and a cluster an error: its machines share no temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            root = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="juristrata-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts the lineage, and survives the loss
    of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
