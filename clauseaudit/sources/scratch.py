"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names.  Only a master on one machine may name none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def put(x: DataFrame, folder: str, name: str) -> DataFrame:
    """``x``, written to a shared folder and read from there: what follows starts from the written rows, in a lost executor's place too.  What was shuffled
    for them is freed when they are written."""
    conf, schema, key = x.sparkSession.conf, x.schema, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        x.write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        conf.set(key, before)
    return x.sparkSession.read.schema(schema).parquet(f"{folder}/{name}")
