"""Tables in the folder that all executors share: they cut lineage and are read again instead of computed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Only a local master, whose tasks see the driver's disk, may do without that setting."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="longtail-"))
            known = context._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root.rstrip('/')}/longtail-{uuid.uuid4().hex}"


def put(df: DataFrame) -> DataFrame:
    """df, written to a folder of its own and read from there."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
