"""Tables written on the way, so that a costly pass runs once and a lost executor doesn't repeat it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df under spark.checkpoint.dir, which all machines share, and read it again. Only a session on one machine may do
    without that setting."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"{tempfile.gettempdir()}/tidewave-checkpoints"
    path = f"{folder.rstrip('/')}/tidewave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
