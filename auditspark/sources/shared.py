"""Tables that cut lineage, in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's shared folder; only where it names none, on one machine (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("a cluster needs a folder that all its machines share in spark.checkpoint.dir")
        at = f"file://{tempfile.mkdtemp(prefix='audit-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet and read again."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
