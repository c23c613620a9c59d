"""Sources and sinks of transaction data: CSV scans, optional side tables, discovery, checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.config import CONFIG
from auditspark.functions.scalar import renamed

IDENTITY = T.StructType([T.StructField("TransactionID", T.LongType())])


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def find_file(spark: SparkSession, name: str, *folders: str) -> str | None:
    """The first file or folder of this name under the folders, searched recursively in any file system."""
    for folder in folders:
        fs, root = _files(spark, folder)
        if not fs.exists(root):
            continue
        waiting = [root]
        while waiting:
            at = waiting.pop(0)
            for s in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
                if s.getPath().getName() == name:
                    return s.getPath().toString()
                if s.isDirectory():
                    waiting.append(s.getPath())
    return None


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, rows: int | None = None) -> DataFrame:
    """A CSV scan with an optional row limit; NaN and infinities become null."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
    df = reader.csv(path, header=True)
    if rows is not None:
        df = df.limit(rows)
    bad = [F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*bad)


def load_transactions(spark: SparkSession, folder: str, rows: int | None = None, transaction: str = "train_transaction", identity: str = "train_identity") -> DataFrame:
    """Transactions with their identity data, which covers a minority of them or is missing altogether."""
    names = [(n, f"{n}.csv") for n in (transaction, identity)]
    paths = [next((p for n in pair if (p := find_file(spark, n, folder))), None) for pair in names]
    if paths[0] is None:
        raise FileNotFoundError(f"no {transaction} under {folder}")
    left = scan_csv(spark, paths[0], rows=rows)
    right = renamed(scan_csv(spark, paths[1])) if paths[1] else spark.createDataFrame([], IDENTITY)
    return left.join(right, "TransactionID", "left")


def checkpoint_path(folder: str, name: str) -> str:
    """Of every configuration field, so that no run reads another's data."""
    return f"{folder}/{name}-{CONFIG.digest()}"


def save_checkpoint(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    path = checkpoint_path(folder, name)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def has_checkpoint(spark: SparkSession, folder: str, name: str) -> bool:
    fs, p = _files(spark, f"{checkpoint_path(folder, name)}/_SUCCESS")
    return fs.exists(p)


def load_checkpoint(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(checkpoint_path(folder, name))
