"""Tables that cut lineage, in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only where a session has none (tests on
one machine) a temporary folder is made and set. A table is written once as Parquet
and read again, so a lost executor costs no more than the tasks that read it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("a cluster needs a folder that all its machines share in spark.checkpoint.dir")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Rows, and bytes, of an Arrow batch between Spark and its Python workers.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: smaller batches bound what Spark and a worker hold of them at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator run. ``drop`` frees what no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                _remove(self.spark, path)

    def close(self) -> None:
        try:
            _remove(self.spark, self.folder)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Narrow rows (an id and a number) that are broadcast at most; about 64 MB as a hash table.
SENT = 1_000_000


def sent_if_small(df: DataFrame, at_most: int = SENT) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small; larger, Spark shuffles both sides of its join."""
    return F.broadcast(df) if df.count() <= at_most else df


def with_columns_free(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def packed_row(docs: DataFrame) -> DataFrame:
    """``docs`` as its text and one struct of everything else, so that no added column can clash."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_row"), F.col("text").cast("string").alias("text"))


def unpacked_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns again; a text's length, if ``n_chars`` is one of them, is taken anew."""
    def one(c: str) -> F.Column:
        if c == "text":
            return F.col("text")
        return F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c)

    return df.select(*map(one, columns))


def in_fold(column) -> F.Column:
    """True for held-out rows: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))
