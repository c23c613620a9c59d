"""Readers of the TPC-H-like tables, and views that give them the audit's columns.

Every view has ``row_id``, ``t`` (seconds), ``entity``, ``y`` and ``amount``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.config import DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.unix_seconds(c.cast("timestamp"))


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers: ties on whole days, five priorities, segments and 25 nations."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        seconds(F.col("o_orderdate")).alias("t"),
        F.col("o_custkey").alias("entity"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with distinct microsecond times ``t_us``; users as entities."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("row_id"),
        F.floor(us / 1_000_000).alias("t"),
        us.alias("t_us"),
        F.col("user_id").alias("entity"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").alias("k"),
        "event_type",
    )


def with_score(df: DataFrame) -> DataFrame:
    """A fixed pseudo-score of a thousand levels, so that ties occur."""
    return df.withColumn("score", (F.pmod(F.col("row_id") * 7919, F.lit(1000)) / 1000.0).cast("double"))


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.floor(F.col("t") / DAY).cast("int"))


def sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose columns a, b (one service), c and d are null by rules on the id."""
    o = txn_orders(spark, sf_dir)
    r = F.col("row_id")
    ab, c, d = r % 7 == 0, r % 5 < 2, (r % 11 == 3) | (r % 13 == 5)
    return o.select(
        "*",
        F.when(~ab, F.col("amount")).alias("a"),
        F.when(~ab, F.col("nation")).alias("b"),
        F.when(~c, F.col("segment")).alias("c"),
        F.when(~d, F.col("priority")).alias("d"),
    )


SPARSE = ("a", "b", "c", "d")
