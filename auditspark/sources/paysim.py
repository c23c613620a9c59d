"""Mobile-money simulation data: scan, residual features and label-conditional evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions.scalar import close_to

SCHEMA = "step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"

#: Columns that each rung of the ladder drops.
RULE_LEAK = ("isFlaggedFraud",)
RESIDUALS = ("balance_err_orig", "balance_err_dest", "amount_eq_oldbalance")
BALANCES = ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "balance_err_orig", "balance_err_dest")
RUNGS: dict[str, tuple[str, ...]] = {
    "p0_all_features": (),
    "p1_drop_rule_leak": RULE_LEAK,
    "p2_drop_balance_residuals": (*RULE_LEAK, *RESIDUALS),
    "p3_drop_all_balance": (*RULE_LEAK, *BALANCES, "amount_eq_oldbalance", "orig_emptied"),
}


def load(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    df = spark.read.schema(SCHEMA).csv(path, header=True)
    return df if rows is None else df.limit(rows)


def with_residuals(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "balance_err_orig": F.col("oldbalanceOrg") - F.col("amount") - F.col("newbalanceOrig"),
            "balance_err_dest": F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest"),
            "orig_emptied": ((F.col("oldbalanceOrg") > 0) & (F.col("newbalanceOrig") == 0)).cast("int"),
            "amount_eq_oldbalance": close_to(F.col("amount"), F.col("oldbalanceOrg")).cast("int"),
            "day": F.floor(F.col("step") / 24).cast("int"),
            "hour_of_day": (F.col("step") % 24).cast("int"),
            "log_amount": F.log1p("amount"),
        }
    )


def evidence(df: DataFrame) -> DataFrame:
    """What the balance fields look like for each label."""
    from auditspark.operators.metrics import quantile

    shares = df.groupBy("isFraud").agg(
        F.count("*").alias("n"),
        F.avg(F.col("amount_eq_oldbalance").cast("double")).alias("share_amount_eq_oldbalance"),
        F.avg(F.col("orig_emptied").cast("double")).alias("share_orig_emptied"),
        F.avg((F.col("oldbalanceDest") == F.col("newbalanceDest")).cast("double")).alias("share_dest_balance_unchanged"),
        F.avg(F.col("isFlaggedFraud").cast("double")).alias("share_flagged"),
    )
    median = quantile(df, 0.5, "balance_err_orig", ["isFraud"], "median_balance_err_orig")
    return shares.join(F.broadcast(median), "isFraud", "left")  # a row for each label
