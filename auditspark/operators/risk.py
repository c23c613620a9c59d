"""Latency-gated association risk, entity memory and velocity.

A row sees the labels of rows with ``t_j < t_i - delay`` only. Sums over such rows are
taken per key and time bucket: buckets are added up over their own, few rows, and only
the last, partial bucket is ordered row by row. So a key that holds a third of all
rows (a missing value, a large merchant) is spread over as many tasks as it has
buckets. Decay is algebraic: ``exp(-t_i / tau) * sum(exp(t_j / tau) * x_j)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.config import CONFIG, DAY
from auditspark.functions.scalar import text_or_missing


def matured_sums(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], delay: int, tau: float | None = None, carry: Sequence[str] = (), bucket: int = 30 * DAY, origin: int = 0) -> DataFrame:
    """For each row of ``rows`` (row_id, t, ...): sums of ``measures`` over the rows of its keys with ``t_j < t - delay``.

    ``tau`` (seconds) decays them; ``origin`` is subtracted from times before exponents
    are taken. Empty sums are 0. Columns ``keys`` and ``carry`` are kept.
    """
    def grow(seconds: Column) -> Column:
        return F.exp(seconds / tau) if tau else F.lit(1.0)

    names = list(measures)
    at, cut = F.col("t") - origin, F.col("t") - origin - delay - 1
    given = rows.select("row_id", *keys, *carry, "t", *(m.cast("double").alias(f"_m_{k}") for k, m in measures.items()))
    start = F.floor(at / bucket)
    points = given.select(*keys, start.alias("_b"), at.alias("_t"), F.lit(0).alias("_q"), F.lit(None).cast("long").alias("row_id"), *(F.lit(None).cast(given.schema[c].dataType).alias(c) for c in carry), *((F.coalesce(F.col(f"_m_{k}"), F.lit(0.0)) * grow(at - start * bucket)).alias(k) for k in names))
    asked = given.select(*keys, F.floor(cut / bucket).alias("_b"), cut.alias("_t"), F.lit(1).alias("_q"), "row_id", *carry, *(F.lit(0.0).alias(k) for k in names))
    both = points.unionByName(asked)
    own = Window.partitionBy(*keys, "_b").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = both.withColumns({f"_p_{k}": F.sum(k).over(own) for k in names}).where("_q = 1").drop(*names)
    whole = both.groupBy(*keys, "_b").agg(*(F.sum(k).alias(k) for k in names))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*keys, "_b", *(F.coalesce(F.sum(F.col(k) * grow(F.col("_b") * bucket)).over(earlier), F.lit(0.0)).alias(f"_w_{k}") for k in names))
    joined = part.join(before, [*keys, "_b"])
    now = F.col("_t") + delay + 1
    fade = (lambda c, since: c * F.exp((since - now) / tau)) if tau else (lambda c, since: c)
    return joined.select("row_id", *keys, *carry, *((fade(F.col(f"_p_{k}"), F.col("_b") * bucket) + fade(F.col(f"_w_{k}"), F.lit(0))).alias(k) for k in names))


def unpivoted(df: DataFrame, attributes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row and attribute, with ``attr`` and ``value``; a missing value is a value."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), text_or_missing(F.col(a)).alias("value")) for a in attributes))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.attr", "p.value")


def beta_prior(long: DataFrame, min_count: int = CONFIG.prior_min_count) -> DataFrame:
    """(attribute, alpha0, beta0): moments of the values' rates, or a weak prior where they don't fit one."""
    rates = long.groupBy("attr", "value").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    overall = long.groupBy("attr").agg(F.avg("y").alias("base"))
    fit = rates.where(F.col("n") >= min_count).groupBy("attr").agg(F.count("*").alias("kinds"), F.avg("rate").alias("mean"), F.var_samp("rate").alias("var"))
    both = overall.join(fit, "attr", "left")
    base = F.least(F.greatest("base", F.lit(1e-4)), F.lit(1 - 1e-4))
    mean = F.least(F.greatest("mean", F.lit(1e-4)), F.lit(1 - 1e-4))
    fits = (F.coalesce("kinds", F.lit(0)) >= 5) & (F.col("var") > 1e-12) & (F.col("var") < mean * (1 - mean))
    strength = F.least(F.greatest(F.try_divide(mean * (1 - mean), F.col("var")) - 1, F.lit(1.0)), F.lit(5000.0))
    weak_mean = F.when(F.coalesce("kinds", F.lit(0)) >= 5, mean).otherwise(base)
    a = F.when(fits, mean * strength).otherwise(20.0 * weak_mean)
    b = F.when(fits, (1 - mean) * strength).otherwise(20.0 * (1 - weak_mean))
    return both.select(F.col("attr").alias("attribute"), a.alias("alpha0"), b.alias("beta0"))


def association_risk(df: DataFrame, attributes: Sequence[str], delay: int, tau: float, origin: int = 0, train: Column | None = None) -> DataFrame:
    """(row_id, attr, pos, tot, risk, weight): shrunken, decayed risk of each attribute value from other entities' matured labels.

    ``train`` masks the rows whose labels may be learnt from; all by default.
    """
    keep = ["row_id", "t", "entity", "y"]
    seen = F.lit(True) if train is None else train
    long = unpivoted(df.withColumn("_train", seen), attributes, [*keep, "_train"])
    prior = beta_prior(long.where("_train"))
    measures = {"tot": F.col("_train").cast("int"), "pos": F.col("_train").cast("int") * F.col("y")}
    every = matured_sums(long, ["attr", "value"], measures, delay, tau, carry=["entity"], origin=origin)
    own = matured_sums(long, ["attr", "value", "entity"], measures, delay, tau, origin=origin)
    own = own.select("row_id", "attr", F.col("pos").alias("own_pos"), F.col("tot").alias("own_tot"))
    both = every.join(own, ["row_id", "attr"]).join(prior, F.col("attr") == F.col("attribute"))
    pos, tot = F.greatest(F.col("pos") - F.col("own_pos"), F.lit(0.0)), F.greatest(F.col("tot") - F.col("own_tot"), F.lit(0.0))
    # Rounding residue of two equal sums is no evidence.
    pos, tot = (F.when(x < 1e-9, 0.0).otherwise(x) for x in (pos, tot))
    risk = (F.col("alpha0") + pos) / (F.col("alpha0") + F.col("beta0") + tot)
    return both.select("row_id", "attr", pos.alias("pos"), tot.alias("tot"), risk.alias("risk"))


def risk_summary(risks: DataFrame, blend: float = CONFIG.blend) -> DataFrame:
    """Per row: greatest and mean risk, and their blend."""
    out = risks.groupBy("row_id").agg(F.max("risk").alias("risk_max"), F.avg("risk").alias("risk_mean"))
    return out.withColumn("risk_prop", blend * F.col("risk_max") + (1 - blend) * F.col("risk_mean"))


def risk_features(df: DataFrame, attributes: Sequence[str], delay: int, tau: float, origin: int = 0, train: Column | None = None) -> DataFrame:
    """Wide: ``risk_*`` and ``riskn_*`` of each attribute with the summary, by row_id."""
    long = association_risk(df, attributes, delay, tau, origin, train)
    cells = [F.max(F.when(F.col("attr") == a, F.col(c))).alias(f"{p}_{a}") for a in attributes for c, p in (("risk", "risk"), ("tot", "riskn"))]
    return long.groupBy("row_id").agg(*cells).join(risk_summary(long), "row_id")


def entity_memory(df: DataFrame, delay: int, train: Column | None = None, bucket: int = 30 * DAY) -> DataFrame:
    """Matured counts of an entity's rows and positives, whether it is known, and days since its first positive."""
    seen = (F.lit(True) if train is None else train).cast("int")
    sums = matured_sums(df.withColumn("_s", seen), ["entity"], {"txn": F.col("_s"), "fraud": F.col("_s") * F.col("y")}, delay, carry=["t"], bucket=bucket)
    first = df.where((seen == 1) & (F.col("y") == 1)).groupBy("entity").agg(F.min("t").alias("_first"))
    with_first = sums.join(first, "entity", "left")
    days = F.when(F.col("fraud") > 0, (F.col("t") - F.col("_first")) / float(DAY))
    return with_first.select(
        "row_id",
        F.col("txn").cast("long").alias("mem_prior_txn_count"),
        F.col("fraud").cast("long").alias("mem_prior_fraud_count"),
        (F.col("fraud") > 0).cast("int").alias("mem_known_compromised"),
        days.alias("mem_days_since_first_fraud"),
    )


def velocity(df: DataFrame, cap: int = CONFIG.velocity_cap, t: str = "t", unit: int = 1) -> DataFrame:
    """Rows and amount in the trailing day and week among the ``cap`` rows before, and days since the last; labels unused.

    ``unit``: ticks a second of ``t``. An entity's rows are windowed by weeks: a week
    also gets the last ``cap`` rows of the week before, which is all its rows can see,
    so a busy entity is shared by as many tasks as it has weeks.
    """
    d = DAY * unit
    week = F.floor(F.col(t) / (7 * d))
    rows = df.select("row_id", "entity", F.col(t).alias("_t"), F.col("amount").alias("_a"), week.alias("_w"))
    back = Window.partitionBy("entity", "_w").orderBy(F.desc("_t"), F.desc("row_id"))
    context = rows.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= cap).drop("_r").withColumn("_w", F.col("_w") + 1)
    both = rows.withColumn("_own", F.lit(True)).unionByName(context.withColumn("_own", F.lit(False)))
    chain = Window.partitionBy("entity", "_w").orderBy("_t", "row_id")
    past = F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_a").alias("a"))).over(chain.rowsBetween(-cap, -1))
    now = both.withColumns({"_past": past, "_before": F.lag("_t").over(chain)}).where("_own")
    # The last row of the last week that has any, for a week's first row.
    weeks = rows.groupBy("entity", "_w").agg(F.max("_t").alias("_end"))
    weeks = weeks.select("entity", "_w", F.lag("_end").over(Window.partitionBy("entity").orderBy("_w")).alias("_older"))
    now = now.join(weeks, ["entity", "_w"])

    def within(days: int) -> Column:
        return F.filter("_past", lambda x: x["t"] >= F.col("_t") - days * d)

    amount = F.aggregate(within(7), F.lit(0.0), lambda s, x: s + x["a"])
    last = F.coalesce("_before", "_older")
    return now.select(
        "row_id",
        F.size(within(1)).cast("long").alias("vel_txn_1d"),
        F.size(within(7)).cast("long").alias("vel_txn_7d"),
        amount.alias("vel_amt_7d"),
        ((F.col("_t") - last) / float(d)).alias("vel_recency_days"),
    )


def constrained_features(attributes: Sequence[str]) -> list[str]:
    """Features that may only raise a score."""
    return [*(f"risk_{a}" for a in attributes), "risk_max", "risk_mean", "risk_prop", "mem_known_compromised", "mem_prior_fraud_count", "mem_prior_txn_count", "mem_days_since_first_fraud", "vel_txn_1d", "vel_txn_7d"]
