"""Folds: rolling-origin, entity-disjoint, label-matured; random and file-order splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.config import CONFIG
from auditspark.sources.shared import saved


@dataclass(frozen=True)
class FoldPlan:
    fold_days: int = CONFIG.fold_days
    min_train_days: int = CONFIG.min_train_days
    latency: int = 0
    entity_disjoint: bool = True
    min_test: int = CONFIG.fold_min_test
    min_train: int = CONFIG.fold_min_train
    min_positives: int = CONFIG.fold_min_positives


def windows(df: DataFrame, p: FoldPlan) -> DataFrame:
    """(start, end) of every test window that the days of ``df`` leave room for."""
    span = df.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    first = F.col("lo") + p.min_train_days
    starts = span.where(first <= F.col("hi")).select(F.explode(F.sequence(first, F.col("hi"), F.lit(p.fold_days))).alias("start"))
    return starts.select(F.col("start").cast("int").alias("start"), (F.col("start") + p.fold_days).cast("int").alias("end"))


def membership(df: DataFrame, p: FoldPlan) -> DataFrame:
    """(start, row_id, entity, y, role) of every row of every window.

    Roles: test; train; immature (before the window, its label not known yet); shared
    (matured, but its entity is tested). The windows are a few rows, their number set by
    the span of days, so they are broadcast.
    """
    w = F.broadcast(windows(df, p))
    rows = df.select("row_id", "day", "entity", "y").join(w, F.col("day") < F.col("end"))
    base = F.when(F.col("day") >= F.col("start"), "test").when(F.col("day") < F.col("start") - p.latency, "train").otherwise("immature")
    rows = rows.select("start", "row_id", "entity", "y", base.alias("role"))
    if not p.entity_disjoint:
        return rows
    tested = rows.where("role = 'test'").select("start", "entity").distinct().withColumn("_tested", F.lit(True))
    rows = rows.join(tested, ["start", "entity"], "left")
    role = F.when((F.col("role") == "train") & F.col("_tested"), "shared").otherwise(F.col("role"))
    return rows.select("start", "row_id", "entity", "y", role.alias("role"))


def fold_meta(members: DataFrame, p: FoldPlan) -> DataFrame:
    """Counts and base rates of the windows that are large enough, numbered by start."""
    def n(role: str) -> Column:
        return F.sum((F.col("role") == role).cast("long"))

    def positives(role: str) -> Column:
        return F.sum(F.when(F.col("role") == role, F.col("y")).otherwise(0)).cast("long")

    meta = members.groupBy("start").agg(n("train").alias("n_train"), n("test").alias("n_test"), n("shared").alias("n_entity_dropped"), n("immature").alias("n_immature_dropped"), positives("train").alias("_p"), positives("test").alias("_q"))
    big = meta.where((F.col("n_test") >= p.min_test) & (F.col("n_train") >= p.min_train) & (F.col("_p") >= p.min_positives))
    fold = F.row_number().over(Window.orderBy("start")) - 1  # a row for each window
    return big.select(fold.alias("fold_id"), "start", "n_train", "n_test", "n_entity_dropped", "n_immature_dropped", F.try_divide(F.col("_p").cast("double"), F.col("n_train").cast("double")).alias("train_rate"), F.try_divide(F.col("_q").cast("double"), F.col("n_test").cast("double")).alias("test_rate"))


def cold_rows(members: DataFrame) -> DataFrame:
    """Test rows with ``is_cold``: no training row of the window has their entity."""
    train = members.where("role = 'train'").select("start", "entity").distinct().withColumn("_known", F.lit(True))
    return members.where("role = 'test'").join(train, ["start", "entity"], "left").select("start", "row_id", "entity", "y", F.col("_known").isNull().alias("is_cold"))


def exact_rank(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` with ``rank`` from 0 in a total order, without one task that sees all rows.

    Rows are sorted into ranges and written, so that ranges are drawn once; a row's place
    in its range is part of the number it is written with, and ranges are numbered by their counts.
    """
    ranged = saved(df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    own = ranged.withColumn("_p", F.shiftright("_m", 33))
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each range
    return own.join(F.broadcast(before), "_p").withColumn("rank", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_p", "_m", "_before")


def random_folds(df: DataFrame, splits: int = 3, share: float = 0.25, seed: int = 0, key: Column | None = None) -> DataFrame:
    """(split, row_id, role): exactly round(share * n) test rows in each split, drawn by a hash of the row id."""
    n = df.count()
    cut = round(share * n)
    out = None
    for k in range(splits):
        order = F.xxhash64("row_id", F.lit(seed), F.lit(k)) if key is None else F.pmod(key * (2 * k + 1), F.lit(1_000_003))
        ranked = exact_rank(df.select("row_id").withColumn("_o", order), F.col("_o"), F.col("row_id"))
        one = ranked.select(F.lit(k).alias("split"), "row_id", F.when(F.col("rank") < cut, "test").otherwise("train").alias("role"))
        out = one if out is None else out.union(one)
    return out


def sampled(df: DataFrame, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """n rows without replacement, by a hash of the row id."""
    key = F.xxhash64("row_id", F.lit(seed)) if order is None else order
    return exact_rank(df.withColumn("_o", key), F.col("_o"), F.col("row_id")).where(F.col("rank") < n).drop("_o", "rank")


def chronological_split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """``df`` with ``role``: the first floor(share * n) rows in (t, row_id) order train."""
    cut = int(share * df.count())
    return exact_rank(df, F.col("t"), F.col("row_id")).withColumn("role", F.when(F.col("rank") < cut, "train").otherwise("test")).drop("rank")
