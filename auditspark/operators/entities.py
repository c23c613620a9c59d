"""Entity resolution without labels, and statistics of entities.

A merge only ever joins a coarse group's anchor block with another block of the same
group, so resolution is one window over blocks, not a graph problem.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.config import CONFIG, DAY

GUARDED = ("card4", "card6", "card3")


def representatives(df: DataFrame, block: str, coarse: str, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """One row per block: the columns of its first row."""
    first = F.min(F.struct(F.col(row_id), F.col(coarse), *(F.col(c) for c in columns))).alias("f")
    return df.groupBy(block).agg(first).select(block, F.col(f"f.{row_id}").alias("first_row"), f"f.{coarse}", *(f"f.{c}" for c in columns))


def candidate_pairs(reps: DataFrame, block: str, coarse: str, columns: Sequence[str], most: int = 200) -> DataFrame:
    """(anchor, block) of the blocks in coarse groups of 2 to ``most`` blocks; ``a_*`` are the anchor's columns.

    The anchor, the block met first, comes from one aggregate per group that is joined back.
    """
    anchor = F.min(F.struct(F.col("first_row"), F.col(block).alias("anchor"), *(F.col(c).alias(f"a_{c}") for c in columns))).alias("f")
    groups = reps.groupBy(coarse).agg(F.count("*").alias("blocks"), anchor).where((F.col("blocks") >= 2) & (F.col("blocks") <= most))
    groups = groups.select(coarse, "blocks", "f.anchor", *(f"f.a_{c}" for c in columns))
    return reps.join(groups, coarse).where(F.col(block) != F.col("anchor"))


def agreement(weights: Mapping[str, float]) -> Column:
    """Weighted share of the comparable columns that agree; 0 if none is comparable."""
    num, den = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        a, b = F.col(f"a_{c}"), F.col(c)
        comparable = a.isNotNull() & b.isNotNull()
        num = num + F.when(comparable & (a == b), w).otherwise(0.0)
        den = den + F.when(comparable, w).otherwise(0.0)
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def conflict(columns: Sequence[str] = GUARDED, day_key: str | None = "D15n", days: float = 3) -> Column:
    """Two values that differ, or day keys more than ``days`` apart; nulls never conflict."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(f"a_{c}") != F.col(c), F.lit(False))
    if day_key:
        out = out | F.coalesce(F.abs(F.col(f"a_{day_key}") - F.col(day_key)) > days, F.lit(False))
    return out


def resolved(df: DataFrame, block: str, coarse: str, weights: Mapping[str, float], guarded: Sequence[str] = (), day_key: str | None = None, threshold: float = CONFIG.agreement_threshold, row_id: str = "row_id") -> DataFrame:
    """``df`` with ``entity_block``: the anchor of an accepted merge, else the row's own block."""
    columns = [*dict.fromkeys([*weights, *guarded, *([day_key] if day_key else [])])]
    reps = representatives(df, block, coarse, columns, row_id)
    pairs = candidate_pairs(reps, block, coarse, columns)
    merged = pairs.where((agreement(weights) >= threshold) & ~conflict(guarded, day_key)).select(block, "anchor")
    return df.join(merged, block, "left").withColumn("entity_block", F.coalesce("anchor", F.col(block))).drop("anchor")


def merge_rejects(df: DataFrame, block: str, coarse: str, weights: Mapping[str, float], guarded: Sequence[str] = (), day_key: str | None = None, threshold: float = CONFIG.agreement_threshold, row_id: str = "row_id") -> DataFrame:
    """One row: candidate pairs not merged for their agreement, and, of the others, for a conflict."""
    columns = [*dict.fromkeys([*weights, *guarded, *([day_key] if day_key else [])])]
    pairs = candidate_pairs(representatives(df, block, coarse, columns, row_id), block, coarse, columns)
    low = agreement(weights) < threshold
    held = ~low & conflict(guarded, day_key)
    return pairs.agg(F.coalesce(F.sum(low.cast("long")), F.lit(0)).alias("score_rejects"), F.coalesce(F.sum(held.cast("long")), F.lit(0)).alias("conflict_rejects"))


def entity_sizes(df: DataFrame) -> DataFrame:
    sizes = df.groupBy("entity").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_entities"),
        F.avg("n").alias("size_mean"),
        F.percentile("n", F.lit(0.5)).alias("size_median"),
        F.percentile("n", F.lit(0.95)).alias("size_p95"),
        F.max("n").alias("size_max"),
        F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"),
    )


def entity_purity(df: DataFrame) -> DataFrame:
    """Label purity, also among entities with a positive and at least two rows; the propagated share; the share of entities with a positive."""
    per = df.groupBy("entity").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("y").alias("pos"))
    pure = (F.col("lo") == F.col("hi")).cast("double")
    return per.agg(
        F.avg(pure).alias("label_purity"),
        F.avg(F.when((F.col("hi") == 1) & (F.col("n") >= 2), pure)).alias("positive_purity"),
        (1 - F.try_divide(F.sum(F.col("hi")).cast("double"), F.sum("pos").cast("double"))).alias("propagated_share"),
        F.avg(F.col("hi").cast("double")).alias("positive_entity_share"),
    )


def counter_violations(df: DataFrame, counters: Sequence[str], entity: str = "entity", t: str = "t", row_id: str = "row_id", bucket: int = 30 * DAY) -> DataFrame:
    """How often a cumulative counter falls from one row of an entity to the next; a null between hides nothing further.

    Rows are chained by entity and ``bucket`` ticks of time; from one bucket to the next the last
    row of the one meets the first of the other, so an entity is shared by as many tasks as it has buckets.
    """
    rows = df.select(F.col(entity).alias("_e"), F.floor(F.col(t) / bucket).alias("_b"), F.col(t).alias("_t"), F.col(row_id).alias("_r"), *counters)
    chain = Window.partitionBy("_e", "_b").orderBy("_t", "_r")
    within = rows.select(*counters, *(F.lag(c).over(chain).alias(f"_{c}") for c in counters))
    row = F.struct("_t", "_r", *counters)
    buckets = rows.groupBy("_e", "_b").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    buckets = buckets.withColumn("_last", F.lag("_last").over(Window.partitionBy("_e").orderBy("_b")))
    before = within.unionByName(buckets.select(*(F.col(f"_first.{c}").alias(c) for c in counters), *(F.col(f"_last.{c}").alias(f"_{c}") for c in counters)))
    pairs, falls = F.lit(0), F.lit(0)
    for c in counters:
        both = F.col(c).isNotNull() & F.col(f"_{c}").isNotNull()
        pairs = pairs + both.cast("int")
        falls = falls + (both & (F.col(c) < F.col(f"_{c}"))).cast("int")
    out = before.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(falls), F.lit(0)).alias("n_falls"))
    return out.withColumn("violation_rate", F.coalesce(F.try_divide(F.col("n_falls").cast("double"), F.col("n_pairs").cast("double")), F.lit(0.0)))


def pair_quality(df: DataFrame, found: str, true: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering, from cluster sizes alone."""
    n = df.groupBy(found, true).agg(F.count("*").alias("n"))

    def pairs(g: DataFrame, name: str) -> DataFrame:
        return g.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias(name))

    per = lambda k: n.groupBy(k).agg(F.sum("n").alias("n"))
    one = pairs(n, "both").crossJoin(pairs(per(found), "found")).crossJoin(pairs(per(true), "true"))  # three single rows
    precision, recall = F.try_divide("both", "found"), F.try_divide("both", "true")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return one.select(F.coalesce(precision, F.lit(0.0)).alias("pair_precision"), F.coalesce(recall, F.lit(0.0)).alias("pair_recall"), f1.alias("pair_f1"))


def index_events(df: DataFrame) -> DataFrame:
    """``df`` with ``is_index``: an entity's first positive row in time."""
    first = df.where("y = 1").groupBy("entity").agg(F.min(F.struct("t", "row_id")).alias("_f"))
    joined = df.join(first, "entity", "left")
    return joined.withColumn("is_index", F.coalesce(F.col("_f.row_id") == F.col("row_id"), F.lit(False))).drop("_f")


def left_truncated(df: DataFrame) -> DataFrame:
    """How many entities are positive on their first row, of how many."""
    per = df.groupBy("entity").agg(F.min(F.struct("t", "row_id", "y")).alias("f"))
    return per.agg(F.coalesce(F.sum(F.col("f.y")).cast("long"), F.lit(0)).alias("n_left_truncated"), F.count("*").alias("n_entities"))


def propagated_labels(df: DataFrame) -> DataFrame:
    """``df`` with ``y_propagated``: 1 from the entity's first positive row on."""
    first = df.where("y = 1").groupBy("entity").agg(F.min(F.struct("t", "row_id")).alias("_f"))
    joined = df.join(first, "entity", "left")
    return joined.withColumn("y_propagated", F.coalesce((F.struct("t", "row_id") >= F.col("_f")).cast("int"), F.lit(0))).drop("_f")
