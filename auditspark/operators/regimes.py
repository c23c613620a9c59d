"""Missingness regimes, their assignment to rows, and drift of their distribution.

Distances are taken between distinct patterns, which are few, and regimes; rows are
joined back by pattern.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.config import CONFIG
from auditspark.functions.scalar import null_mask


def minable_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Columns that are null in some rows, but not in all."""
    columns = [c for c in df.columns if c not in set(skip)]
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if shares[c] is not None and 0 < shares[c] < 1]


def missing_blocks(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> list[list[str]]:
    """Groups of columns that are null in exactly the same rows, by one pass.

    Two sums of hashes of the row ids, and the count, stand for a column's null vector.
    """
    prints = []
    for c in columns:
        null = F.col(c).isNull()
        prints += [F.bit_xor(F.when(null, F.xxhash64(F.col(row_id), F.lit(s)))).alias(f"{c}__{s}") for s in (0, 1)]
        prints.append(F.sum(null.cast("long")).alias(f"{c}__n"))
    row = df.agg(*prints).first()
    groups: dict[tuple, list[str]] = defaultdict(list)
    for c in columns:
        groups[row[f"{c}__0"], row[f"{c}__1"], row[f"{c}__n"]].append(c)
    return [sorted(g) for g in groups.values()]


def patterns(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """(pattern, n, support) of every null pattern of the blocks' first columns."""
    counts = df.groupBy(null_mask(blocks).alias("pattern")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("pattern", "n", (F.col("n") / F.col("total").cast("double")).alias("support"))  # one row


def retained(found: DataFrame, min_support: float = CONFIG.regime_min_support, most: int = CONFIG.regime_max_count) -> DataFrame:
    """(regime, pattern, n, support): the frequent patterns, the ``most`` largest of them; if none is frequent, the largest.

    Numbered in pattern order. At most ``most`` rows leave the ordered limit.
    """
    top = found.orderBy(F.desc("n"), "pattern").limit(most)
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "pattern")))
    kept = ranked.where((F.col("support") >= min_support) | (F.col("_r") == 1))
    # The largest alone is kept only when nothing is frequent; it is frequent otherwise.
    return kept.select((F.row_number().over(Window.orderBy("pattern")) - 1).alias("regime"), "pattern", "n", "support")


def nearest_regime(found: DataFrame, regimes: DataFrame) -> DataFrame:
    """(pattern, regime, distance) of the nearest regime by Hamming distance; the lowest number on ties.

    Regimes are at most ``CONFIG.regime_max_count`` rows, so they are broadcast.
    """
    r = F.broadcast(regimes.select("regime", F.col("pattern").alias("_p")))
    distance = F.bit_count(F.col("pattern").bitwiseXOR(F.col("_p")))
    pairs = found.select("pattern").distinct().crossJoin(r)
    best = pairs.groupBy("pattern").agg(F.min(F.struct(distance.alias("d"), F.col("regime"))).alias("m"))
    return best.select("pattern", "m.regime", F.col("m.d").cast("int").alias("distance"))


def assigned(df: DataFrame, blocks: Sequence[str], regimes: DataFrame) -> DataFrame:
    """``df`` with ``pattern`` and ``regime``."""
    rows = df.withColumn("pattern", null_mask(blocks))
    near = nearest_regime(rows.groupBy("pattern").count(), regimes).drop("distance")
    return rows.join(near, "pattern")


def missing_features(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """An indicator for each block, and the share of blocks that are null."""
    flags = {f"miss_blk_{c}": F.col(c).isNull().cast("int") for c in blocks}
    density: Column = F.lit(0)
    for c in blocks:
        density = density + F.col(c).isNull().cast("int")
    return df.withColumns({**flags, "miss_density": density / float(len(blocks))})


def distribution(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """(regime, n, share) with zeros for regimes without rows."""
    counts = rows.groupBy("regime").agg(F.count("*").alias("n"))
    full = regimes.select("regime").join(counts, "regime", "left").select("regime", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy()).cast("double")))  # at most 60 rows


EPSILON = 1e-12


def drift(rows: DataFrame, regimes: DataFrame, days: int = 7) -> DataFrame:
    """Tumbling windows from the first day: rows, first day, Jensen-Shannon divergence from the first window, top regime."""
    first = rows.agg(F.min("day").alias("_d0"))
    windowed = rows.crossJoin(F.broadcast(first)).withColumn("window", F.floor((F.col("day") - F.col("_d0")) / days).cast("int"))  # one row
    counts = windowed.groupBy("window", "_d0", "regime").agg(F.count("*").alias("n"))
    totals = counts.groupBy("window", "_d0").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(regimes.select("regime"))).join(counts.drop("_d0"), ["window", "regime"], "left")
    k = F.count("*").over(Window.partitionBy("window"))
    # A little is added to every share before they are scaled to one again.
    p = (F.coalesce("n", F.lit(0)) / F.col("total") + EPSILON) / (1 + k * EPSILON)
    shares = grid.select("window", "_d0", "regime", "total", F.coalesce("n", F.lit(0)).alias("n"), p.alias("p"))
    reference = F.broadcast(shares.where("window = 0").select("regime", F.col("p").alias("q")))
    both = shares.join(reference, "regime").withColumn("m", (F.col("p") + F.col("q")) / 2)
    js = F.sum(0.5 * F.col("p") * F.log2(F.col("p") / F.col("m")) + 0.5 * F.col("q") * F.log2(F.col("q") / F.col("m")))
    top = F.max(F.struct(F.col("n"), -F.col("regime")))
    out = both.groupBy("window", "_d0").agg(F.first("total").alias("n"), js.alias("js"), top.alias("_top"))
    return out.select("window", (F.col("_d0") + F.col("window") * days).cast("int").alias("day_start"), "n", F.greatest("js", F.lit(0.0)).alias("js"), (-F.col("_top.col2")).cast("int").alias("top_regime"))


def nearest_fold(series: DataFrame, folds: DataFrame, day: str = "day_start", fold_day: str = "start") -> DataFrame:
    """Each window with the fold whose start is nearest, the first on ties; both sides have a row per window."""
    pairs = series.join(F.broadcast(folds), how="cross")
    best = pairs.groupBy("window").agg(F.min(F.struct(F.abs(F.col(fold_day) - F.col(day)).alias("gap"), F.col("fold_id"))).alias("b"))
    near = best.select("window", "b.fold_id", "b.gap")
    return series.join(near, "window", "left").join(folds, "fold_id", "left")
