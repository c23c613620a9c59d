"""Ranking, calibration, detection and budget metrics as aggregates over scored rows.

Rows have ``y`` and ``score``. Tied scores are handled by grouping, so ranking metrics
order distinct scores, not rows; running sums go over per-score counts that are first
added up by score range, so no task orders all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.config import CONFIG
from auditspark.operators.protocol import exact_rank
from auditspark.sources.shared import saved


def _running(rows: DataFrame, by: Sequence[str], parts: int = 64) -> DataFrame:
    """Per group and distinct score: positives and negatives, and those with higher scores.

    Scores are cut into ``parts`` ranges of equal width; ranges are added up first.
    """
    per = rows.groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    limits = per.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi")) if by else per.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    per = per.join(limits, list(by)) if by else per.crossJoin(F.broadcast(limits))  # one row
    cell = F.coalesce(F.floor(F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * parts), F.lit(0))
    per = per.withColumn("_c", cell).drop("_lo", "_hi")
    cells = per.groupBy(*by, "_c").agg(F.sum("pos").alias("_cp"), F.sum("neg").alias("_cn"))
    over = Window.partitionBy(*by).orderBy(F.desc("_c"))
    cells = cells.select(*by, "_c", (F.sum("_cp").over(over) - F.col("_cp")).alias("_bp"), (F.sum("_cn").over(over) - F.col("_cn")).alias("_bn"))
    own = Window.partitionBy(*by, "_c").orderBy(F.desc("score"))
    return per.join(cells, [*by, "_c"]).select(*by, "score", "pos", "neg", (F.sum("pos").over(own) - F.col("pos") + F.col("_bp")).alias("pos_above"), (F.sum("neg").over(own) - F.col("neg") + F.col("_bn")).alias("neg_above"))


def ranking(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, n_pos, base_rate, auprc (average precision over distinct scores), auroc (ties count half) and lift; null where a class is missing."""
    r = _running(rows, by)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    ap = F.sum(F.col("pos") * tp / (tp + fp))
    wins = F.sum(F.col("neg").cast("double") * F.col("pos_above") + 0.5 * F.col("neg") * F.col("pos"))
    sums = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), ap.alias("_ap"), wins.alias("_wins")]
    out = r.groupBy(*by).agg(*sums) if by else r.agg(*sums)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    n, base = F.col("n_pos") + F.col("n_neg"), F.try_divide(F.col("n_pos").cast("double"), (F.col("n_pos") + F.col("n_neg")).cast("double"))
    auprc = F.when(both, F.col("_ap") / F.col("n_pos"))
    return out.select(*by, F.coalesce(n, F.lit(0)).alias("n"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), base.alias("base_rate"), auprc.alias("auprc"), F.when(both, F.col("_wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"), F.try_divide(auprc, base).alias("auprc_lift"))


def calibration(rows: DataFrame, proba: str = "score", bins: int = 15) -> DataFrame:
    """Brier score and expected calibration error over equal-width bins, the last one closed."""
    p = F.least(F.greatest(F.col(proba), F.lit(0.0)), F.lit(1.0))
    cells = rows.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(F.col("y").cast("double")).alias("y"), F.sum((p - F.col("y")) * (p - F.col("y"))).alias("sq"))
    n = F.sum("n")
    return cells.agg(F.try_divide(F.sum("sq"), n.cast("double")).alias("brier"), F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), n.cast("double")).alias("ece"))


def index_ranking(rows: DataFrame) -> DataFrame:
    """Ranking of index events against negatives; positives that only follow one are left out."""
    kept = rows.where((F.col("y") == 0) | F.col("is_index")).withColumn("y", F.col("is_index").cast("int"))
    masked = rows.agg(F.coalesce(F.sum(((F.col("y") == 1) & ~F.col("is_index")).cast("long")), F.lit(0)).alias("n_masked_propagated"))
    r = ranking(kept).crossJoin(F.broadcast(masked))  # two single rows
    return r.select(F.col("n_pos").alias("n_index_positives"), "n_masked_propagated", F.col("base_rate").alias("index_base_rate"), F.col("auprc").alias("index_auprc"), F.col("auprc_lift").alias("index_auprc_lift"))


def cold_ranking(rows: DataFrame) -> DataFrame:
    """Ranking among rows whose entity no training row has."""
    r = ranking(rows.where("is_cold"))
    return r.select(F.col("n").alias("cold_n"), F.col("n_pos").alias("cold_n_pos"), F.col("auprc").alias("cold_auprc"))


def quantile(rows: DataFrame, q: float, column: str = "score", by: Sequence[str] = (), out: str = "threshold") -> DataFrame:
    """The linearly interpolated quantile of a column, by group, from counts of its distinct values."""
    some = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("score"), F.lit(0).alias("y"))
    sizes = some.groupBy(*by).agg(F.count("*").alias("_n")) if by else some.agg(F.count("*").alias("_n"))
    r = _running(some, by)
    r = r.join(F.broadcast(sizes), list(by)) if by else r.crossJoin(F.broadcast(sizes))  # a row, or one for each group
    # Places are counted from the top: a value holds neg_above, neg_above + 1 ... neg_above + neg - 1.
    place = F.lit(q) * (F.col("_n") - 1)

    def at(k: Column) -> Column:
        top = F.col("_n") - 1 - k
        return F.max(F.when((F.col("neg_above") <= top) & (top < F.col("neg_above") + F.col("neg")), F.col("score")))

    both = r.groupBy(*by).agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"), F.max(place - F.floor(place)).alias("_part"))
    return both.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))


def time_to_detection(rows: DataFrame, budget: float = CONFIG.budget) -> DataFrame:
    """Lead of an entity's first alert over its index event, in rows and hours; negative is early.

    Alerts are scores at or above the budget's quantile. The numbers of rows between are
    counted by comparing times, per entity, without ordering an entity's rows.
    """
    limit = F.broadcast(quantile(rows, 1 - budget))  # one row
    scored = rows.crossJoin(limit).withColumn("alert", F.col("score") >= F.col("threshold"))
    at = F.struct("t", "row_id")
    first = scored.groupBy("entity").agg(F.min(F.when(F.col("is_index"), at)).alias("i"), F.min(F.when(F.col("alert"), at)).alias("a")).where("i is not null")
    both = scored.select("entity", at.alias("at")).join(first, "entity")
    lead = both.groupBy("entity", "i", "a").agg(F.sum((F.col("at") < F.col("a")).cast("long")).alias("_sa"), F.sum((F.col("at") < F.col("i")).cast("long")).alias("_si"))
    lead = lead.select(F.col("a").isNotNull().alias("detected"), F.when(F.col("a").isNotNull(), F.col("_sa") - F.col("_si")).cast("double").alias("txn"), ((F.col("a.t") - F.col("i.t")) / 3600.0).alias("hours"))
    lead = saved(lead, "lead")
    out = lead.agg(
        F.count("*").alias("ttd_n_entities"),
        F.avg(F.col("detected").cast("double")).alias("ttd_detected_share"),
        F.avg((F.col("txn") < 0).cast("double")).alias("ttd_early_share"),
    )
    # Both medians from one pass over (name, value) rows.
    each = lead.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("txn", "hours")))).alias("x")).select("x.*")
    medians = quantile(each, 0.5, "value", ["name"])
    medians = medians.agg(*(F.max(F.when(F.col("name") == c, F.col("threshold"))).alias(f"ttd_median_{c}") for c in ("txn", "hours")))
    return out.crossJoin(F.broadcast(medians))  # two single rows


def budget_recall(rows: DataFrame, budget: float = CONFIG.budget, seed: int = 0, tie: Column | None = None) -> DataFrame:
    """Value and count recall and precision among the best max(1, round-half-even(n * budget)) rows.

    Ties are broken by a seeded hash of the row id, never by amount. The number of rows
    to review is one driver value; the best rows are those of the first exact ranks.
    """
    n = rows.count()
    take = max(1, round(n * budget))
    key = F.xxhash64("row_id", F.lit(seed)) if tie is None else tie
    narrow = rows.select("score", key.alias("_k"), "row_id", "y", "amount")
    top = exact_rank(narrow, F.desc("score"), F.col("_k"), F.col("row_id")).where(F.col("rank") < take)
    best = top.agg(F.sum(F.col("y") * F.col("amount")).alias("_v"), F.sum("y").alias("_y"), F.count("*").alias("_n"))
    every = rows.agg(F.sum(F.col("y") * F.col("amount")).alias("_tv"), F.sum("y").alias("_ty"))
    got = every.crossJoin(F.broadcast(best))  # two single rows
    some = F.col("_ty") > 0
    return got.select(
        F.when(some & (F.col("_tv") > 0), F.col("_v") / F.col("_tv")).alias("dollar_recall_at_k"),
        F.when(some, F.col("_y") / F.col("_ty").cast("double")).alias("count_recall_at_k"),
        F.when(some, F.col("_y") / F.col("_n").cast("double")).alias("alert_precision_at_k"),
        F.lit(budget).alias("k"),
        F.when(some, F.col("_n")).alias("n_reviewed"),
    )


def evaluated(rows: DataFrame, proba: str | None = None, budget: float = CONFIG.budget, tie: Column | None = None) -> DataFrame:
    """One row with every metric whose columns (is_index, is_cold, amount) are there."""
    parts = [ranking(rows)]
    if proba:
        parts.append(calibration(rows, proba))
    if "is_index" in rows.columns:
        parts.append(index_ranking(rows))
    if "is_cold" in rows.columns:
        parts.append(cold_ranking(rows))
    if "amount" in rows.columns:
        parts.append(budget_recall(rows, budget, tie=tie))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    return out


def aggregated_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of every numeric column by key, over seeds and folds."""
    numeric = [f.name for f in runs.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short") and f.name not in keys]
    return runs.groupBy(*keys).agg(*(f(c).alias(f"{c}_{s}") for c in numeric for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def attribution(by_condition: DataFrame, value: str = "auprc_mean") -> DataFrame:
    """How much of the drop from full to disjoint training is its size, and how much leakage."""
    def of(name: str) -> Column:
        return F.max(F.when(F.col("condition") == name, F.col(value)))

    one = by_condition.agg(of("full").alias("f"), of("size_matched").alias("s"), of("entity_disjoint").alias("d"))
    total = F.col("f") - F.col("d")
    return one.select(total.alias("total_drop_auprc"), (F.col("f") - F.col("s")).alias("attributable_to_training_size"), (F.col("s") - F.col("d")).alias("attributable_to_entity_leakage"), F.try_divide(F.col("s") - F.col("d"), total).alias("leakage_share_of_drop"))


def migration(mass: DataFrame) -> DataFrame:
    """(family, leaky, closed, change) of feature mass by protocol; 0 where a family is missing."""
    wide = mass.groupBy("family").pivot("protocol", ["leaky", "closed"]).agg(F.sum("share")).na.fill(0.0)
    return wide.withColumn("change", F.col("closed") - F.col("leaky"))
