"""Model-side operators: neighbours, oversampling, calibration, and Spark ML baselines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.config import CONFIG

#: Rows of one neighbour block, and of a slice of it that is compared at once.
BLOCK_ROWS, SLICE = 10_000, 256


def _nearest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of b of each row of a: candidates by a matrix product, order by exact distances."""
    found, square = [], (b**2).sum(1)
    for at in range(0, len(a), SLICE):
        part = a[at : at + SLICE]
        size = (part**2).sum(1)
        rough = size[:, None] + square - 2 * part @ b.T
        rough[ids[at : at + SLICE, None] == others] = np.inf
        kth = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        # What rounding of the product may hide is compared exactly.
        room = 1e-9 * (size + square.max()) + 1e-12
        for r in range(len(part)):
            near = np.flatnonzero(rough[r] <= kth[r] + room[r])
            near = near[np.isfinite(rough[r, near])]
            d = np.sqrt(((b[near] - part[r]) ** 2).sum(1))
            order = np.lexsort((others[near], d))[:k]
            found += zip([ids[at + r]] * len(order), others[near[order]], d[order], strict=True)
    return pd.DataFrame(found, columns=["id", "neighbour", "distance"])


def nearest_neighbours(rows: DataFrame, k: int = 5, id_col: str = "row_id", vector: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, rank, distance) of each row's k nearest others by Euclidean distance, the smaller id on ties.

    Rows are dealt into blocks of about ``block_rows``; every two blocks meet in a task of
    their own, which keeps each row's best k, and the best k of those are the answer.
    Nothing passes through the driver and no task holds more than two blocks.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    given = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = given.select(F.col("b").alias("i"), each.alias("j"), F.lit(True).alias("asks"), "id", "v")
    met = given.select(each.alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"), "id", "v")

    def near(cell: pd.DataFrame) -> pd.DataFrame:
        asks = cell["asks"].to_numpy(bool)
        ids = cell["id"].to_numpy(np.int64)
        if not asks.any() or asks.all():
            return pd.DataFrame({"id": ids[:0], "neighbour": ids[:0], "distance": np.empty(0)})
        v = np.stack(cell["v"].to_numpy()).astype(float)
        return _nearest(v[asks], ids[asks], v[~asks], ids[~asks], k)

    out = asked.union(met).groupBy("i", "j").applyInPandas(near, "id long, neighbour long, distance double")
    best = out.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("n"))
    return best.select("id", F.posexplode("n").alias("rank", "n")).select("id", "n.neighbour", (F.col("rank") + 1).alias("rank"), "n.distance")


def oversampled(rows: DataFrame, label: str = "y", vector: str = "vector", share: float = 0.25, k: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` with ``synthetic`` and new positives between neighbours, up to ``share`` of the negatives."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    missing = max(0, int(share * neg) - pos)
    base = rows.withColumn("synthetic", F.lit(False))
    if pos < 2 or not missing:
        return base
    minority = rows.where(F.col(label) == 1)
    pairs = nearest_neighbours(minority, k, vector=vector)
    vectors = minority.select(F.col("row_id").alias("id"), F.col(vector).alias("_v"))
    per = -(-missing // pos)
    draws = pairs.groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per))))
    pick = F.pmod(F.xxhash64("id", "draw", F.lit(seed)), F.size("n")) + 1
    draws = draws.select("id", "draw", F.element_at("n", pick.cast("int")).alias("other")).orderBy(F.xxhash64("id", "draw", F.lit(seed)), "id", "draw").limit(missing)
    met = draws.join(vectors, "id").join(vectors.select(F.col("id").alias("other"), F.col("_v").alias("_w")), "other")
    u = (F.pmod(F.xxhash64("draw", "id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    made = met.select("id", "draw", "_v", "_w", u)
    mixed = F.zip_with("_v", "_w", lambda a, b: a + F.col("u") * (b - a))
    new = made.select((-F.xxhash64("id", "draw")).alias("row_id"), F.lit(1).alias(label), mixed.cast(rows.schema[vector].dataType).alias(vector), F.lit(True).alias("synthetic"))
    return base.unionByName(new, allowMissingColumns=True)


def isotonic(rows: DataFrame, apply_to: DataFrame | None = None, min_rows: int = 500, group: str = "regime") -> DataFrame:
    """``apply_to`` (or ``rows``) with ``calibrated``: isotonic probabilities fitted on ``rows``.

    A group of at least ``min_rows`` rows with both classes has its own curve; all others share one.
    More such groups than regimes can be is an error.
    """
    target = rows if apply_to is None else apply_to
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    own = [r[group] for r in counts.where((F.col("n") >= min_rows) & (F.col("lo") != F.col("hi"))).orderBy(group).limit(CONFIG.regime_max_count + 1).collect()]
    if len(own) > CONFIG.regime_max_count:
        raise ValueError(f"more than {CONFIG.regime_max_count} groups to calibrate")
    fit = lambda df: IsotonicRegression(featuresCol="score", labelCol="y").fit(df.select(F.col("score").cast("double"), F.col("y").cast("double")))
    whole = fit(rows)
    parts = [(g, fit(rows.where(F.col(group) == g))) for g in own]
    rest = target if not own else target.where(F.col(group).isNull() | ~F.col(group).isin(own))
    out = whole.transform(rest)
    for g, model in parts:
        out = out.unionByName(model.transform(target.where(F.col(group) == g)))
    return out.withColumn("calibrated", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")


def _pipeline(features: Sequence[str], last) -> Pipeline:
    filled = [f"_f_{c}" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), last])


def registry() -> dict[str, Callable[..., Pipeline]]:
    """Available baselines. ``gbt`` and ``rf`` stand in for boosting libraries that are not here, under their own names."""
    return {
        "logreg": lambda f, seed, **p: _pipeline(f, LogisticRegression(labelCol="y", weightCol="weight", **{"regParam": 0.01} | p)),
        "mlp": lambda f, seed, **p: _pipeline(f, MultilayerPerceptronClassifier(labelCol="y", layers=[len(f), 128, 64, 2], seed=seed, **{"maxIter": 100} | p)),
        "gbt": lambda f, seed, **p: _pipeline(f, GBTClassifier(labelCol="y", weightCol="weight", seed=seed, **{"maxDepth": 5, "maxIter": 40, "stepSize": 0.1} | p)),
        "rf": lambda f, seed, **p: _pipeline(f, RandomForestClassifier(labelCol="y", weightCol="weight", seed=seed, **{"maxDepth": 8, "numTrees": 100} | p)),
    }


#: What a random search draws from.
SEARCH: dict[str, dict[str, tuple]] = {
    "logreg": {"regParam": (0.001, 0.01, 0.1, 1.0), "elasticNetParam": (0.0, 0.5)},
    "mlp": {"maxIter": (50, 100, 200)},
    "gbt": {"maxDepth": (3, 4, 5), "maxIter": (20, 40, 80), "stepSize": (0.05, 0.1, 0.2)},
    "rf": {"maxDepth": (5, 8, 10), "numTrees": (50, 100, 200)},
}


def tuned(train: DataFrame, features: Sequence[str], model: str, budget: int, seed: int = 0) -> dict:
    """The best of ``budget`` drawn settings by average precision on the last fifth of the training rows in time; none for no budget."""
    import random

    from auditspark.operators.metrics import ranking
    from auditspark.operators.protocol import chronological_split

    if budget <= 0:
        return {}
    inner = chronological_split(train, 0.8)
    early, late = inner.where("role = 'train'").drop("role"), inner.where("role = 'test'").drop("role")
    draw, best = random.Random(seed), (-1.0, {})
    for _ in range(budget):
        p = {k: draw.choice(v) for k, v in SEARCH[model].items()}
        got = ranking(fit_score(early, late, features, model, seed, parameters=p)).first().auprc or 0.0
        best = max(best, (got, p), key=lambda x: x[0])
    return best[1]


def fit_score(train: DataFrame, test: DataFrame, features: Sequence[str], model: str = "gbt", seed: int = 0, miss_cost: float | None = None, parameters: dict | None = None) -> DataFrame:
    """``test`` with ``score``. Positives weigh ``miss_cost``, or as much as the negatives together.

    Nulls take the training median; a feature without any training value is 0 throughout.
    """
    if miss_cost is None:
        n = train.agg(F.sum("y"), F.count("*")).first()
        miss_cost = max(1.0, (n[1] - n[0]) / max(1, n[0]))
    weighted = train.withColumn("weight", F.when(F.col("y") == 1, float(miss_cost)).otherwise(1.0))
    met = train.agg(*(F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in features)).first()
    empty = {c: F.lit(0.0) for c in features if not met[c]}
    fitted = registry()[model](features, seed, **(parameters or {})).fit(weighted.withColumns(empty) if empty else weighted)
    out = fitted.transform(test.withColumns(empty) if empty else test)
    return out.withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")
