"""The audit's experiments: each makes one result table from prepared rows.

Prepared rows have row_id, t, day, entity, y, amount, is_index, the risk attributes and
numeric features. Features depend on fold, latency and switches, not on model or seed,
so they are built once for each fold and kept for all models.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.config import ABLATIONS, CONFIG, DAY, LADDER, UID_RECIPES, UNCONSTRAINED, Rung
from auditspark.functions.scalar import assert_label_free, block_key, family, matrix
from auditspark.operators import entities as E
from auditspark.operators import metrics as M
from auditspark.operators import models as ML
from auditspark.operators import monotone as G
from auditspark.operators import protocol as P
from auditspark.operators import regimes as R
from auditspark.operators import risk as K
from auditspark.sources import paysim
from auditspark.sources.shared import saved


@dataclass
class Prepared:
    rows: DataFrame
    attributes: Sequence[str]
    numeric: Sequence[str]
    blocks: Sequence[str] = ()
    plan: P.FoldPlan = field(default_factory=P.FoldPlan)
    rounds: int = 20
    categorical: Sequence[str] = ()
    origin: int = 0
    tau: float = CONFIG.tau_days * DAY


@dataclass
class Fold:
    start: int
    train: DataFrame
    test: DataFrame


def folds(p: Prepared, latency: int, disjoint: bool, at_most: int | None = None) -> Iterator[Fold]:
    """The folds large enough, with their rows; their number is the number of windows."""
    plan = P.FoldPlan(p.plan.fold_days, p.plan.min_train_days, latency, disjoint, p.plan.min_test, p.plan.min_train, p.plan.min_positives)
    members = saved(P.membership(p.rows, plan), "members")
    starts = [r.start for r in P.fold_meta(members, plan).orderBy("start").collect()]
    for start in starts[:at_most]:
        own = members.where(F.col("start") == start).select("row_id", "role")
        yield Fold(start, p.rows.join(own.where("role = 'train'").select("row_id"), "row_id"), p.rows.join(own.where("role = 'test'").select("row_id"), "row_id"))


def features(p: Prepared, f: Fold, latency: int, past_only: bool = True, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, names): the fold's rows with risk, memory, velocity and missingness features.

    Labels of training rows only are learnt from, unless ``past_only`` is off.
    """
    flagged = saved(f.train.withColumn("_train", F.lit(True)).unionByName(f.test.withColumn("_train", F.lit(False))), "fold")
    seen = F.col("_train") if past_only else F.lit(True)
    wide = flagged.select("row_id", "_train", "t", "entity", "y", "amount", *(c for c in ("is_index",) if c in flagged.columns), *p.numeric)
    parts: list[DataFrame] = []
    if "association_risk" not in drop and p.attributes:
        parts.append(K.risk_features(flagged, p.attributes, latency * DAY, p.tau, p.origin, seen))
    if "entity_memory" not in drop:
        parts.append(K.entity_memory(flagged, latency * DAY, seen))
    if "velocity" not in drop:
        parts.append(K.velocity(flagged))
    if "missingness" not in drop and p.blocks:
        missing = R.missing_features(flagged, p.blocks)
        parts.append(missing.select("row_id", *(c for c in missing.columns if c.startswith("miss_"))))
        # Regimes are mined from the training rows' patterns; every row has its nearest one.
        regimes = saved(R.retained(R.patterns(f.train, p.blocks)), "regimes")
        parts.append(R.assigned(flagged, p.blocks, regimes).select("row_id", "regime"))
    if p.categorical:
        # Codes are made within the fold; they carry no labels.
        parts.append(matrix(flagged, "row_id", p.categorical))
    for part in parts:
        wide = wide.join(part, "row_id")
    names = [c for c in wide.columns if c not in ("row_id", "_train", "t", "entity", "y", "amount", "is_index")]
    assert_label_free(wide.select(*names))
    # Doubles throughout: the model boundary is numeric.
    wide = wide.select("row_id", "_train", "t", "entity", "y", "amount", *(c for c in ("is_index",) if c in wide.columns), *(F.col(c).cast("double").alias(c) for c in names))
    wide = saved(wide, "features")
    return wide.where("_train").drop("_train"), wide.where("not _train").drop("_train"), names


def resampled(train: DataFrame, test: DataFrame, names: Sequence[str], how: str, seed: int) -> DataFrame:
    """``train`` with synthetic positives: between positives of all rows ("before" the split), of ``train`` ("inside"), or none."""
    if how == "none":
        return train
    rows = train.unionByName(test) if how == "before" else train
    medians = rows.where("y = 1").select(*(F.percentile_approx(c, 0.5).alias(c) for c in names)).first()
    filled = F.array(*(F.coalesce(F.col(c), F.lit(float(medians[c] or 0.0))) for c in names)).cast("array<double>")
    made = ML.oversampled(rows.withColumn("vector", filled), seed=seed).where("synthetic")
    return train.unionByName(made.select("row_id", F.col("y").cast(train.schema["y"].dataType).alias("y"), *(F.col("vector")[i].alias(c) for i, c in enumerate(names))), allowMissingColumns=True)


def with_regimes(p: Prepared, f: Fold, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``regime``, from the training rows' null patterns; null without blocks and for synthetic rows."""
    if "regime" in train.columns:
        return train, test
    if not p.blocks:
        return tuple(df.withColumn("regime", F.lit(None).cast("int")) for df in (train, test))
    regimes = saved(R.retained(R.patterns(f.train, p.blocks)), "regimes")
    return tuple(df.join(R.assigned(of, p.blocks, regimes).select("row_id", "regime"), "row_id", "left") for df, of in ((train, f.train), (test, f.test)))


def scored(train: DataFrame, test: DataFrame, names: Sequence[str], model: str, seed: int, rounds: int = 20, enforce: bool = True) -> DataFrame:
    """``test`` with ``score`` from a baseline or, for ``monotone``, the constrained ensemble.

    The ensemble's rows also have ``calibrated``, by regime, from its scores of the training rows.
    """
    if model != "monotone":
        return ML.fit_score(train, test, names, model, seed)
    rising = [c for c in names if c in K.constrained_features([x.removeprefix("risk_") for x in names if x.startswith("risk_")])]
    fitted = G.fit(train, names, rising if enforce else (), rounds)
    return ML.isotonic(saved(fitted.transform(train).select("regime", "score", "y"), "raw"), saved(fitted.transform(test), "raw"))


def run_fold(p: Prepared, f: Fold, model: str, seed: int, latency: int, past_only: bool = True, drop: Sequence[str] = (), resample: str = "none", enforce: bool = True, tuning: int = 0) -> dict:
    """One row of metrics; an error becomes a row that says so."""
    began = time.perf_counter()
    try:
        train, test, names = features(p, f, latency, past_only, drop)
        known = train.select("entity").distinct().withColumn("_k", F.lit(True))
        fitted = resampled(train, test, names, resample, seed)
        if resample != "none":
            fitted = saved(fitted, "resampled")
        if tuning and model != "monotone":
            # Synthetic rows have no time; settings are chosen on the rows that have.
            parameters = ML.tuned(train, names, model, tuning, seed)
            rows = ML.fit_score(fitted, test, names, model, seed, parameters=parameters)
        else:
            if model == "monotone":
                fitted, test = with_regimes(p, f, fitted, test)
            rows = scored(fitted, test, names, model, seed, p.rounds, enforce)
        rows = saved(rows.join(known, "entity", "left").withColumn("is_cold", F.col("_k").isNull()).drop("_k"), "scored")
        out = M.evaluated(rows, "calibrated" if "calibrated" in rows.columns else "score").first().asDict()
        if "is_index" in rows.columns:
            out |= M.time_to_detection(rows).first().asDict()
        out |= {"n_features": len(names), "n_train": train.count(), "n_synthetic": fitted.count() - train.count() if resample != "none" else 0}
    except Exception as e:  # noqa: BLE001  the grid goes on
        out = {"error": str(e)[:300]}
    return out | {"model": model, "seed": seed, "start": f.start, "seconds": time.perf_counter() - began}


def table(df: DataFrame, rows: list[dict]) -> DataFrame:
    """A result table of a few rows of metrics."""
    import pandas as pd

    flat = pd.DataFrame(rows)
    for c in flat.columns:
        flat[c] = flat[c].astype(str) if flat[c].dtype == object and c in ("model", "error", "rung", "ablation", "condition") else pd.to_numeric(flat[c]).astype(float) if c not in ("model", "error", "rung", "ablation", "condition") else flat[c]
    return df.sparkSession.createDataFrame(flat)


def _run_rung(p: Prepared, rung: Rung, model: str, seeds: Sequence[int], at_most: int | None) -> list[dict]:
    rows = []
    for seed in seeds:
        if rung.random_split:
            splits = P.random_folds(p.rows, 3 if at_most is None else at_most, seed=seed)
            for k in range(3 if at_most is None else at_most):
                rows.append(run_fold(p, _random_fold(p, k, splits), model, seed, rung.latency, rung.past_only, resample=rung.resample) | {"rung": rung.key})
        else:
            rows += [run_fold(p, f, model, seed, rung.latency, rung.past_only, resample=rung.resample) | {"rung": rung.key} for f in folds(p, rung.latency, rung.entity_disjoint, at_most)]
    return rows


def ladder(p: Prepared, model: str = "gbt", seeds: Sequence[int] = CONFIG.seeds, rungs: Sequence[Rung] = LADDER, at_most: int | None = None) -> DataFrame:
    """T1: metrics of each rung, by seed and fold."""
    return table(p.rows, [r for g in rungs for r in _run_rung(p, g, model, seeds, at_most)])


def main_comparison(p: Prepared, models: Sequence[str], seeds: Sequence[int] = CONFIG.seeds, latency: int = CONFIG.headline_latency, at_most: int | None = None, tuning: int = 0) -> DataFrame:
    """T3 and, with its seconds, T7: models on the same matured, disjoint folds; ``tuning`` settings are tried for each baseline."""
    return table(p.rows, [run_fold(p, f, m, s, latency, tuning=tuning) for f in folds(p, latency, True, at_most) for m in models for s in seeds])


def ablation(p: Prepared, model: str = "monotone", seeds: Sequence[int] = CONFIG.seeds, latency: int = CONFIG.headline_latency, at_most: int | None = None) -> DataFrame:
    """T4: without one family of features, or the constraints, at a time."""
    rows = [run_fold(p, f, model, s, latency, drop=d, enforce=k not in UNCONSTRAINED) | {"ablation": k} for f in folds(p, latency, True, at_most) for k, d in ABLATIONS.items() for s in seeds]
    return table(p.rows, rows)


def latency_sweep(p: Prepared, models: Sequence[str], seeds: Sequence[int] = CONFIG.seeds, latencies: Sequence[int] = CONFIG.latency_days, at_most: int | None = None) -> DataFrame:
    """T5: how long labels take to mature."""
    return table(p.rows, [run_fold(p, f, m, s, d) | {"delta_days": d} for d in latencies for f in folds(p, d, True, at_most) for m in models for s in seeds])


def size_control(p: Prepared, model: str = "gbt", seeds: Sequence[int] = CONFIG.seeds, at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """T1b and its attribution: full, size-matched and disjoint training, aligned by window start."""
    opened, closed = {f.start: f for f in folds(p, 0, False, at_most)}, {f.start: f for f in folds(p, 0, True, at_most)}
    rows = []
    for start in sorted(set(opened) & set(closed)):
        o, c = opened[start], closed[start]
        n = c.train.count()
        for s in seeds:
            for name, f in (("full", o), ("size_matched", Fold(start, P.sampled(o.train, n, s), o.test)), ("entity_disjoint", c)):
                rows.append(run_fold(p, f, model, s, 0) | {"condition": name})
    raw = table(p.rows, rows)
    mean = raw.groupBy("condition").agg(F.avg("auprc").alias("auprc_mean"))
    return raw, M.attribution(mean)


def drift_and_decay(p: Prepared, model: str = "gbt", latency: int = CONFIG.headline_latency, days: int = 7, at_most: int | None = None) -> DataFrame:
    """label-free drift windows, each with the performance of the nearest fold."""
    perf = table(p.rows, [run_fold(p, f, model, 0, latency) for f in folds(p, latency, True, at_most)])
    regimes = R.retained(R.patterns(p.rows, p.blocks))
    series = R.drift(R.assigned(p.rows, p.blocks, regimes), regimes, days)
    scored = perf.select(F.col("start").cast("int").alias("start"), "auprc").withColumn("fold_id", F.col("start"))
    return R.nearest_fold(series, scored)


def entity_variants(df: DataFrame, weights: dict[str, float], guarded: Sequence[str] = E.GUARDED, day_key: str = "D15n", recipes: dict[str, Sequence[str]] = UID_RECIPES) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """By recipe, ``df`` with the ``entity`` it finds, and the merges it rejects."""
    found, rejects = {}, {}
    for name, recipe in recipes.items():
        blocked = df.withColumns({"block": block_key([F.col(c) for c in recipe], F.col("row_id")), "coarse": block_key([F.col(c) for c in (recipe[0], recipe[-1])], F.col("row_id"))})
        guards = [c for c in guarded if c in df.columns]
        found[name] = E.resolved(blocked.drop("entity"), "block", "coarse", weights, guards, day_key).withColumnRenamed("entity_block", "entity")
        rejects[name] = E.merge_rejects(blocked, "block", "coarse", weights, guards, day_key)
    return found, rejects


def entity_table(variants: dict[str, DataFrame], counters: Sequence[str] = (), rejects: dict[str, DataFrame] | None = None) -> DataFrame:
    """T2: statistics of the entities that each recipe finds, how often counters fall within them, and the merges rejected."""
    out = None
    for name, df in variants.items():
        one = E.entity_sizes(df).crossJoin(E.entity_purity(df)).crossJoin(E.left_truncated(df).select("n_left_truncated"))  # single rows
        if "true_entity" in df.columns:
            one = one.crossJoin(E.pair_quality(df, "entity", "true_entity"))
        if counters:
            one = one.crossJoin(E.counter_violations(df, counters).select(F.col("n_pairs").alias("c_pairs"), F.col("violation_rate").alias("c_violation_rate")))
        if rejects and name in rejects:
            one = one.crossJoin(rejects[name])
        one = one.select(F.lit(name).alias("uid_variant"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _middle(found: Sequence[Fold]) -> Fold | None:
    return found[len(found) // 2] if found else None


def _random_fold(p: Prepared, k: int, splits: DataFrame) -> Fold:
    own = splits.where(F.col("split") == k)
    return Fold(k, p.rows.join(own.where("role = 'train'").select("row_id"), "row_id"), p.rows.join(own.where("role = 'test'").select("row_id"), "row_id"))


def attribution_migration(p: Prepared, seed: int = 0) -> DataFrame:
    """feature mass by family in the middle fold of the leakiest protocol (random splits) and of the closed one."""
    leaky = _random_fold(p, 1, P.random_folds(p.rows, 3, seed=seed))
    closed = _middle(list(folds(p, CONFIG.headline_latency, True)))
    parts = None
    for protocol, f, latency, past_only in (("leaky", leaky, 0, False), ("closed", closed, CONFIG.headline_latency, True)):
        if f is None:
            continue
        train, test, names = features(p, f, latency, past_only)
        m = p.rows.sparkSession.createDataFrame(G.mass(G.fit(train, names, rounds=p.rounds), test))
        one = m.groupBy(family(F.col("feature")).alias("family")).agg(F.sum("share").alias("share")).withColumn("protocol", F.lit(protocol))
        parts = one if parts is None else parts.unionByName(one)
    return M.migration(parts)


def faithfulness(p: Prepared, latency: int = CONFIG.headline_latency, at_most: int = 1) -> DataFrame:
    """T6: the price of monotonicity, its verification, and how many alerts have a reason code."""
    rows = []
    for f in folds(p, latency, True, at_most):
        train, test, names = features(p, f, latency)
        rising = [c for c in names if c in K.constrained_features(p.attributes)]
        held, free = G.fit(train, names, rising, p.rounds), G.fit(train, names, rounds=p.rounds)
        limit = M.quantile(held.transform(test), 1 - CONFIG.budget).first()[0]
        alerts = held.transform(test).where(F.col("score") >= limit)
        codes = G.reason_codes(held, alerts, rising, limit)
        covered = codes.agg(F.count("*"), F.count("feature")).first()
        ranks = [M.ranking(m.transform(test)).first() for m in (held, free)]
        drops = G.violations(held, test, rising)  # a row for each constrained feature
        rows.append({"start": f.start, "auprc_monotone": ranks[0].auprc, "auprc_free": ranks[1].auprc, "worst_drop": float(drops["worst_drop"].max()) if len(drops) else 0.0, "n_alerts": covered[0], "n_explained": covered[1]})
    return table(p.rows, rows)


def roar(p: Prepared, f: Fold, latency: int = CONFIG.headline_latency, shares: Sequence[float] = (0.0, 0.1, 0.2, 0.4), seed: int = 0) -> DataFrame:
    """Remove and refit: performance without the features of most mass, and without as many by chance."""
    import random

    train, test, names = features(p, f, latency)
    order = G.mass(G.fit(train, names, rounds=p.rounds), test).sort_values("share", ascending=False)["feature"].tolist()
    chance = names[:]
    random.Random(seed).shuffle(chance)
    rows = []
    for removal, by in (("top", order), ("random", chance)):
        for share in shares:
            kept = [c for c in names if c not in by[: int(share * len(names))]]
            rows.append({"model": removal, "fraction_removed": share, "auprc": M.ranking(G.fit(train, kept, rounds=p.rounds).transform(test)).first().auprc})
    return table(p.rows, rows)


def paysim_ladder(df: DataFrame, model: str = "gbt", seeds: Sequence[int] = (0, 1, 2)) -> tuple[DataFrame, DataFrame]:
    """L5 and its evidence. ``df`` has ``row_id``, the file's row numbers."""
    rows, x = [], paysim.with_residuals(df).withColumnRenamed("isFraud", "y").withColumn("t", F.col("step").cast("long"))
    split = saved(P.chronological_split(x), "split")
    numeric = [f.name for f in split.schema.fields if f.dataType.typeName() in ("double", "integer") and f.name not in ("y", "t", "row_id")]
    for key, drop in paysim.RUNGS.items():
        names = [c for c in numeric if c not in drop]
        for s in seeds:
            out = ML.fit_score(split.where("role = 'train'"), split.where("role = 'test'"), names, model, s)
            rows.append(M.evaluated(out, "score").first().asDict() | {"rung": key, "seed": s, "n_features": len(names)})
    return table(df, rows), paysim.evidence(paysim.with_residuals(df))
