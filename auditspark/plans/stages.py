"""The experiments as stages of the command line: each makes one or more named result tables.

Rows come from a folder in the transaction layout, or from the generator where none is given.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.config import CONFIG
from auditspark.functions import scalar as S
from auditspark.operators import entities as E
from auditspark.plans import experiments as X
from auditspark.sources import paysim, readers, synthetic
from auditspark.sources.shared import saved

ATTRIBUTES = ("card1", "addr1", "P_emaildomain", "ProductCD")
NUMERIC = ("log_amt", "amt_cents", "amt_is_round", "odd_hour", "dow", "dist1", "C1", "C14")
CATEGORICAL = ("card4", "card6", "M1", "M2")
#: A column of each service: it is missing with all of its service's columns.
BLOCKS = ("V1", "V12", "V35", "V53", "V75", "V95", "D2")
COUNTERS = tuple(f"C{i}" for i in range(1, 15))


@dataclass(frozen=True)
class Run:
    """What a call of the command line sets; ``folds``: at most so many of each protocol."""

    model: str = "gbt"
    seeds: tuple[int, ...] = CONFIG.seeds
    folds: int | None = None
    tuning: int = 0


def rows(spark: SparkSession, folder: str | None = None, entities: int = 3000, seed: int = 0) -> DataFrame:
    """Transactions with resolved entities, index events and base features."""
    if folder:
        df = readers.load_transactions(spark, folder)
    else:
        txn, ident, truth = synthetic.generate(spark, entities=entities, seed=seed)
        df = txn.join(ident, "TransactionID", "left").join(truth.select("TransactionID", "true_entity"), "TransactionID")
    df = df.withColumns({"row_id": F.col("TransactionID"), "t": F.col("TransactionDT").cast("long"), "amount": F.col("TransactionAmt"), "y": F.col("isFraud").cast("int")})
    df = df.withColumns({"D1n": S.first_day_key(F.col("t"), F.col("D1")), "D15n": S.rounded_first_day_key(F.col("t"), F.col("D15"))})
    found, _ = X.entity_variants(df, CONFIG.agreement_weights, recipes={"medium": X.UID_RECIPES["medium"]})
    df = S.with_time_and_amount(found["medium"])
    return saved(E.index_events(df), "prepared")


def prepared(df: DataFrame) -> X.Prepared:
    return X.Prepared(df, ATTRIBUTES, [c for c in NUMERIC if c in df.columns], [c for c in BLOCKS if c in df.columns], categorical=[c for c in CATEGORICAL if c in df.columns])


def _two(names: tuple[str, str], tables: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    return dict(zip(names, tables, strict=True))


def _entities(df: DataFrame) -> DataFrame:
    found, rejects = X.entity_variants(df, CONFIG.agreement_weights)
    return X.entity_table(found, [c for c in COUNTERS if c in df.columns], rejects)


def _roar(p: X.Prepared, r: Run) -> DataFrame:
    return X.roar(p, next(X.folds(p, CONFIG.headline_latency, True, 1)))


STAGES: Mapping[str, Callable[[DataFrame, Run], dict[str, DataFrame]]] = {
    "T1": lambda df, r: {"T1": X.ladder(prepared(df), r.model, r.seeds, at_most=r.folds)},
    "T1b": lambda df, r: _two(("T1b", "T1b_attribution"), X.size_control(prepared(df), r.model, r.seeds, r.folds)),
    "T2": lambda df, r: {"T2": _entities(df)},
    "T3": lambda df, r: {"T3": X.main_comparison(prepared(df), (r.model, "logreg", "monotone"), r.seeds, at_most=r.folds, tuning=r.tuning)},
    "T4": lambda df, r: {"T4": X.ablation(prepared(df), seeds=r.seeds, at_most=r.folds)},
    "T5": lambda df, r: {"T5": X.latency_sweep(prepared(df), (r.model,), r.seeds, at_most=r.folds)},
    "T6": lambda df, r: {"T6": X.faithfulness(prepared(df)), "T6_roar": _roar(prepared(df), r)},
    "T7": lambda df, r: {"T7": X.main_comparison(prepared(df), (r.model, "logreg", "monotone"), r.seeds[:1], at_most=r.folds).select("model", "seconds", "n_train")},
    "F1": lambda df, r: {"F1": X.attribution_migration(prepared(df))},
    "F3": lambda df, r: {"F3": X.drift_and_decay(prepared(df), r.model, at_most=r.folds)},
}


def paysim_tables(spark: SparkSession, file: str, r: Run) -> dict[str, DataFrame]:
    """L5 and its evidence; the rows of the file are numbered in its order of steps."""
    from auditspark.operators.protocol import exact_rank

    df = paysim.load(spark, file)
    df = exact_rank(df, *(F.col(c) for c in df.columns)).withColumnRenamed("rank", "row_id")
    return _two(("L5", "L5_evidence"), X.paysim_ladder(df, r.model))
