"""Every analytics query over the TPC-H-like tables, and its SQL (``plans.oracle``).

Those that read tables cover them whole; ``paysim_residuals``, ``paysim_evidence``,
``feature_families`` and ``ladder_vs_hypothesis`` read a few fixed rows, since no table has
their columns, and ``synth_invariants`` the generator's. Orders span 2,400 days, so their folds are 90 days long
after 360 days of history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.config import DAY
from auditspark.functions import scalar as S
from auditspark.operators import entities as E
from auditspark.operators import metrics as M
from auditspark.operators import models as ML
from auditspark.operators import protocol as P
from auditspark.operators import regimes as R
from auditspark.operators import risk as K
from auditspark.plans import oracle
from auditspark.sources import adapters as A
from auditspark.sources import paysim, synthetic

ATTRIBUTES = ("priority", "segment", "nation")
DELAY, TAU = 30 * DAY, 30.0 * DAY
#: 1995-01-01, from which times are counted before exponents are taken.
ORIGIN = 788_918_400
OPEN = P.FoldPlan(90, 360, 0, False)
CLOSED = P.FoldPlan(90, 360, 30, True)
REGIME_BLOCKS = ("a", "c", "d")


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.with_time_and_amount(A.txn_orders(spark, sf_dir))
    return df.select("row_id", "day", "hour", "dow", "odd_hour", _r("log_amt"), "amt_cents", "amt_is_round")


def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.sparse_orders(spark, sf_dir)
    return df.select("row_id", S.composite_key(F.col("c"), F.col("d")).alias("product_card"), S.composite_key(F.col("b"), F.col("c"), F.col("d"), sep="|", missing="<NA>").alias("bin_proxy"))


def nan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sparse_orders(spark, sf_dir).select("row_id", S.null_count(A.SPARSE).alias("nan_count"))


def factorize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.factorized(A.sparse_orders(spark, sf_dir), "c", "row_id", "code").select("row_id", "code")


def _aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with D1, days since the entity's first, and the day keys."""
    o = A.with_day(A.txn_orders(spark, sf_dir))
    first = o.groupBy("entity").agg(F.min("day").alias("_first"))
    o = o.join(first, "entity").withColumn("D1", (F.col("day") - F.col("_first")).cast("double")).drop("_first")
    return o.withColumns({"D1n": S.first_day_key(F.col("t"), F.col("D1")), "D15n": S.rounded_first_day_key(F.col("t"), F.col("D1"))})


def d1n_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aged(spark, sf_dir).select("row_id", F.col("D1n").cast("long").alias("d1n"), F.col("D15n").cast("long").alias("d15n"))


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _aged(spark, sf_dir)
    o = o.withColumn("addr", F.when(F.col("row_id") % 17 != 0, F.col("segment")))
    first = F.col("D1n").cast("long")
    block = S.block_key([F.col("nation"), F.col("addr"), first], F.col("row_id"))
    coarse = S.block_key([F.col("nation"), first], F.col("row_id"))
    return o.withColumns({"block": block, "coarse": coarse})


def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(spark, sf_dir).select("row_id", "block", "coarse")


def er_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = E.representatives(_blocked(spark, sf_dir), "block", "coarse", ["segment", "priority"])
    return E.candidate_pairs(reps, "block", "coarse", ["segment", "priority"]).select("block", "anchor", "coarse", "blocks")


_WEIGHTS = {"segment": 1.2, "priority": 0.6}


def er_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["segment", "priority", "D15n"]
    reps = E.representatives(_blocked(spark, sf_dir), "block", "coarse", columns)
    pairs = E.candidate_pairs(reps, "block", "coarse", columns)
    return pairs.select("block", "anchor", F.round(E.agreement(_WEIGHTS), 6).alias("score"), E.conflict(("priority",), "D15n").alias("in_conflict"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.resolved(_blocked(spark, sf_dir), "block", "coarse", _WEIGHTS, (), "D15n")
    return out.withColumnRenamed("entity", "true_entity").withColumnRenamed("entity_block", "entity")


def er_pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.pair_quality(_resolved(spark, sf_dir), "entity", "true_entity")
    return q.select(_r("pair_precision"), _r("pair_recall"), _r("pair_f1"))


def entity_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.entity_sizes(A.txn_orders(spark, sf_dir))
    return s.select("n_entities", _r("size_mean"), _r("size_median"), _r("size_p95"), "size_max", _r("singleton_share"))


def entity_label_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.entity_purity(A.txn_orders(spark, sf_dir))
    return s.select(*(_r(c) for c in s.columns))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 and C2: running counts and sums of the true entity."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("t", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    o = A.txn_orders(spark, sf_dir)
    return o.withColumns({"C1": F.count("*").over(w).cast("double"), "C2": F.when(F.col("row_id") % 19 != 0, F.sum(F.floor("amount")).over(w).cast("double"))})


def c_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _counted(spark, sf_dir)
    own = E.counter_violations(o, ["C1", "C2"]).select(F.lit("customer").alias("key"), "*")
    coarse = E.counter_violations(o, ["C1", "C2"], "nation").select(F.lit("nation").alias("key"), "*")
    return own.union(coarse).select("key", "n_pairs", "n_falls", _r("violation_rate"))


def t2_entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _resolved(spark, sf_dir)
    sizes = E.entity_sizes(o).select("n_entities", _r("size_mean"), _r("size_median"), _r("size_p95"), "size_max", _r("singleton_share"))
    purity = E.entity_purity(o)
    quality = E.pair_quality(o, "entity", "true_entity")
    cut = E.left_truncated(o).select("n_left_truncated")
    return sizes.crossJoin(purity.select(*(_r(c) for c in purity.columns))).crossJoin(quality.select(*(_r(c) for c in quality.columns))).crossJoin(cut)  # single rows


def index_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.index_events(A.txn_orders(spark, sf_dir)).select("row_id", "is_index")


def left_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.left_truncated(A.txn_orders(spark, sf_dir))


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.propagated_labels(A.txn_orders(spark, sf_dir)).select("row_id", "y_propagated")


def left_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = A.table(spark, sf_dir, "customer").join(users, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_matched"), F.round(F.avg(F.col("n").isNotNull().cast("double")), 6).alias("coverage"))


def eb_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = K.unpivoted(A.txn_orders(spark, sf_dir), ATTRIBUTES, ["row_id", "y"])
    p = K.beta_prior(long)
    return p.select("attribute", _r("alpha0", 4), _r("beta0", 4))


def assoc_risk_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = K.association_risk(A.txn_orders(spark, sf_dir), ATTRIBUTES, DELAY, TAU, ORIGIN)
    return r.select("row_id", "attr", _r("pos", 4), _r("tot", 4), _r("risk"))


def assoc_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = K.risk_summary(K.association_risk(A.txn_orders(spark, sf_dir), ATTRIBUTES, DELAY, TAU, ORIGIN))
    return r.select("row_id", _r("risk_max"), _r("risk_mean"), _r("risk_prop"))


def entity_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = K.entity_memory(A.txn_orders(spark, sf_dir), DELAY)
    return m.select("row_id", "mem_prior_txn_count", "mem_prior_fraud_count", "mem_known_compromised", _r("mem_days_since_first_fraud"))


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = K.velocity(A.txn_events(spark, sf_dir), t="t_us", unit=1_000_000)
    return v.select("row_id", "vel_txn_1d", "vel_txn_7d", _r("vel_amt_7d", 4), _r("vel_recency_days"))


def regime_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.retained(R.patterns(A.sparse_orders(spark, sf_dir), REGIME_BLOCKS), 0.05)
    return r.select(F.col("regime").cast("long").alias("regime"), "pattern", "n", _r("support"))


def _regimes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = A.with_day(A.sparse_orders(spark, sf_dir))
    regimes = R.retained(R.patterns(rows, REGIME_BLOCKS), 0.05)
    return R.assigned(rows, REGIME_BLOCKS, regimes), regimes


def regime_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _regimes(spark, sf_dir)
    return rows.select("row_id", "pattern", F.col("regime").cast("long").alias("regime"))


def missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.sparse_orders(spark, sf_dir)
    columns = R.minable_columns(df.select("row_id", *A.SPARSE), ["row_id"])
    groups = R.missing_blocks(df, columns)
    return spark.createDataFrame([(",".join(g), len(g)) for g in groups], "columns string, n_columns int")


def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.missing_features(A.sparse_orders(spark, sf_dir), REGIME_BLOCKS)
    return df.select("row_id", *(f"miss_blk_{c}" for c in REGIME_BLOCKS), _r("miss_density"))


def regime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, regimes = _regimes(spark, sf_dir)
    d = R.distribution(rows, regimes)
    return d.select(F.col("regime").cast("long").alias("regime"), "n", _r("share"))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, regimes = _regimes(spark, sf_dir)
    return R.drift(rows, regimes, 90)


def drift_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("window", "day_start", "n", _r("js"), "top_regime")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_score(A.txn_orders(spark, sf_dir))


def _folds(spark: SparkSession, sf_dir: str, plan: P.FoldPlan) -> DataFrame:
    return P.membership(A.with_day(A.txn_orders(spark, sf_dir)), plan)


def drift_asof_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _folds(spark, sf_dir, OPEN)
    meta = P.fold_meta(members, OPEN).select("fold_id", "start")
    tested = members.where("role = 'test'").select("start", "row_id", "y")
    scored = A.with_score(tested)
    perf = M.ranking(scored, ["start"]).select("start", "auprc")
    folds = meta.join(perf, "start")
    out = R.nearest_fold(_drift(spark, sf_dir), folds)
    return out.select("window", "day_start", _r("js"), F.col("fold_id").cast("long").alias("fold_id"), F.col("start").alias("fold_start"), _r("auprc"))


def entity_disjoint_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _folds(spark, sf_dir, CLOSED).where("role = 'train'")
    return m.groupBy("start").agg(F.count("*").alias("n_train"), F.sum("row_id").alias("sum_row_id"))


def _meta(df: DataFrame) -> DataFrame:
    return df.select(F.col("fold_id").cast("long").alias("fold_id"), "start", "n_train", "n_test", "n_entity_dropped", "n_immature_dropped", _r("train_rate"), _r("test_rate"))


def fold_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(P.fold_meta(_folds(spark, sf_dir, CLOSED), CLOSED))


def cold_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cold_rows(_folds(spark, sf_dir, OPEN)).select("start", "row_id", "is_cold")


def size_control_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.fold_meta(_folds(spark, sf_dir, OPEN), OPEN).select("start", F.col("n_train").alias("n_full"))
    b = P.fold_meta(_folds(spark, sf_dir, CLOSED), CLOSED).select("start", F.col("n_train").alias("n_disjoint"))
    return a.join(b, "start").select("start", "n_full", "n_disjoint", F.least("n_full", "n_disjoint").alias("n_matched"))


def random_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.random_folds(A.txn_orders(spark, sf_dir), key=F.col("row_id"))
    return f.select("split", "row_id", "role")


def size_matched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.txn_orders(spark, sf_dir)
    return P.sampled(o, 1000, order=F.pmod(F.col("row_id") * 7919, F.lit(104_729))).select("row_id", "y")


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chronological_split(A.txn_orders(spark, sf_dir)).select("row_id", "role")


def auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranking(_scored(spark, sf_dir)).select("n", "n_pos", _r("base_rate"), _r("auprc"), _r("auprc_lift"))


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranking(_scored(spark, sf_dir), ["segment"]).select("segment", "n", _r("auroc"))


def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.calibration(_scored(spark, sf_dir))
    return c.select(_r("brier"), _r("ece"))


def index_auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.index_ranking(E.index_events(_scored(spark, sf_dir)))
    return m.select("n_index_positives", "n_masked_propagated", _r("index_base_rate"), _r("index_auprc"), _r("index_auprc_lift"))


def _last_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored test rows of all windows, with the cold flag."""
    return A.with_score(P.cold_rows(_folds(spark, sf_dir, OPEN)))


def cold_entity_auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.cold_ranking(_last_cold(spark, sf_dir))
    return m.select("cold_n", "cold_n_pos", _r("cold_auprc"))


def time_to_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.time_to_detection(E.index_events(_scored(spark, sf_dir)), 0.05)
    return m.select("ttd_n_entities", _r("ttd_detected_share"), _r("ttd_median_txn"), _r("ttd_median_hours"), _r("ttd_early_share"))


def dollar_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.budget_recall(_scored(spark, sf_dir), tie=F.col("row_id"))
    return m.select(_r("dollar_recall_at_k"), _r("count_recall_at_k"), _r("alert_precision_at_k"), "k", "n_reviewed")


def evaluate_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.index_events(_scored(spark, sf_dir))
    m = M.evaluated(rows, "score", tie=F.col("row_id"))
    return m.select("n", "n_pos", *(_r(c) for c in ("base_rate", "auprc", "auroc", "auprc_lift", "brier", "ece")), "n_index_positives", _r("index_auprc"), _r("dollar_recall_at_k"), "n_reviewed")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by segment and nation, as runs of five models."""
    scored = _scored(spark, sf_dir)
    return M.ranking(scored, ["segment", "nation"]).select("segment", "nation", "n", "auprc", "auroc")


def aggregate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.aggregated_runs(_runs(spark, sf_dir).drop("nation"), ["segment"])
    return a.select("segment", *(_r(f"{c}_{s}") for c in ("n", "auprc", "auroc") for s in ("mean", "std")))


def size_control_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("BUILDING"), F.lit("full"), F.lit("MACHINERY"), F.lit("size_matched"), F.lit("FURNITURE"), F.lit("entity_disjoint"))
    a = M.aggregated_runs(_runs(spark, sf_dir).drop("nation"), ["segment"])
    a = a.select(F.element_at(names, F.col("segment")).alias("condition"), "auprc_mean").where("condition is not null")
    out = M.attribution(a)
    return out.select(*(_r(c, 4) for c in out.columns))


def _mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue shares of part types by return flag, as feature mass by protocol."""
    li = A.table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')")
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    m = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("family"), F.when(F.col("l_returnflag") == "A", "leaky").otherwise("closed").alias("protocol")).agg(F.sum("l_extendedprice").alias("mass"))
    total = m.groupBy("protocol").agg(F.sum("mass").alias("all"))
    return m.join(total, "protocol").select("family", "protocol", (F.col("mass") / F.col("all")).alias("share"))


def mass_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mass(spark, sf_dir).select("family", "protocol", _r("share"))


def pivot_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.migration(_mass(spark, sf_dir)).select("family", _r("leaky"), _r("closed"), _r("change"))


def feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in oracle.FEATURE_NAMES], "feature string")
    return names.select("feature", S.family(F.col("feature")).alias("family"))


def _paysim(spark: SparkSession) -> DataFrame:
    return paysim.with_residuals(spark.createDataFrame(list(oracle.PAYSIM_ROWS), "step int, amount double, oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"))


def paysim_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paysim(spark).select("step", _r("balance_err_orig", 4), _r("balance_err_dest", 4), "orig_emptied", "amount_eq_oldbalance", "day", "hour_of_day", _r("log_amount"))


def paysim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = paysim.evidence(_paysim(spark))
    return e.select("isFraud", "n", *(_r(c, 4) for c in e.columns[2:]))


def ladder_vs_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = spark.createDataFrame(list(oracle.MEASURED), "rung string, measured double")
    supposed = spark.createDataFrame(list(oracle.SUPPOSED), "rung string, hypothesised double")
    from auditspark.plans.report import against_hypothesis

    return against_hypothesis(measured, supposed).select("rung", "hypothesised", "measured", _r("difference"), "prediction_held")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("vector"))


def knn_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ML.nearest_neighbours(_vectors(spark, sf_dir).where("y = 1"))
    return n.select("id", F.col("neighbour"), F.col("rank").cast("long").alias("rank"), _r("distance", 4))


def smote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ML.oversampled(_vectors(spark, sf_dir), share=0.5)
    return out.groupBy("y", "synthetic").agg(F.count("*").alias("n"))


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("regime", F.col("nation"))
    c = ML.isotonic(rows.select("row_id", "y", "score", "regime"))
    return c.select("row_id", "regime", _r("calibrated"))


def synth_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.invariants(*synthetic.generate(spark, entities=400, days=180, seed=7))


_NAMES = (
    "base_features composite_keys nan_count factorize_codes d1n_key block_keys paysim_residuals feature_families left_join_coverage entity_disjoint_train fold_meta"
    " cold_entity_rows er_candidate_pairs er_agreement regime_assign drift_asof_perf assoc_risk_gated size_control_folds knn_minority entity_size_stats entity_label_purity"
    " t2_entity_stats er_pair_f1 eb_prior regime_patterns missing_blocks missing_features regime_distribution drift_js aggregate_runs pivot_migration paysim_evidence"
    " size_control_attribution index_events left_truncated c_monotonicity assoc_risk_summary entity_memory velocity time_to_detection label_propagation dollar_recall_at_k"
    " random_folds size_matched_sample chrono_split auprc auroc ece_brier index_auprc cold_entity_auprc evaluate_row smote_counts isotonic_calibration mass_by_family"
    " synth_invariants ladder_vs_hypothesis"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
