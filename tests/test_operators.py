"""Micro-frames for ties, nulls, empty classes and boundaries, and brute force."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.config import CONFIG, DAY
from auditspark.functions import scalar as S
from auditspark.operators import entities as E
from auditspark.operators import metrics as M
from auditspark.operators import models as ML
from auditspark.operators import monotone as G
from auditspark.operators import protocol as P
from auditspark.operators import regimes as R
from auditspark.operators import risk as K
from auditspark.sources import synthetic


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def brute_sums(data, delay, tau):
    out = {}
    for i, k, t, y in data:
        w = [(math.exp(-(t - tj) / tau) if tau else 1.0, yj) for _, kj, tj, yj in data if kj == k and tj < t - delay]
        out[i] = (round(sum(a for a, _ in w), 6), round(sum(a * b for a, b in w), 6))
    return out


@pytest.mark.parametrize("delay", [0, 5, 40])
@pytest.mark.parametrize("tau", [None, 30.0])
def test_matured_sums_equal_brute_force(spark, delay, tau):
    r = random.Random(delay)
    data = [(i, r.choice("ab"), r.choice([0, 0, 5, 10, 10, 20, r.randrange(200)]), r.randrange(2)) for i in range(80)]
    df = frame(spark, data, "row_id long, k string, t long, y int")
    got = K.matured_sums(df, ["k"], {"n": F.lit(1), "p": F.col("y")}, delay, tau, bucket=16)
    assert {x.row_id: (round(x.n, 6), round(x.p, 6)) for x in got.collect()} == brute_sums(data, delay, tau)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 100), st.integers(0, 1)), min_size=1, max_size=25), st.integers(0, 30))
def test_longer_delay_never_matures_more(spark, items, delay):
    df = frame(spark, [(i, *x) for i, x in enumerate(items)], "row_id long, entity long, t long, y int")
    a = {r.row_id: r.n for r in K.matured_sums(df, ["entity"], {"n": F.lit(1)}, delay, bucket=10).collect()}
    b = {r.row_id: r.n for r in K.matured_sums(df, ["entity"], {"n": F.lit(1)}, delay + 7, bucket=10).collect()}
    assert all(b[i] <= a[i] for i in a)


def test_late_maturity_has_the_documented_weight(spark):
    # Labels on days 0 and 10, queries on days 35 and 45, delay = tau = 30 days.
    df = frame(spark, [(i, "v", d * DAY, e, 1) for i, (d, e) in enumerate([(0, 1), (10, 2), (35, 3), (45, 4)])], "row_id long, a string, t long, entity long, y int")
    r = {x.row_id: x.tot for x in K.association_risk(df, ["a"], 30 * DAY, 30.0 * DAY).collect()}
    assert r[2] == pytest.approx(math.exp(-35 / 30)) and r[3] == pytest.approx(math.exp(-35 / 30) + math.exp(-45 / 30))


def test_entity_alone_on_a_value_gets_the_prior(spark):
    df = frame(spark, [(i, "v", i * 100, 7, i % 2) for i in range(6)], "row_id long, a string, t long, entity long, y int")
    risks = {round(x.risk, 9) for x in K.association_risk(df, ["a"], 0, 1e6).collect()}
    assert risks == {0.5}


def test_missing_is_a_category(spark):
    df = frame(spark, [(0, None, 0, 1, 1), (1, None, 10, 2, 0)], "row_id long, a string, t long, entity long, y int")
    r = {x.row_id: x.tot for x in K.association_risk(df, ["a"], 0, 1e9).collect()}
    assert r[1] == pytest.approx(1.0)


def test_prior_branches(spark):
    few = frame(spark, [("a", str(i % 3), i % 2) for i in range(90)], "attr string, value string, y int")
    p = K.beta_prior(few).first()
    assert (p.alpha0, p.beta0) == pytest.approx((10.0, 10.0))
    flat = frame(spark, [("a", str(i // 40), i % 2) for i in range(240)], "attr string, value string, y int")
    p = K.beta_prior(flat).first()
    assert (p.alpha0, p.beta0) == pytest.approx((10.0, 10.0))
    split = frame(spark, [("a", str(i // 40), int(i >= 120)) for i in range(240)], "attr string, value string, y int")
    p = K.beta_prior(split).first()
    assert (p.alpha0, p.beta0) == pytest.approx((10.0, 10.0))


def test_memory_and_velocity(spark):
    df = frame(spark, [(0, 0, 1, 1, 5.0), (1, 0, 1, 0, 6.0), (2, 10 * DAY, 1, 0, 7.0), (3, 0, 2, 0, 1.0)], "row_id long, t long, entity long, y int, amount double")
    m = {r.row_id: r for r in K.entity_memory(df, DAY).collect()}
    assert (m[2].mem_prior_txn_count, m[2].mem_prior_fraud_count, m[2].mem_days_since_first_fraud) == (2, 1, 10.0)
    assert m[0].mem_prior_txn_count == 0 and m[0].mem_days_since_first_fraud is None
    v = {r.row_id: r for r in K.velocity(df).collect()}
    assert (v[1].vel_txn_1d, v[1].vel_amt_7d, v[1].vel_recency_days) == (1, 5.0, 0.0)
    assert (v[2].vel_txn_7d, v[2].vel_recency_days) == (0, 10.0)


def test_velocity_cap(spark):
    df = frame(spark, [(i, i * 60, 1, 1.0) for i in range(70)], "row_id long, t long, entity long, amount double")
    v = {r.row_id: r.vel_txn_7d for r in K.velocity(df).collect()}
    assert v[63] == 63 and v[69] == CONFIG.velocity_cap


def test_solo_blocks_and_conflicts(spark):
    df = frame(spark, [(1, "x", None), (2, "x", "s"), (3, "x", None)], "row_id long, a string, b string")
    keys = [r[0] for r in df.select(S.block_key([F.col("a"), F.col("b")], F.col("row_id"))).collect()]
    assert keys == ["__solo_1", "x|s", "__solo_3"]
    pairs = frame(spark, [("v", "v", 0.0, 3.0), ("v", "m", 0.0, 0.0), (None, "m", 0.0, 4.0), (None, None, None, 9.0)], "a_card4 string, card4 string, a_D15n double, D15n double")
    assert [r[0] for r in pairs.select(E.conflict(("card4",))).collect()] == [False, True, True, False]


def test_counter_nulls_hide_nothing_further(spark):
    df = frame(spark, [(1, 0, 1, 1.0), (2, 1, 1, None), (3, 2, 1, 0.0)], "row_id long, t long, entity long, C1 double")
    r = E.counter_violations(df, ["C1"]).first()
    assert (r.n_pairs, r.n_falls, r.violation_rate) == (0, 0, 0.0)


def test_resolution_recovers_generated_entities(spark):
    txn, _, truth = synthetic.generate(spark, entities=120, seed=3)
    t = txn.join(truth, "TransactionID").withColumn("D1n", S.first_day_key(F.col("TransactionDT"), F.col("D1")).cast("long")).withColumn("D15n", S.rounded_first_day_key(F.col("TransactionDT"), F.col("D15")))
    t = t.withColumn("row_id", F.col("TransactionID"))
    t = t.withColumns({"block": S.block_key([F.col(c) for c in ("card1", "addr1", "D1n")], F.col("row_id")), "coarse": S.block_key([F.col(c) for c in ("card1", "D1n")], F.col("row_id"))})
    weights = {c: w for c, w in CONFIG.agreement_weights.items() if c in t.columns}
    found = E.resolved(t, "block", "coarse", weights, E.GUARDED, "D15n")
    assert E.pair_quality(found, "entity_block", "true_entity").first().pair_f1 == 1.0
    assert E.counter_violations(t, ["C1", "C14"], "true_entity", "TransactionDT").first().n_falls == 0


def test_synthetic_invariants(spark):
    r = synthetic.invariants(*synthetic.generate(spark, entities=150, seed=1)).first()
    assert (r.day_key_breaks, r.label_falls, r.counter_falls) == (0, 0, 0)
    assert 0.15 < r.identity_coverage < 0.35


def test_fold_boundaries(spark):
    # Window starts on day 10; delay 3: day 6 is train, days 7 to 9 are not mature.
    df = frame(spark, [(d, d, d, 0) for d in range(14)], "row_id long, day int, entity long, y int")
    m = P.membership(df, P.FoldPlan(5, 10, 3, False)).where("start = 10")
    assert {r.row_id: r.role for r in m.collect()} == {**dict.fromkeys(range(7), "train"), **dict.fromkeys((7, 8, 9), "immature"), **dict.fromkeys(range(10, 14), "test")}


def test_disjoint_folds_share_no_entity_and_small_folds_go(spark):
    df = frame(spark, [(i, i % 20, i % 7, int(i % 3 == 0)) for i in range(600)], "row_id long, day int, entity long, y int")
    plan = P.FoldPlan(5, 10, 0, True, 1, 0, 0)
    m = P.membership(df, plan)
    assert m.where("role = 'train'").count() == 0 and m.where("role = 'shared'").count() > 0
    open_ = P.membership(df, P.FoldPlan(5, 10, 0, False))
    sizes = P.fold_meta(open_, P.FoldPlan(5, 10, 0, False, 150, 300, 5))
    assert [r.fold_id for r in sizes.collect()] == [0, 1]
    assert P.fold_meta(open_, P.FoldPlan(5, 10, 0, False, 151, 300, 5)).count() == 0


def test_rank_without_one_task(spark):
    df = frame(spark, [(i, (i * 37) % 101) for i in range(300)], "row_id long, t long")
    got = {r.row_id: r["rank"] for r in P.exact_rank(df, F.col("t"), F.col("row_id"), parts=7).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted(((i * 37) % 101, i) for i in range(300)))}
    assert got == want


def test_ranking_ties_and_one_class(spark):
    df = frame(spark, [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, score double")
    r = M.ranking(df).first()
    assert (round(r.auprc, 6), round(r.auroc, 6)) == (round(0.5 * 0.5 + 0.5 * 2 / 3, 6), 0.625)
    one = M.ranking(frame(spark, [(0, 0.1), (0, 0.2)], "y int, score double")).first()
    assert (one.n, one.auprc, one.auroc) == (2, None, None)
    none = M.ranking(frame(spark, [], "y int, score double")).first()
    assert (none.n, none.auprc) == (0, None)


def test_budget_rounds_half_to_even(spark):
    df = frame(spark, [(i, 1, float(i), 1.0) for i in range(5)], "row_id long, y int, score double, amount double")
    assert M.budget_recall(df, 0.5).first().n_reviewed == 2


def test_propagated_positives_are_masked(spark):
    df = frame(spark, [(1, 0, 1, 1, 0.9), (2, 1, 1, 1, 0.8), (3, 2, 1, 1, 0.1), (4, 0, 2, 0, 0.5)], "row_id long, t long, entity long, y int, score double")
    r = M.index_ranking(E.index_events(df)).first()
    assert (r.n_index_positives, r.n_masked_propagated, r.index_auprc) == (1, 2, 1.0)


def test_time_to_detection_signs(spark):
    data = [(1, 0, 1, 0, 0.99), (2, 3600, 1, 1, 0.1), (3, 0, 2, 1, 0.2), (4, 7200, 2, 1, 0.98), (5, 0, 3, 1, 0.3)]
    df = E.index_events(frame(spark, data, "row_id long, t long, entity long, y int, score double"))
    r = M.time_to_detection(df, 0.4).first()
    assert (r.ttd_n_entities, round(r.ttd_detected_share, 4), r.ttd_median_txn, r.ttd_early_share) == (3, 0.6667, 0.0, 0.5)


def test_regime_ties_and_fallback(spark):
    found = frame(spark, [(0b00, 1, 0.001), (0b11, 2, 0.002)], "pattern long, n long, support double")
    assert [r.pattern for r in R.retained(found).collect()] == [0b11]
    regimes = frame(spark, [(0, 0b00), (1, 0b11)], "regime int, pattern long")
    near = R.nearest_regime(frame(spark, [(0b01,)], "pattern long"), regimes).first()
    assert (near.regime, near.distance) == (0, 1)


def test_masks_beyond_63_columns(spark):
    df = spark.range(1).select(*(F.when(F.lit(i != 70), F.lit(1)).alias(f"v{i}") for i in range(80)))
    assert df.select(S.null_mask(df.columns)).first()[0] == [0, 1 << 7]


def test_neighbours_in_blocks_equal_one_block(spark):
    r = random.Random(0)
    df = frame(spark, [(i, [r.random() for _ in range(4)]) for i in range(60)], "row_id long, vector array<double>")
    key = lambda x: sorted(map(tuple, x.select("id", "rank", "neighbour").collect()))
    assert key(ML.nearest_neighbours(df, 3)) == key(ML.nearest_neighbours(df, 3, block_rows=13))


def test_monotone_trees_never_fall(spark):
    r = random.Random(2)
    data = []
    for _ in range(1500):
        a, b = r.random(), r.random()
        data.append((a, b, int(r.random() < 0.1 + 0.6 * a * (b > 0.5))))
    df = frame(spark, data, "a double, b double, y int")
    m = G.fit(df, ["a", "b"], ["a"], rounds=4, depth=3, miss_cost=1.0)
    v = G.violations(m, df, ["a"], tolerance=0.0)
    assert not v["violated"].any()
    scored = m.transform(df)
    assert M.ranking(scored).first().auroc > 0.7
    import numpy as np

    x = np.array([(a, b) for a, b, _ in data[:50]])
    assert np.allclose(m.score(x), [s.score for s in scored.limit(50).collect()])
    contributions = m.contributions(x)
    spread = m.raw(x) - contributions.sum(1)
    assert np.allclose(spread, spread[0])
    alerts = scored.withColumn("row_id", F.monotonically_increasing_id()).where("score > 0.5").limit(20)
    codes = G.reason_codes(m, alerts, ["a"], 0.5).toPandas().dropna()
    assert (codes["clearing"] < codes["value"]).all()


def test_forbidden_features(spark):
    with pytest.raises(ValueError, match="entity"):
        S.assert_label_free(frame(spark, [(1, 2)], "entity long, x long"))


def test_tuning_and_separate_calibration(spark):
    r = random.Random(3)
    data = [(i, i, float(i % 10), r.random(), int(r.random() < 0.2 + 0.05 * (i % 10)), i % 2) for i in range(300)]
    df = frame(spark, data, "row_id long, t long, a double, b double, y int, regime int")
    found = ML.tuned(df, ["a", "b"], "logreg", 2)
    assert set(found) == {"regParam", "elasticNetParam"} and ML.tuned(df, ["a"], "logreg", 0) == {}
    scored = ML.fit_score(df, df, ["a", "b"], "logreg", parameters=found)
    out = ML.isotonic(scored.where("row_id < 200"), scored.where("row_id >= 200"), min_rows=50)
    assert out.count() == 100 and out.where("calibrated < 0 or calibrated > 1").count() == 0


def test_command_line(capsys):
    from auditspark.__main__ import main

    assert main(["list"]) == 0 and "assoc_risk_gated" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing"])


def test_quantiles_of_any_column_by_group(spark):
    r = random.Random(4)
    rows = [(i, "ab"[i % 2], float(r.choice([0.0, 1.5, r.random() * 9])) if i % 11 else None) for i in range(500)]
    df = frame(spark, rows, "row_id long, g string, v double")
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        want = {x.g: x.p for x in df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        assert {x.g: x.threshold for x in M.quantile(df, q, "v", ["g"]).collect()} == pytest.approx(want)
        assert M.quantile(df, q, "v").first()[0] == pytest.approx(df.agg(F.percentile("v", F.lit(q))).first()[0])
    assert M.quantile(df.limit(0), 0.5, "v").first()[0] is None


def test_neighbours_across_blocks_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(4)), float(r.randrange(4)), r.choice([0.0, 1e6])]) for i in range(90)]
    df = frame(spark, rows, "row_id long, vector array<double>")
    want = {}
    for i, v in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, j) for j, w in rows if j != i)[:5]
        want[i] = [(j, round(d, 9)) for d, j in near]
    for size in (1000, 20):
        got = {}
        for x in ML.nearest_neighbours(df, 5, block_rows=size).orderBy("id", "rank").collect():
            got.setdefault(x.id, []).append((x.neighbour, round(x.distance, 9)))
        assert got == want


def test_counters_are_chained_across_buckets(spark):
    r = random.Random(6)
    rows = [(i, r.choice("abc"), r.randrange(400), r.choice([None, float(r.randrange(6))])) for i in range(300)]
    df = frame(spark, rows, "row_id long, entity string, t long, C1 double")
    whole = E.counter_violations(df, ["C1"], bucket=10_000).first()
    assert all(E.counter_violations(df, ["C1"], bucket=b).first() == whole for b in (1, 7, 60)) and whole.n_falls > 0


def test_no_task_ranks_or_samples_all_rows(spark):
    df = frame(spark, [(i, i % 7, 0.5, 1.0, i % 3 % 2) for i in range(100)], "row_id long, t long, score double, amount double, y int")
    for out in (P.sampled(df, 10), P.chronological_split(df), M.budget_recall(df, 0.1), S.factorized(df, "t", "row_id", "code"), M.quantile(df, 0.5)):
        plan = out._jdf.queryExecution().toString()
        assert "TakeOrderedAndProject" not in plan and "percentile" not in plan and "GlobalLimit" not in plan
    assert P.sampled(df, 10).count() == 10


def test_contributions_are_shapley_values():
    """Against all subsets of known features, a tree walked down both sides where a feature is not known."""
    import itertools

    import numpy as np

    t = G.Tree([0, 1, 0, -1, -1, 2, -1, -1, -1], [0.5, 0.3, 0.8, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0], [1, 3, 5, -1, -1, 7, -1, -1, -1], [2, 4, 6, -1, -1, 8, -1, -1, -1], [0, 0, 0, 1.5, -2.0, 0, 4.0, 0.7, -0.4], [10, 4, 6, 1, 3, 4, 2, 3, 1])
    m = G.MonotoneModel(["a", "b", "c"], 0.25, [t, t], 0.3)

    def expected(n, row, known):
        if t.feature[n] < 0:
            return t.value[n]
        sides = t.left[n], t.right[n]
        if t.feature[n] in known:
            return expected(sides[int(row[t.feature[n]] > t.threshold[n])], row, known)
        return sum(t.cover[c] * expected(c, row, known) for c in sides) / sum(t.cover[c] for c in sides)

    rows = np.array([[0.2, 0.1, 0.0], [0.6, 0.9, 0.05], [0.9, 0.2, 0.5], [0.7, math.nan, 0.2]])
    for row, got in zip(rows, m.contributions(rows), strict=True):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = 0.0
            for size in range(3):
                for known in itertools.combinations(rest, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    want += 0.6 * weight * (expected(0, row, {*known, f}) - expected(0, row, set(known)))
            assert got[f] == pytest.approx(want)


def test_merges_rejected_are_counted(spark):
    rows = [(1, "a", "c", "x", "p", 0), (2, "b", "c", "x", "q", 0), (3, "d", "c", "y", "p", 0), (4, "e", "c", "x", "p", 9), (5, "f", "z", "x", "p", 0)]
    df = frame(spark, rows, "row_id long, block string, coarse string, u string, v string, D15n long")
    one = E.merge_rejects(df, "block", "coarse", {"u": 1.0}, ("v",), "D15n", 0.5).first()
    assert (one.score_rejects, one.conflict_rejects) == (1, 2)
