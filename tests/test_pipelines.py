"""Streams, sources, reports and experiments, end to end on small data."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from auditspark.config import LADDER
from auditspark.functions import scalar as S
from auditspark.operators import entities as E
from auditspark.operators import protocol as P
from auditspark.operators import risk as K
from auditspark.plans import experiments as X
from auditspark.plans import figures, oracle, report
from auditspark.sources import adapters as A
from auditspark.sources import readers, synthetic
from auditspark.streaming import risk_stream
from support import SMALL


def test_stream_equals_batch(spark, tmp_path):
    e = A.txn_events(spark, SMALL).select("row_id", F.lit("k").alias("attr"), F.coalesce("k", F.lit("-")).alias("value"), "t", "y", F.timestamp_seconds("t").alias("ts"))
    e = e.limit(400).orderBy("t").coalesce(1)
    last = e.agg(F.max("t")).first()[0]
    # A row far in the future lets the watermark pass everything else.
    e = e.unionByName(spark.createDataFrame([(-1, "end", "end", last + 10**7, 0)], "row_id long, attr string, value string, t long, y int").withColumn("ts", F.timestamp_seconds("t")))
    source = str(tmp_path / "in")
    for k in range(3):
        part = e.where(F.col("row_id") >= 0).where(F.col("row_id") % 3 == k) if k < 2 else e.where((F.col("row_id") % 3 == 2) | (F.col("row_id") < 0))
        part.write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    delay, tau = 86400, 86400.0 * 5
    q = risk_stream.gated_counts(stream, delay, tau, "3650 days").writeStream.format("memory").queryName("gated").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # With such a watermark nothing is ready; a stream that waits an instant gives all.
    assert spark.table("gated").count() == 0
    ordered = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 100).parquet(source)
    q = risk_stream.gated_counts(ordered, delay, tau, "0 seconds").writeStream.format("memory").queryName("gated2").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.row_id: (round(r.pos, 6), round(r.tot, 6)) for r in spark.table("gated2").collect() if r.row_id >= 0}
    rows = e.where("row_id >= 0")
    origin = rows.agg(F.min("t")).first()[0]
    want = K.matured_sums(rows, ["attr", "value"], {"tot": F.lit(1), "pos": F.col("y")}, delay, tau, origin=origin)
    assert got == {r.row_id: (round(r.pos, 6), round(r.tot, 6)) for r in want.collect()}


def test_synthetic_files_are_read_back(spark, tmp_path):
    folder = str(tmp_path)
    synthetic.write(spark, folder, entities=60, seed=2)
    df = readers.load_transactions(spark, folder)
    assert df.count() > 60 and "id_31" in df.columns and df.where("DeviceInfo is null").count() > 0
    assert readers.load_transactions(spark, folder, rows=10).count() == 10
    assert readers.load_transactions(spark, folder, identity="absent").count() == df.count()
    saved = readers.save_checkpoint(df.select("TransactionID"), f"{folder}/c", "prepared")
    assert readers.has_checkpoint(spark, f"{folder}/c", "prepared") and saved.count() == df.count()
    assert not readers.has_checkpoint(spark, f"{folder}/c", "other")


def test_report_comes_from_tables(spark, tmp_path):
    t = spark.createDataFrame([("rung0", 0.5), ("rung<1", 0.25)], "rung string, auprc double")
    report.save_table(t, str(tmp_path), "T1", "ladder")
    back = report.load_table(spark, "T1", str(tmp_path / "none"), str(tmp_path))
    assert back.count() == 2 and report.load_table(spark, "T9", str(tmp_path)) is None
    page, summary = report.build({"T1": back, "T9": None})
    assert "NOT RUN" in page and "rung&lt;1" in page and summary["tables"]["T9"] is None
    names = report.bundle(str(tmp_path / "b.zip"), [("report.html", page.encode())])
    assert names == ["report.html"] and "MANIFEST.txt" in zipfile.ZipFile(tmp_path / "b.zip").namelist()
    clock = report.Clock()
    with clock.step("x"):
        pass
    assert clock.table(spark).count() == 1 and report.environment(spark)["spark"] == spark.version


def test_key_figures_and_pictures_come_from_tables(spark, tmp_path):
    t1 = spark.createDataFrame([("rung0", 0.8), ("rung0", 0.6), ("rung4", 0.35), ("rung4", None)], "rung string, auprc double")
    f3 = spark.createDataFrame([(0.0, 0.1), (7.0, 0.4)], "day_start double, js double")
    page, summary = report.build({"T1": t1, "F3": f3, "T5": None})
    keys = summary["key_figures"]
    assert abs(keys["auprc_drop"] - 0.35) < 1e-9 and abs(keys["share_of_performance_lost"] - 0.5) < 1e-9 and keys["largest_drift"] == 0.4
    assert page.count("<svg") == 2 and "Key figures" in page
    pictures = figures.drawn({"T1": t1, "T3": None, "T4": t1})
    assert set(pictures) == {"ladder"} and pictures["ladder"].count("<rect") == 2 and len(figures.FIGURES) == 9
    (tmp_path / "a.md").write_text("words")
    assert report.bundle(str(tmp_path / "c.zip"), [("report.html", page.encode())], str(tmp_path)) == ["report.html", "docs/a.md"]


def test_matrix_codes_text_and_drops_infinities(spark):
    rows = [(1, "b", True, 1.0), (2, None, None, float("inf")), (3, "a", False, None), (4, "b", True, -2.0)]
    df = spark.createDataFrame(rows, "row_id long, c string, f boolean, v double")
    assert sorted(map(tuple, S.matrix(df, "row_id", ["c", "f", "v"]).collect())) == [(1, 0.0, 1.0, 1.0), (2, -1.0, None, None), (3, 1.0, 0.0, None), (4, 0.0, 1.0, -2.0)]


def prepared(spark) -> X.Prepared:
    o = E.index_events(A.with_day(A.sparse_orders(spark, SMALL)))
    o = S.with_time_and_amount(o.drop("day")).select("row_id", "t", "day", "entity", "y", "amount", "is_index", "priority", "nation", "dow", "log_amt", "a", "c", "d").persist()
    return X.Prepared(o, ("priority",), ("dow", "log_amt"), ("a", "c", "d"), P.FoldPlan(300, 900, 0, True, 20, 20, 2), origin=788_918_400)


def test_experiment_tables(spark):
    p = prepared(spark)
    t3 = X.main_comparison(p, ["logreg"], seeds=[0], latency=0, at_most=1).toPandas()
    assert len(t3) == 1 and t3["auprc"].between(0, 1).all(), t3
    random_split = X.ladder(p, "logreg", seeds=[0], rungs=[LADDER[0]], at_most=1).toPandas()
    assert set(random_split["rung"]) == {"rung0"} and random_split["auprc"].notna().all(), random_split


def test_experiments_resample_calibrate_and_ablate(spark):
    p = prepared(spark)
    p.rounds = 2
    # Few enough positives that some are made up.
    p.rows = p.rows.withColumn("y", F.when(F.col("row_id") % 6 == 0, F.col("y")).otherwise(F.lit(0).cast(p.rows.schema["y"].dataType))).persist()
    t1 = X.ladder(p, "logreg", seeds=[0], rungs=LADDER[:2], at_most=1).toPandas().set_index("rung")
    assert t1.loc["rung0", "n_synthetic"] > 0 == t1.loc["rung1", "n_synthetic"] and t1.loc["rung0", "auprc"] != t1.loc["rung1", "auprc"], t1
    f = next(X.folds(p, 0, True, 1))
    train, test, names = X.features(p, f, 0)
    out = X.scored(*X.with_regimes(p, f, train, test), names, "monotone", 0, 2)
    assert out.count() == test.count() and out.where("calibrated between 0 and 1 and calibrated <> score").count() > 0
    assert "auprc" in X.run_fold(p, f, "monotone", 0, 0, enforce=False) and "auprc" in X.run_fold(p, f, "logreg", 0, 0, tuning=1)
    assert set(X.ABLATIONS) == {"full", "no_riskB", "no_regimesC", "no_entity_memory", "no_monotoneD", "behaviour_only"}


def test_explanations(spark):
    p = prepared(spark)
    p.rounds = 2
    f1 = X.attribution_migration(p)
    assert f1.count() >= 2 and abs(sum(r.leaky for r in f1.collect()) - 1) < 1e-6
    t6 = X.faithfulness(p, latency=0).first()
    assert t6.worst_drop <= 1e-9 and t6.n_alerts >= 1


def test_entity_recipes_and_their_table(spark):
    txn, _, truth = synthetic.generate(spark, entities=80, seed=3)
    df = txn.join(truth.select("TransactionID", "true_entity", "within"), "TransactionID").withColumnRenamed("TransactionID", "row_id")
    df = df.withColumns({"t": F.col("TransactionDT"), "y": F.col("isFraud"), "D1n": S.first_day_key(F.col("TransactionDT"), F.col("D1")), "D15n": S.rounded_first_day_key(F.col("TransactionDT"), F.col("D15"))})
    found, rejects = X.entity_variants(df, {"card2": 1.0, "addr1": 1.0, "P_emaildomain": 0.5})
    table = X.entity_table(found, ["C1", "C2"], rejects).toPandas().set_index("uid_variant")
    assert set(table.index) == {"loose", "medium", "strict"} and (table["pair_f1"] > 0.5).all()
    assert table.loc["strict", "n_entities"] >= table.loc["medium", "n_entities"] and table["c_violation_rate"].between(0, 1).all() and (table["score_rejects"] >= 0).all()


def test_stages_of_the_command_line(spark, tmp_path, monkeypatch):
    from auditspark import __main__ as cli

    assert cli.main(["stages"]) == 0
    out = str(tmp_path / "tables")
    assert cli.main(["stage", "T2", "F3", "--entities", "150", "--model", "logreg", "--folds", "1", "--out", out]) == 0
    assert report.load_table(spark, "T2", out).count() == 3 and report.load_table(spark, "F3", out).count() > 3


def test_paysim_ladder(spark):
    base = [r for r in oracle.PAYSIM_ROWS]
    rows = [(k, k // 5, "T", r[1] + k % 7, *r[2:6], r[6], r[7]) for k, r in enumerate(base * 20)]
    df = spark.createDataFrame(rows, "row_id long, step int, type string, amount double, oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int")
    table, evidence = X.paysim_ladder(df, "logreg", seeds=[0])
    assert table.count() == 4 and evidence.count() == 2
