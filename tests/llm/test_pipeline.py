"""The pipeline's stages, one by one and together."""

from __future__ import annotations

import corpus_pipeline as C
from support import SMALL


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        now = docs.count()
        assert docs.columns == columns, name
        assert now < before if name in ("quality", "near_duplicates") else now == before, name
        before = now
    last = C.STAGES[-1][1](spark, docs, SMALL).persist()
    out = C.run(spark, SMALL)
    assert sorted(map(tuple, out.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, last.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert last.select("doc_id").distinct().count() == before


def test_stages_keep_clashing_columns_and_odd_rows(spark, docs, empty):
    from pyspark.sql import functions as F

    names = ("items", "spans", "n_entities", "score", "n_words", "kept", "component_id", "k1", "templates", "id", "n")
    odd = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, odd, SMALL)
        assert out.columns == odd.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names), name
        assert stage(spark, empty, SMALL).count() == 0, name
    assert C.STAGES[-1][1](spark, odd, SMALL).select("doc_id").distinct().count() == docs.count()


def test_stages_of_repeated_rows_and_null_ids(spark):
    """Rows repeated as they are stay one after near duplicates; rows without an id are never near anything."""
    text = "\n".join("The quiet river runs past the old mill and the long road to town number %d." % k for k in range(9))
    other = "\n".join("A small garden behind the house holds %d apple trees and a wooden bench." % k for k in range(9))
    rows = [(1, text, "en", "s", 1)] * 5 + [(2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, text, None, None, None), (3, other + "\nMr. Paul Stone, mail paul@mail.example.com", "en", "s", 1), (4, None, None, None, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by_name = dict(C.STAGES)
    kept = sorted(r.doc_id or -1 for r in by_name["near_duplicates"](spark, given, SMALL).collect())
    assert kept == [-1, -1, 1, 3, 4]
    for name in ("decontamination", "surrogates"):
        out = by_name[name](spark, given, SMALL).collect()
        assert len(out) == len(rows) and sum(r.doc_id == 1 for r in out) == 5 and len({r.text for r in out if r.doc_id == 1}) == 1, name
    assert "paul@mail" not in next(r.text for r in out if r.doc_id == 3) and "Stone" not in next(r.text for r in out if r.doc_id == 3)
    good = by_name["quality"](spark, given, SMALL).collect()
    assert sum(r.doc_id == 1 for r in good) in (0, 5) and not any(r.doc_id == 4 for r in good)
    packed = by_name["packing"](spark, given, SMALL).collect()
    assert sum(r.doc_id == 1 for r in packed) == 5 * sum(r.doc_id == 2 for r in packed)
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False)) and places[0][1] == 0


def test_session_without_a_shared_folder_is_refused_on_a_cluster():
    import pytest

    from auditspark.llm import storage
    from auditspark.sources import shared

    class Cluster:
        master = "spark://head:7077"
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = property(lambda self: self)  # noqa: N815
        _jsc = type("J", (), {"sc": lambda self: self, "getCheckpointDir": lambda self: self, "isDefined": lambda self: False})()
        getConf = lambda self: self.conf  # noqa: E731, N815

    for folder in (storage.shared_folder, shared.folder):
        with pytest.raises(RuntimeError, match="checkpoint"):
            folder(Cluster())
