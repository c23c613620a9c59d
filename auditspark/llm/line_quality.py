"""Document quality from a conditional random field over lines.

Every line is labelled good or bad from its own statistics and those of its
neighbours; forward-backward marginals, weighted by line length, make the document's
score. The field is fitted on the driver to a bounded sample of ``PER_CLASS`` labelled
documents of each class, whose lines take their document's label; scoring covers every
document in one pass without a shuffle.

Edge cases: null or wordless texts have no line with a word and get ``EMPTY``; very
long texts are scored whole; repeated rows are scored row by row; an empty label table
gives a model that scores everything 0.5; only the text is used for scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .crf import Chain, fit
from .labelled import sample
from .quality_rules import repeated
from .storage import in_fold, with_columns_free

#: Labelled documents of each class that the field is fitted to, at most.
PER_CLASS = 3000
#: The score of a text without words: nothing of it is good.
EMPTY = 0.0
#: From this score on a document is called good.
GOOD = 0.3

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>{}=_~^@\\/"))
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.isin(np.arange(256), list(b"!?"))
OWN = 11


def line_features(c: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document, length) of every line that holds a word."""
    start, end, doc = c.words(B.NOT_SPACE)
    line_start, line_end, line_doc = c.lines()
    filled = np.concatenate(([0], np.cumsum(B.NOT_SPACE[c.data], dtype=np.int64)))
    keep = filled[line_end] > filled[line_start]
    line_start, line_end, line_doc = line_start[keep], line_end[keep], line_doc[keep]
    n = len(line_start)
    if not n:
        return np.empty((0, 3 * OWN)), line_doc, np.empty(0)
    line = np.searchsorted(line_end, start, "left")
    unit = c.hash.of(start, end)
    words = np.bincount(line, minlength=n).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[c.data], dtype=np.int64)))
        return (total[line_end] - total[line_start]) / (chars + 5)

    chars = (filled[line_end] - filled[line_start]).astype(float)
    per = words + 3
    same = np.concatenate(([False], (unit[1:] == unit[:-1]) & (line[1:] == line[:-1])))
    later_word = repeated(unit, line)[1]
    windows = B.window_hash(unit, 5)
    whole = np.flatnonzero(doc[: len(windows)] == doc[4:]) if len(windows) else np.empty(0, int)
    again = whole[repeated(windows[whole], doc[whole])[0]]
    covered = B.cover(again, again + 5, len(doc))
    own = np.stack([
        np.log1p(words) / 3,
        np.clip(chars / words / 6, 0, 5),
        np.log1p(100 * share(_SYMBOL)) / 2,
        np.sqrt(share(_UPPER)) * 2,
        np.log1p(100 * share(_MARK)) / 2,
        np.sqrt(share(_DIGIT)) * 2,
        np.log1p(20 * np.bincount(line[same], minlength=n) / per),
        np.bincount(line[later_word], minlength=n) / per * 2,
        np.log1p(10 * np.bincount(line[covered], minlength=n) / per),
        repeated(c.hash.of(line_start, line_end), line_doc)[1].astype(float),
        (words < 4).astype(float),
    ], 1)
    edge = np.concatenate(([True], line_doc[1:] != line_doc[:-1]))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~edge[1:]] = own[:-1][~edge[1:]]
    after[:-1][~edge[1:]] = own[1:][~edge[1:]]
    return np.concatenate((own, before, after), 1), line_doc, chars


@dataclass
class LineModel:
    weights: np.ndarray
    chain: Chain

    def score(self, c: B.Chunk) -> np.ndarray:
        x, doc, chars = line_features(c)
        start = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
        p = self.chain.marginals(x @ self.weights[:-1] + self.weights[-1], start)
        total = np.bincount(doc, weights=chars, minlength=c.n)
        good = np.bincount(doc, weights=chars * p, minlength=c.n)
        return np.where(total > 0, np.clip(good / np.maximum(total, 1), 0, 1), EMPTY)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineModel:
    def run(batches):
        for batch in B.small_batches(batches):
            ids, label, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), B.as_bytes(batch.column(2))
            for c in B.chunks(texts):
                x, doc, chars = line_features(c)
                yield pa.RecordBatch.from_arrays([pa.array(ids[c.first + doc]), pa.array(label[c.first + doc], pa.int32()), pa.array(chars.astype(np.float32)), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array(np.arange(len(doc), dtype=np.int32))], names=["doc_id", "label", "chars", "x", "line"])

    rows = sample(docs, labels, "quality", per_class).mapInArrow(run, "doc_id long, label int, chars float, x array<float>, line int").toPandas()
    rows = rows.sort_values(["doc_id", "line"], kind="stable")
    if not len(rows):
        return LineModel(np.zeros(3 * OWN + 1), Chain(np.zeros((2, 2)), 0.0))
    doc, y = rows["doc_id"].to_numpy(), rows["label"].to_numpy(float)
    x = np.column_stack((np.stack(rows["x"].to_numpy()), np.ones(len(rows)))).astype(float)
    start = np.concatenate(([True], doc[1:] != doc[:-1]))
    # Each document counts alike, and so does each class.
    number = np.cumsum(start) - 1
    weight = 1 / np.bincount(number)[number]
    for label in (0, 1):
        if (y == label).any():
            weight[y == label] /= weight[y == label].sum()
    w, chain = fit(lambda w: x @ w, lambda g: g @ x, x.shape[1], y, start, weight * len(rows))
    return LineModel(w, chain)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list[str], per_class: int = PER_CLASS, name: str = "score") -> DataFrame:
    """The columns ``keep`` with the score as ``name``."""
    sent = spark.sparkContext.broadcast(train(spark, docs, labels, per_class))
    keep = [k for k in keep if k.lower() != name.lower()]
    chosen = with_columns_free(docs, "_text").select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches):
        for batch in B.small_batches(batches):
            for c in B.chunks(B.as_bytes(batch.column(len(keep)))):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(c.first, c.n) for i in range(len(keep))), pa.array(sent.value.score(c))], names=[*keep, name])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), f"{name} double"])
    return chosen.mapInArrow(run, schema)


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    found = scored(spark, docs, labels, ["doc_id"])
    return found.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least ``GOOD``."""
    found = scored(spark, docs, labels, docs.columns, name="_line_score")
    return found.where(F.col("_line_score") >= GOOD).select(*docs.columns)
