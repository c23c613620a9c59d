"""Toxic spans from a conditional random field over words, and document scores.

Labels are given by document, so the words' labels are latent: at least one word of a
toxic document is toxic, none of another is, up to a share ``NOISE`` of wrong labels.
The field's features are the identity of the word, of its stems of some bytes and of
its neighbours, where they occur in ``KNOWN`` labelled documents or more, and how much
more frequent all of these are in toxic documents: Spark counts in how many toxic and
other documents each word and stem occurs, over all labelled training documents, into
a table of fixed size by hash; for the documents that the field is fitted to, their own
counts are taken out of it first. For every document, forward-backward marginals are
summed, their sum and maximum are calibrated to a score, and the words at 0.5 or more
are the offending offsets.

Scale: counts are summed before they are shuffled and end as one table of ``2 ** BITS``
numbers a feature, whatever the corpus; the field itself is fitted to the words of
``PER_CLASS`` documents of each class at most; scoring is one pass over all whole texts
without a shuffle.

Edge cases: null and wordless texts have no toxic words and get the score of none; very
long texts are scored whole; repeated rows are scored row by row; without labels, or
with those of one class, every score is 0.5; only the text is used for scores; no other
column of the documents is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .crf import Chain, fit_latent, logistic
from .labelled import sample
from .storage import in_fold, sent_if_small

#: Labelled documents of each class that the field is fitted to, at most.
PER_CLASS = 600
#: Share of wrong document labels that the field allows for.
NOISE = 0.02
#: Labelled documents with a word or stem, for it to have a weight of its own.
KNOWN = 5
#: Penalty of the weights, and the size of neighbours' features against the word's own.
L2, NEIGHBOURS = 3e-3, 0.5
#: Documents that pull a rare word's odds towards even.
PRIOR = 2.0
#: Bytes of the stems; the whole word is a feature too.
STEMS = (4, 5, 6)
BITS = 18
FEATURES = len(STEMS) + 1
#: Of the odds, so that their weights are of the size of the others'.
SCALE = 0.3


#: The features that stand for "no stem of this size".
_DEAD = [k << BITS for k in range(1, FEATURES)]


def word_features(c: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, start, end, document) of every word of a lower-cased chunk."""
    start, end, doc = c.words(B.ALNUM)
    out = np.empty((len(start), FEATURES), np.int32)
    for k, size in enumerate((None, *STEMS)):
        to = end if size is None else np.minimum(end, start + size)
        # A word no longer than the stem has none of its own; it shares one dead feature.
        h = (c.hash.of(start, to) >> np.uint64(64 - BITS)).astype(np.int32)
        out[:, k] = (h if size is None else np.where(end - start > size, h, 0)) + (k << BITS)
    return out, start, end, doc


def document_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents of label 0 and 1, documents of each with each feature) over all labelled documents that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull()).where(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.where("label in (0, 1)")
    known = sent_if_small(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id").select("label", "text")
    size = FEATURES << BITS

    def run(batches):
        total = np.zeros((2, size + 1), np.int64)
        for batch in B.small_batches(batches):
            label = batch.column(0).to_numpy()
            for c in B.chunks(B.as_bytes(batch.column(1)), lower=True):
                f, _, _, doc = word_features(c)
                own = label[c.first : c.first + c.n]
                total[:, size] += np.bincount(own, minlength=2)
                for k in range(FEATURES):
                    pair = np.unique((doc << BITS) | (f[:, k] - (k << BITS)))
                    at, feature = pair >> BITS, (pair & ((1 << BITS) - 1)) + (k << BITS)
                    for y in (0, 1):
                        total[y] += np.bincount(feature[own[at] == y], minlength=size + 1)
        for y in (0, 1):
            met = np.flatnonzero(total[y])
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), y, np.int32)), pa.array(met.astype(np.int32)), pa.array(total[y][met])], names=["label", "feature", "n"])

    rows = texts.mapInArrow(run, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((2, size + 1), np.int64)
    total[rows.column("label").to_numpy(), rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
    return total[:, size], total[:, :size]


def log_odds(documents: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of every feature, its log odds of being in a toxic document, scaled."""
    share = documents / max(1, documents.sum())
    rate = [(counts[y] + PRIOR * share[y]) / max(1, documents[y]) for y in (0, 1)]
    odds = np.log(np.maximum(rate[1], 1e-12) / np.maximum(rate[0], 1e-12)) if documents.min() > 0 else np.zeros(counts.shape[1])
    odds[_DEAD] = 0
    return (SCALE * odds).astype(np.float32)


def _neighbours(own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the word before and the word after have, zero at a document's edges."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(~start)
    before[inner] = own[inner - 1]
    after[inner - 1] = own[inner]
    return before, after


@dataclass
class ToxicModel:
    """``gains``: what a feature adds to the gain of its word, of the next word and of the word before."""

    gains: np.ndarray
    bias: float
    chain: Chain
    calibration: np.ndarray

    def marginals(self, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(doc):
            return np.empty(0)
        start = np.concatenate(([True], doc[1:] != doc[:-1]))
        own, before, after = (g[f].sum(1) for g in self.gains)
        return self.chain.marginals((own + _neighbours(before, start)[0] + _neighbours(after, start)[1]).astype(float) + self.bias, start)

    def summary(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        total, most = np.bincount(doc, weights=p, minlength=n), np.zeros(n)
        np.maximum.at(most, doc, p)
        return np.stack((np.log1p(total), most), 1)

    def score(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        x = self.summary(p, doc, n)
        return 1 / (1 + np.exp(-(x @ self.calibration[:-1] + self.calibration[-1])))


def fitted(documents: np.ndarray, counts: np.ndarray, f: np.ndarray, number: np.ndarray, toxic: np.ndarray) -> ToxicModel:
    """The model of these counts, its field fitted to words with features f, in documents ``number`` of label ``toxic``."""
    start = np.concatenate(([True], number[1:] != number[:-1]))
    without = [log_odds(documents - np.eye(2, dtype=np.int64)[y], np.maximum(0, counts - np.eye(2, dtype=np.int64)[y][:, None])) for y in (0, 1)]
    own = np.where((toxic[number] == 1)[:, None], without[1][f], without[0][f])
    dense = np.concatenate((own, *_neighbours(own, start)), 1)
    known = counts.sum(0) >= KNOWN
    known[_DEAD] = False
    place = np.cumsum(known) * known
    m = int(known.sum()) + 1
    word = place[f[:, :1]]
    before, after = _neighbours(word, start)
    index = np.concatenate((place[f], m + before, 2 * m + after), 1).astype(np.int32)
    none, width = [0, m, 2 * m], dense.shape[1]

    # What the word itself says goes before what its neighbours say: either would explain a document's label.
    size = np.concatenate((np.ones(m), np.full(2 * m, NEIGHBOURS), np.ones(FEATURES), np.full(width - FEATURES, NEIGHBOURS), [1.0]))
    penalty = np.concatenate((np.full(3 * m, L2), np.full(width + 1, 0.01 * L2)))

    def gain_of(w: np.ndarray) -> np.ndarray:
        w = w * size
        return w[index].sum(1) + dense @ w[3 * m : -1] + w[-1]

    def push(g: np.ndarray) -> np.ndarray:
        out = np.bincount(index.ravel(), weights=np.repeat(g, index.shape[1]), minlength=3 * m)
        out[none] = 0
        return np.concatenate((out, g @ dense, [g.sum()])) * size

    w, chain = fit_latent(gain_of, push, 3 * m + width + 1, toxic == 1, start, number, NOISE, rounds=60, l2=penalty)
    w = w * size
    odds, each = log_odds(documents, counts), np.repeat(np.arange(FEATURES), 1 << BITS)
    gains = np.stack([odds * w[3 * m + k * FEATURES : 3 * m + (k + 1) * FEATURES][each] for k in range(3)]).astype(np.float32)
    gains[0] += w[place]
    gains[1:, : 1 << BITS] += np.stack((w[m + place[: 1 << BITS]], w[2 * m + place[: 1 << BITS]])).astype(np.float32)
    model = ToxicModel(gains, float(w[-1]), chain, np.zeros(3))
    # Calibrated on gains that know no more of a document than those of one not seen.
    p = chain.marginals(gain_of(w / size), start)
    seen = model.summary(p, number, len(toxic))
    balance = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum())) * len(toxic)
    model.calibration = logistic(seen, toxic.astype(float), balance)
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicModel:
    def run(batches):
        for batch in B.small_batches(batches):
            ids, label, texts = batch.column(0), batch.column(1), B.as_bytes(batch.column(2))
            for c in B.chunks(texts, lower=True):
                f, _, _, doc = word_features(c)
                size = np.bincount(doc, minlength=c.n) * FEATURES
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), label.slice(c.first, c.n), flat], names=["doc_id", "label", "f"])

    documents, counts = document_counts(docs, labels)
    table = sample(docs, labels, "toxic", per_class).mapInArrow(run, "doc_id long, label int, f array<int>").toArrow().sort_by("doc_id")
    toxic = table.column("label").to_numpy().astype(np.int64)
    lists = table.column("f").combine_chunks()
    if not len(toxic) or not documents.min() or not len(lists.flatten()):
        return ToxicModel(np.zeros((3, FEATURES << BITS), np.float32), 0.0, Chain(np.zeros((2, 2)), 0.0), np.zeros(3))
    size = np.diff(lists.offsets.to_numpy()) // FEATURES
    return fitted(documents, counts, lists.flatten().to_numpy().reshape(-1, FEATURES), np.repeat(np.arange(len(toxic)), size), toxic)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (byte offsets start, end, ... of toxic words) of every row."""
    sent = spark.sparkContext.broadcast(train(spark, docs, labels, per_class))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in B.small_batches(batches):
            for c in B.chunks(B.as_bytes(batch.column(1)), lower=True):
                f, start, end, doc = word_features(c)
                p = sent.value.marginals(f, doc)
                hit = np.flatnonzero(p >= 0.5)
                at = np.stack((start[hit] - c.start[doc[hit]], end[hit] - c.start[doc[hit]]), 1).ravel()
                size = 2 * np.bincount(doc[hit], minlength=c.n)
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(sent.value.score(p, doc, c.n)), spans], names=["doc_id", "score", "spans"])

    out = chosen.mapInArrow(run, "doc_id long, score double, spans array<long>")
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
