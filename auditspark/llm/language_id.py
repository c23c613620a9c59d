"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ``ORDER`` deep, made from a bounded
sample of documents of known language. Its statistics are then frozen: a byte that was
met after the longest known context costs its share of that context's counts, and one
that was not costs an escape and goes on to the next shorter context, down to all 256
bytes alike (escape estimate C). A text's exact code length under each language is the
sum over all its bytes, and the shortest wins.

A tree is kept as sorted arrays of the strings it has met and of their contexts, with
their costs, so it is as large as its own sample makes it, however many languages there
are. A byte with its context is a number of four bytes; the different ones of a chunk
of texts are looked up once in each language's tree. Letters are lower-cased first.

Scale: the sample has ``PER_LANGUAGE`` documents and ``PER_LANGUAGE_BYTES`` bytes of each
language at most, a tree 8 bytes for each different string of its sample (in natural
text some 100,000 strings, so a megabyte a language); scoring is one pass over whole
texts without a shuffle and holds one language's costs at a time.

Edge cases: ``und`` and score 0 for null texts and texts without a letter; null
languages teach nothing; a language's longest texts (over an eighth of its bytes) are
taken last, and of a single text longer than all of them its first bytes; without
training documents everything is ``und``; rows that repeat an id teach once; repeated
rows and very long texts are scored whole, row by row, whatever stands beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .storage import in_fold

#: Documents of each language that the trees are made from, at most, and bytes of them.
PER_LANGUAGE, PER_LANGUAGE_BYTES = 400, 4 << 20
#: Bytes of the longest context; with the byte itself they make a 32-bit number.
ORDER = 3
#: Bytes of texts whose strings are looked up together.
LOOKED_UP = 1 << 20
#: Code lengths are compared per this many bytes at most when they become a score.
SCORE_BYTES = 200

_ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def _strings(data: np.ndarray) -> np.ndarray:
    """The four bytes that end at each place of ``data``, as numbers; ``ORDER`` line ends stand before it."""
    padded = np.concatenate((np.full(ORDER, 10, np.uint8), data)).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | padded[k : k + len(data)]
    return out


@dataclass
class Tree:
    """One language: by order, the sorted strings (context and byte) with their bits, and the contexts with those of an escape."""

    strings: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes]) -> Tree:
        gap = b"\n" * ORDER
        whole = _strings(np.frombuffer(gap.join(texts).translate(B.LOWER), np.uint8))
        tree = cls([], [], [], [])
        for k in range(ORDER + 1):
            strings, number = np.unique(whole & np.uint32((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, of, kinds = np.unique(strings >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(of, weights=number) + kinds
            tree.strings.append(strings)
            tree.bits.append((np.log2(total[of]) - np.log2(number)).astype(np.float32))
            tree.contexts.append(contexts)
            tree.escapes.append((np.log2(total) - np.log2(kinds)).astype(np.float32))
        return tree

    def cost(self, strings: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each of these strings of four bytes, after the three before it."""
        out = np.zeros(len(strings), np.float32)
        left = np.arange(len(strings))
        for k in range(ORDER, -1, -1):
            key = strings[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.strings[k], key), len(self.strings[k]) - 1)
            met = self.strings[k][at] == key
            out[left[met]] += self.bits[k][at[met]]
            left, key = left[~met], key[~met] >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[k], key), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == key
            out[left[known]] += self.escapes[k][at[known]]
        out[left] += 8
        return out


@dataclass
class Trees:
    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, c: B.Chunk) -> np.ndarray:
        """Bits of each document of a lower-cased chunk in each language."""
        whole = _strings(c.data)
        # What stands before a document in the chunk is none of its context.
        for k in range(ORDER):
            at = c.start[c.start + k <= c.end] + k
            keep = np.uint32((1 << 8 * (k + 1)) - 1)
            whole[at] = whole[at] & keep | np.uint32(0x0A0A0A0A) & ~keep
        different, place = np.unique(whole, return_inverse=True)
        out = np.empty((c.n, len(self.trees)))
        for i, tree in enumerate(self.trees):
            total = np.concatenate(([0.0], np.cumsum(tree.cost(different).astype(np.float64)[place])))
            out[:, i] = total[c.end] - total[c.start]
        return out


def build(samples: dict[str, list[bytes]]) -> Trees:
    languages = sorted(lang for lang, texts in samples.items() if any(texts))
    return Trees(languages, [Tree.of(samples[lang]) for lang in languages])


def _has_letter(c: B.Chunk, texts: list[bytes]) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(_ASCII_LETTER[c.data], dtype=np.int64)))
    out = total[c.end] > total[c.start]
    for i in np.flatnonzero(~out & (c.end > c.start)):
        out[i] = any(ch.isalpha() for ch in texts[c.first + i].decode())
    return out


def train(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Trees | None:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~in_fold(F.col("doc_id")))
    known = known.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("o"), F.octet_length("text").alias("size"))
    # Each task keeps the first of each language, so the window sees few rows.
    order = (F.col("size") > PER_LANGUAGE_BYTES // 8, F.col("o"), F.col("doc_id"))
    first = Window.partitionBy("lang", "part").orderBy(*order)
    ids = ids.withColumn("part", F.pmod("o", F.lit(256))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language)
    last = Window.partitionBy("lang").orderBy(*order)
    ids = ids.withColumn("r", F.row_number().over(last)).withColumn("bytes", F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    ids = ids.where((F.col("r") <= per_language) & ((F.col("bytes") <= PER_LANGUAGE_BYTES) | (F.col("r") == 1))).select("lang", "doc_id").distinct()
    some = known.withColumn("text", F.substring("text", 1, PER_LANGUAGE_BYTES)).join(F.broadcast(ids), ["doc_id", "lang"])
    rows = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        samples.setdefault(r.lang, []).append(r.text.encode())
    trees = build(samples)
    return trees if trees.languages else None


def predicted(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and code_lengths (bits in each language, by name) of every row."""
    sent = spark.sparkContext.broadcast(train(spark, docs, per_language))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        t = sent.value
        for batch in B.small_batches(batches):
            texts = B.as_bytes(batch.column(1))
            for c in B.chunks(texts, lower=True, size=LOOKED_UP):
                some = _has_letter(c, texts)
                if t is None:
                    some[:] = False
                    best, score, bits = np.zeros(c.n, int), np.zeros(c.n), np.zeros((c.n, 0))
                else:
                    bits = t.code_lengths(c)
                    best = bits.argmin(1)
                    size = (c.end - c.start)[:, None]
                    scaled = (bits - bits.min(1, keepdims=True)) * np.minimum(1, SCORE_BYTES / np.maximum(1, size))
                    score = 1 / np.exp2(-scaled).sum(1)
                names = [t.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                lengths = pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), bits.shape[1]).cast(pa.list_(pa.float64())) if bits.shape[1] else pa.array([[]] * c.n, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), lengths], names=["doc_id", "lang_pred", "score", "code_lengths"])

    out = chosen.mapInArrow(run, "doc_id long, lang_pred string, score double, code_lengths array<double>")
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "code_lengths")
