"""Benchmark decontamination with an FM-index per training shard.

A shard is some megabytes of whole documents. Its words become symbols of the test
phrases' vocabulary; a run of words that no phrase contains becomes one separator,
which no phrase can match across. Over that sequence the shard's FM-index is built:
suffix array, Burrows-Wheeler transform, a wavelet tree for rank, and suffix positions
sampled at every ``SAMPLE`` th symbol. All phrases are searched backwards at once;
rows are located by walking to a sample, and the occurrences' words are merged into
spans.

Scale: documents are never shuffled and are read once; memory is bounded by the shard.
The test items go out in blocks of about ``ITEM_BLOCK`` bytes of text, each a broadcast
of its own that a worker loads from its local file, searches ``HELD`` shards for, and
lets go, so that neither driver nor worker holds more than one block at a time.

Edge cases: null or wordless texts have no words, no hits, and stay; an item of fewer
words than a window is one window; an item without words has none; repeated items and
documents are treated row by row; extra columns pass through.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as B
from .storage import packed_row, unpacked_row, with_columns_free

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 2 << 20
ITEM_BLOCK = 4 << 20
#: Shards that wait for each block, where there are several blocks.
HELD = 4


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by prefix doubling; a shorter suffix sorts first."""
    n = len(ranks)
    if n == 0:
        return np.empty(0, np.int64)
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[:-step] += rank[step:]
        order = np.argsort(key)
        ordered = key[order]
        new = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        rank[order] = new
        step *= 2
        if new[-1] == n or step >= n:
            return order


class WaveletTree:
    """Rank and access over a sequence of symbols below ``sigma``, stored level by level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        at = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (at >> level) & 1
            ones = np.zeros(len(at) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(at) - int(ones[-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` positions."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low, high = np.where(up, zeros + l1, low - l1), np.where(up, zeros + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Over symbols 1..sigma-1; 0 separates, and no match crosses it."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        symbols = np.concatenate((symbols, [0])).astype(np.int64)
        n, apart = len(symbols), symbols == 0
        order = symbols + apart.sum()
        order[apart] = np.arange(apart.sum())
        self.n, sa = n, suffix_array(order)
        self.tree = WaveletTree(symbols[sa - 1], sigma)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        sampled = (sa % SAMPLE == 0) | (symbols[sa - 1] == 0)
        self.sampled = sampled
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = sa[sampled]

    def search(self, patterns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; row i of ``patterns`` holds size[i] symbols."""
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        alive = np.arange(len(size))
        for k in range(int(size.max(initial=0))):
            done = size[alive] <= k
            go = alive[~done]
            c = patterns[go, size[go] - 1 - k]
            low[go] = self.below[c] + self.tree.rank(c, low[go])
            high[go] = self.below[c] + self.tree.rank(c, high[go])
            alive = go[low[go] < high[go]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, at, steps, left = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            at, left = at[~hit], left[~hit]
            c = self.tree.access(at)
            at = self.below[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The windows of some test items, as symbol patterns, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        ids, texts = [i for i, _ in items], [t for _, t in items]
        words: list[np.ndarray] = [np.empty(0, np.uint64)] * len(items)
        for c in B.chunks(texts, lower=True):
            start, end, doc = c.words(B.ALNUM)
            unit = c.hash.of(start, end)
            edge = np.searchsorted(doc, np.arange(c.n + 1))
            for i in range(c.n):
                words[c.first + i] = unit[edge[i] : edge[i + 1]]
        self.vocabulary = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]))
        found: dict[bytes, set[int]] = {}
        for i, w in enumerate(words):
            s = (np.searchsorted(self.vocabulary, w) + 1).astype(np.int32)
            for k in range(max(1, len(s) - window + 1) if len(s) else 0):
                found.setdefault(s[k : k + window].tobytes(), set()).add(i)
        self.size = np.array([len(k) // 4 for k in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int32)
        for r, k in enumerate(found):
            self.patterns[r, : len(k) // 4] = np.frombuffer(k, np.int32)
        of = [sorted(v) for v in found.values()]
        self.item_edge = np.concatenate(([0], np.cumsum([len(v) for v in of]))).astype(np.int64)
        self.items = np.array([i for v in of for i in v], np.int64)
        self.ids = ids

    def symbols(self, unit: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(unit), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, unit), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == unit, at + 1, 0)


def shard_hits(phrases: Phrases, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word) of every occurrence, and distinct (document, item) pairs.

    ``symbols`` and ``doc`` are of all words of a shard, in order; 0 is a word of no phrase.
    """
    n = len(symbols)
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1])) if n else np.empty(0, bool)
    inside = symbols > 0
    keep = inside | new_doc | np.concatenate(([True], inside[:-1]))[:n]
    # A document that starts with a phrase word needs a separator before that word.
    at = np.flatnonzero(keep)
    extra = np.flatnonzero(new_doc & inside)
    place = np.concatenate((at, extra))
    sym = np.concatenate((symbols[at], np.zeros(len(extra), np.int64)))
    order = np.argsort(place * 2 + np.concatenate((np.ones(len(at), np.int64), np.zeros(len(extra), np.int64))))
    place, sym = place[order], sym[order]
    index = FMIndex(sym, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.patterns, phrases.size)
    hit = np.flatnonzero(high > low)
    many = (high - low)[hit]
    which = np.repeat(hit, many)
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)
    first = place[index.locate(rows)]
    pair = np.unique(doc[first] * len(phrases.size) + which) if len(first) else np.empty(0, np.int64)
    d, w = pair // max(1, len(phrases.size)), pair % max(1, len(phrases.size))
    n_items = phrases.item_edge[w + 1] - phrases.item_edge[w]
    item = phrases.items[np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items, n_items) + np.repeat(phrases.item_edge[w], n_items)]
    pairs = np.unique(np.repeat(d, n_items) * (len(phrases.ids) + 1) + item)
    return first, first + phrases.size[which], pairs // (len(phrases.ids) + 1), pairs % (len(phrases.ids) + 1)


_ADDED = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", T.ArrayType(T.LongType()))]


class _Shard:
    """The words of a batch's documents, and what the blocks searched so far have hit."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.batch, self.at = batch, at
        self.texts = B.as_bytes(batch.column(at))
        unit, doc, start, end = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c in B.chunks(self.texts, lower=True):
            first, last, of = c.words(B.ALNUM)
            unit.append(c.hash.of(first, last))
            doc.append(of + c.first)
            start.append(first - c.start[of])
            end.append(last - c.start[of])
        self.unit = np.concatenate([*unit, np.empty(0, np.uint64)])
        self.doc, self.start, self.end = (np.concatenate(x) for x in (doc, start, end))
        self.hit = np.zeros(len(self.doc), bool)
        self.items: list[set[str]] = [set() for _ in self.texts]

    def search(self, phrases: Phrases) -> None:
        first, last, doc, item = shard_hits(phrases, phrases.symbols(self.unit), self.doc)
        self.hit |= B.cover(first, last, len(self.doc))
        for i, k in zip(doc.tolist(), item.tolist(), strict=True):
            self.items[i].add(phrases.ids[k])

    def result(self, names: list[str], remove: bool) -> pa.RecordBatch:
        n = len(self.texts)
        edge = np.searchsorted(self.doc, np.arange(n + 1))
        spans: list[list[int]] = [[] for _ in range(n)]
        for i in np.unique(self.doc[self.hit]).tolist():
            a, b = edge[i], edge[i + 1]
            step = np.diff(self.hit[a:b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
            on, off = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
            spans[i] = np.stack((self.start[a:b][on], self.end[a:b][off]), 1).ravel().tolist()
        n_hit = np.bincount(self.doc[self.hit], minlength=n)
        new = [pa.array(np.diff(edge), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in self.items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
        columns = list(self.batch.columns)
        if remove and any(spans):
            given = columns[self.at].to_pylist()
            columns[self.at] = pa.array([_cut(t, s).decode() if s else g for t, s, g in zip(self.texts, spans, given, strict=True)], columns[self.at].type)
        return pa.RecordBatch.from_arrays([*columns, *new], names=names)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", window: int = WINDOW, remove: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids of the items found, sorted as strings) and spans.

    ``spans`` holds the byte offsets of the hit runs of words: start, end, start, end ...
    ``remove`` cuts them out of the text; the offsets are those of the text as given.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // ITEM_BLOCK))
    sent = []
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).collect()
        sent.append(spark.sparkContext.broadcast(Phrases([(r.i, r.t.encode()) for r in rows], window)))
    given = with_columns_free(docs, *(k for k, _ in _ADDED))
    schema = T.StructType([*given.schema.fields, *(T.StructField(k, t) for k, t in _ADDED)])
    names, at, held = schema.names, given.columns.index(text_col), 1 if n == 1 else HELD

    def run(batches):
        parts = B.small_batches(batches, SHARD_BYTES)
        while shards := [_Shard(batch, at) for batch in islice(parts, held)]:
            for block in sent:
                for shard in shards:
                    shard.search(block.value)
                if n > 1:
                    # A worker's copy is read again from its file when the next shards need it.
                    block.__dict__.pop("_value", None)
            for shard in shards:
                yield shard.result(names, remove)

    return given.mapInArrow(run, schema)


def _cut(text: bytes, spans: list[int]) -> bytes:
    kept, at = [], 0
    for a, b in zip(*[iter(spans)] * 2, strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join((*kept, text[at:]))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the words of test phrases; texts without any stay as they are."""
    found = contamination(spark, packed_row(docs), benchmark, window=window, remove=True)
    return unpacked_row(found, docs.columns)
