"""Best-fit decreasing packing of tokenised documents.

Only the histogram of piece lengths decides a best-fit decreasing packing, so it is
run over runs of equal lengths: open bins are kept by remaining capacity, a segment
tree over the capacities finds the tightest bin that still fits in logarithmic time,
and all bins of that capacity are filled at once. The outcome, a plan of at most some
hundred thousand runs whatever the corpus size, says for the r-th piece of a length
which bin and offset it gets. Ranks within a length are counted in parallel.

Scale: tokenising is one pass without a shuffle. The driver sees at most ``capacity``
counts. Proven bound of the plan: at most ``2 * capacity`` ranges of like bins exist,
and a range holds at most sqrt(2 * capacity) different lengths, so fewer than 750,000
runs of 40 bytes at 4096. Equal lengths are split by a salt before they are ranked, so
that no length goes to one task.

Edge cases: a null or empty text is the end token alone; longer documents are cut into
full pieces and a rest; repeated rows are packed as often as they come; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .storage import Scratch

CAPACITY = 4096
END_ID = 1
#: Rows of one (length, salt) that are ranked together, on average.
RANKED = 200_000
#: Words whose ids a worker remembers.
CACHE = 700_000
#: Words that it keeps between tasks.
KEPT = 400_000


_APART = np.isin(np.arange(256), (10, 32))
_MARK = np.isin(np.arange(256), list(b".,"))
_LETTER = np.array([97 <= b <= 122 for b in range(256)])


class FastEncoder:
    """Ids of whole texts, each distinct word encoded once.

    The tokenizer's pattern never crosses a space or a line end, so a text's ids are its
    words' ids in a row. It lower-cases, so doing that first for A-Z changes no id, and a
    lone full stop or comma after a letter is a run of its own. Words are found and hashed
    by chunk; new ones are encoded many at a time and told apart by the tokens that end a
    word, or one by one where those are not as many as expected. A text in which a special
    token may stand is encoded as it is.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache = CACHE
        self.runs = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def rest(self) -> None:
        """Between tasks a worker holds less than while it works."""
        if len(self.slot) > 0.8 * self.cache:
            self._forget()

    def _alone(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in coded for i in ids], np.uint32), [len(ids) for ids in coded]

    def _coded(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids of these words, none of them odd, in a row, and how many each has."""
        normal = self.tokenizer.normalizer.normalize_str
        shown = [w if w.isascii() else normal(w) for w in words]
        count = np.cumsum([1 if w.isalpha() else len(self.runs.findall(w)) for w in shown])
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != count[-1] or (last[-1] if len(last) else 0) != len(ids):
            return self._alone(words)
        to = np.concatenate(([0], last))[count]
        return ids, np.diff(to, prepend=0).tolist()

    @staticmethod
    def _odd(word: str) -> bool:
        """Words whose number of runs is not worth foreseeing: contractions, and characters that may combine or be of a newer standard."""
        return "'" in word or not word.isascii() and max(word) >= "\u0250"

    def _learn(self, keys: list[int], words: list[str]) -> None:
        odd = [self._odd(w) for w in words]
        parts = [[i for i in range(len(words)) if odd[i] == kind] for kind in (False, True)]
        for some in (p[at : at + 1024] for p in parts for at in range(0, len(p), 1024)):
            ids, size = (self._alone if odd[some[0]] else self._coded)([words[i] for i in some])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
            while len(self.slot) + len(some) > len(self.begin):
                self.begin, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.begin, self.size))
            n = len(self.slot)
            self.pool[self.used : self.used + len(ids)] = ids
            self.size[n : n + len(some)] = size
            self.begin[n : n + len(some)] = self.used + np.cumsum(size) - size
            self.slot.update(zip((keys[i] for i in some), range(n, n + len(some)), strict=True))
            self.used += len(ids)

    def _chunk(self, c: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and the edges of its documents' ids."""
        data = c.data
        inside = ~_APART[data]
        lone = np.zeros(len(data), bool)
        lone[1:-1] = _MARK[data[1:-1]] & _LETTER[data[:-2]] & ~inside[2:]
        cut = lone | ~inside
        start = np.flatnonzero(inside & (lone | np.concatenate(([True], ~inside[:-1]))))
        end = np.flatnonzero(inside & np.concatenate((cut[1:], [True]))) + 1
        h = c.hash.of(start, end)
        # As np.unique would, but any occurrence stands for a word, so the sort need not be stable.
        order = np.argsort(h)
        ordered = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        keys, first, place = ordered[fresh], order[fresh], np.empty(len(h), np.int64)
        place[order] = np.cumsum(fresh) - 1
        if len(self.slot) > self.cache:
            self._forget()
        known, keys = self.slot, keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            at = first[new]
            self._learn([keys[i] for i in new], [c.bytes[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        slot = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[place]
        size, begin = self.size[slot], self.begin[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        return ids, total[np.searchsorted(start, np.append(c.start, len(data)))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if b"<|" not in t]
        for c in B.chunks([texts[i] for i in plain], lower=True, size=4 * B.CHUNK_BYTES):
            ids, edge = self._chunk(c)
            raw, edge = ids.astype("<u4", copy=False).tobytes(), (4 * edge).tolist()
            for k in range(c.n):
                out[plain[c.first + k]] = raw[edge[k] : edge[k + 1]]
        for i in set(range(len(texts))).difference(plain):
            out[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, FastEncoder] = {}


def encoder(path: str) -> FastEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = FastEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if asked for) of every piece of every row."""
    end = np.array([END_ID], "<u4").tobytes()
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    step = 4 * capacity

    def run(batches):
        for batch in B.small_batches(batches, 4 << 20):
            ids = batch.column(0).to_pylist()
            known = encoder(tokenizer_path)
            known.cache = cache
            coded = known.encode(B.as_bytes(batch.column(1)))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, raw in zip(ids, coded, strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for column, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(v, t) for v, t in zip(out, kinds, strict=False)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in out[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        encoder(tokenizer_path).rest()
        B.trim()

    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class CapacityTree:
    """A segment tree over remaining capacities: which is the smallest of at least x that some bin has?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, filled: bool) -> None:
        at += self.size
        self.any[at] = filled
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest filled capacity >= least, or -1."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    A run (length, first rank, pieces per bin, first bin, offset) places pieces of ranks
    first, first + 1 ... in like bins, ``per bin`` in each, until the next run's rank.
    """
    tree, waiting, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, many = capacity, bins, -(-left // (capacity // length))
                bins += many
            else:
                first, many = waiting[room].popleft()
            each = room // length
            used = min(many, left // each)
            parts = [(first, used, each)] if used else []
            if used < many and left - used * each:
                parts.append((first + used, 1, left - used * each))
            for at, n, q in parts:
                runs.append((length, rank, q, at, capacity - room))
                rank, left = rank + n * q, left - n * q
                rest = room - q * length
                if rest:
                    waiting[rest].append((at, n))
                    tree.set(rest, True)
            taken = sum(n for _, n, _ in parts)
            if taken < many:
                waiting[room].appendleft((first + taken, many - taken))
            tree.set(room, bool(waiting[room]))
    return runs


def ranked(rows: DataFrame, many: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length, in no more than ``RANKED`` rows or so a task."""
    salts = max(1, -(-many // RANKED))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")


def packed(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """Every piece with its sequence_id and offset. ``cache``: words that a worker remembers, for speed only."""
    scratch = Scratch(spark, "packing")
    rows = scratch.save(pieces(docs, tokenizer_path, capacity, cache=cache))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    # One key for (length, rank): pieces of a length are fewer than 2**48.
    sent = spark.sparkContext.broadcast((runs[order], (runs[order, 0] << 48) + runs[order, 1]))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        runs, key = sent.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = runs[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            past = rank - at[:, 1]
            new = {"sequence_id": pa.array(at[:, 3] + past // at[:, 2]), "offset": pa.array(at[:, 4] + past % at[:, 2] * length)}
            yield pa.RecordBatch.from_arrays([new[k] if k in new else b.column(b.schema.get_field_index(k)) for k in names], names=names)

    return ranked(rows, sum(counts.values())).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
