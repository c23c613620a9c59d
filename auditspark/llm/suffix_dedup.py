"""Removal of byte strings that occur elsewhere, with shard suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes.
Strings are judged on the input; overlaps count.

A window of ``LENGTH`` bytes is filed under an anchor, its leftmost ``GRAM``-byte
string of least hash, so equal windows have equal anchors. The windows of one anchor
occurrence are neighbours; their bytes are one segment. Anchors met once in the corpus
cannot hold repeats. Of equal segments two occurrences are enough to show that their
windows repeat, so the rest is folded away, and what is left is dealt by anchor over
shards of a few megabytes. Each shard's suffix array is made by induced sorting, and
its permuted common prefixes alone say which windows occur twice; what they say of a
segment holds for all its occurrences.

Scale: no document is compared with another; the shuffles carry a row per anchor
(about one in 185 bytes), then two segments at most of each kind under repeated
anchors. An anchor with more than ``HOT`` different segments would fill a task: its
segments are filed anew under anchor and surrounding bytes, in blocks of ``BLOCK``
windows and at last window by window, where equal rows fold before they are shuffled.

Edge cases: null texts are empty; shorter texts than ``LENGTH`` lose nothing; repeated
rows count as occurrences of each other; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .induced import permuted_lcp, suffix_array
from .storage import Scratch, with_columns_free

LENGTH = 400
GRAM = 32
HOT = 4096
BLOCK = 32
#: Bytes of segments in one suffix array, on average, and in one task.
SHARD_BYTES = 1 << 20
TASK_BYTES = 4 << 20

#: One row per occurrence of a segment: the anchor's key, the segment's fingerprint, the
#: document's key, the first and last window start, the last of a single period, how
#: often it repeats there, and where the anchor is.
_OCCURRENCE = "h long, fp long, k1 long, k2 long, lo int, hi int, unit int, n long, a int"
#: Of a part of a segment, the segment it is a part of and where that starts.
_PART = _OCCURRENCE + ", h0 long, fp0 long, base int"


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that ``same`` (is i like i - 1?) makes."""
    first = np.flatnonzero(~same)
    return first, np.append(first[1:], len(same)) - 1


def _folded(h, fp, doc, lo, hi, n, a) -> tuple[np.ndarray, ...]:
    """Neighbouring occurrences of one segment in a document as one row."""
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (fp[1:] == fp[:-1]) & (doc[1:] == doc[:-1]) & (lo[1:] == hi[:-1] + 1)
    first, last = _runs(same)
    total = np.concatenate(([0], np.cumsum(n)))
    return h[first], fp[first], doc[first], lo[first], hi[last], hi[first], total[last + 1] - total[first], a[first]


def chunk_anchors(c: B.Chunk, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of a chunk (h, fp, document, lo, hi, unit, n, a); lo, hi, unit and a are offsets in the document."""
    size = len(c.data)
    starts = size - length + 1
    none = tuple(np.empty(0, np.int64) for _ in range(8))
    if starts <= 0:
        return none
    at = np.arange(size - gram + 1)
    grams = B.mix(c.hash.raw(at, at + gram))
    key = (grams & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    width = length - gram + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(c.n), np.maximum(0, c.end - c.start - length + 1))
    if not len(doc):
        return none
    many = np.bincount(doc, minlength=c.n)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + c.start[doc]
    anchor = anchor[s]
    same = np.zeros(len(s), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1])
    first, last = _runs(same)
    lo, hi, a, doc = s[first], s[last], anchor[first], doc[first]
    fp = c.hash.of(lo, hi + length)
    base = c.start[doc]
    return _folded(grams[a] ^ (grams[a] << np.uint64(7)), fp, doc, lo - base, hi - base, np.ones(len(a), np.int64), a - base)


def _row(columns: tuple, keys: list) -> pa.RecordBatch:
    h, fp, doc, lo, hi, unit, n, a, *part = columns
    ints = [pa.array(x.astype(np.int32)) for x in (lo, hi, unit)]
    longs = [pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else x) for x in (h, fp)]
    rest = [pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.int32()), strict=False)]
    schema = _PART if part else _OCCURRENCE
    return pa.RecordBatch.from_arrays([*longs, *(pa.array(k[doc]) for k in keys), *ints, pa.array(n.astype(np.int64)), pa.array(a.astype(np.int32)), *rest], names=[x.split()[0] for x in schema.split(", ")])


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in B.small_batches(batches):
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for c in B.chunks(B.as_bytes(batch.column(2)), size=B.CHUNK_BYTES):
                got = chunk_anchors(c, length, gram)
                if len(got[0]):
                    yield _row(got, [k[c.first : c.first + c.n] for k in keys])

    return texts.mapInArrow(run, _OCCURRENCE)


def _narrower(located: DataFrame, length: int, block: int) -> DataFrame:
    """Segments of hot anchors filed anew, ``block`` windows at a time, under anchor, place in the window and shared bytes."""

    def run(batches):
        for batch in B.small_batches(batches):
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for i, (text, at) in enumerate(zip(B.as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                data = B.ByteHash(np.frombuffer(text, np.uint8))
                out = []
                for x in at:
                    # Windows at the same distance before the anchor share a block.
                    s = np.arange(x["lo"], x["to"] + 1)
                    period = x["unit"] - x["lo"] + 1
                    a = x["a"] + (s - x["lo"]) // period * period
                    part = (a - s) // block
                    same = np.zeros(len(s), bool)
                    same[1:] = (part[1:] == part[:-1]) & (a[1:] == a[:-1])
                    first, last = _runs(same)
                    lo, hi, part, a = s[first], s[last], part[first], a[first]
                    # The bytes that all windows of a whole block share; blocks are shorter than windows.
                    core = data.of(a - part * block, a - (part + 1) * block + 1 + length)
                    key = B.mix(core ^ B.mix(part.astype(np.uint64) + np.uint64(x["h"] & 0xFFFFFFFFFFFFFFFF)))
                    of = [np.full(len(lo), x[k]) for k in ("h", "fp", "lo")]
                    out.append((key, data.of(lo, hi + length), np.full(len(lo), i), lo, hi, hi, np.ones(len(lo), np.int64), a, *of))
                if out:
                    yield _row(tuple(np.concatenate(z) for z in zip(*out, strict=True)), [k1, k2])

    return located.mapInArrow(run, _PART)


def _segments(located: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in B.small_batches(batches):
            rows = [(x["h"], x["fp"], x["copy"], text[x["lo"] : x["to"] + length]) for text, at in zip(B.as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True) for x in at]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["h", "fp", "copy", "bytes"])

    return located.mapInArrow(run, "h long, fp long, copy int, bytes binary")


def repeated_windows(parts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, first, last) of the window starts whose bytes occur again in these segments."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    start = end - size
    many = np.maximum(0, size - length + 1)
    segment = np.repeat(np.arange(len(parts)), many)
    at = np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many) + start[segment]
    ends = np.repeat(end, size + 1)[: len(data)]
    phi, common = permuted_lcp(data, suffix_array(data, end[:-1]), ends, at, length, length)
    twice = np.zeros(len(data), bool)
    big = common >= length
    twice[at[big]] = True
    twice[phi[big]] = True
    hit = twice[at]
    at, segment = at[hit], segment[hit]
    same = np.zeros(len(at), bool)
    same[1:] = (at[1:] == at[:-1] + 1) & (segment[1:] == segment[:-1])
    first, last = _runs(same) if len(at) else (at, at)
    return list(zip(segment[first].tolist(), (at[first] - start[segment[first]]).tolist(), (at[last] - start[segment[last]]).tolist(), strict=True))


def _by_suffix_array(segments: DataFrame, length: int) -> DataFrame:
    """(h, fp, p, q): first and last repeated window of segments, from their start; a task holds whole anchors, in order."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def solve():
            rows = {(held[i][0], held[i][1], p, q) for i, p, q in repeated_windows([x[3] for x in held], length)}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "fp", "p", "q"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] == held[-1][:3]:
                    # The text of a repeated row was met twice; this is the same occurrence.
                    continue
                if held and size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield solve()

    return segments.mapInArrow(run, "h long, fp long, p int, q int")


def _everywhere(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Every row, once for each range [s, e] of window starts that ``repeats`` (h, fp, p, q) has of its segment."""
    by_segment = repeats.groupBy("h", "fp").agg(F.collect_set(F.struct("p", "q")).alias("ranges"))
    period = F.col("unit") - F.col("lo") + 1

    def of(x):
        # A repetition's windows are those of its period over and over.
        once = F.array(F.struct((F.col("lo") + x["p"]).alias("s"), F.least(F.col("lo") + x["q"], F.col("hi")).alias("e")))
        whole = F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("e")))
        each = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda k: F.struct((F.col("lo") + x["p"] + k * period).alias("s"), F.least(F.col("lo") + x["q"] + k * period, F.col("hi")).alias("e")))
        return F.when(F.col("n") == 1, once).when(x["q"] - x["p"] + 1 >= period, whole).otherwise(each)

    met = rows.join(by_segment, ["h", "fp"])
    ranges = F.filter(F.flatten(F.transform("ranges", of)), lambda x: x["s"] <= x["e"])
    return met.withColumn("x", F.explode(ranges)).withColumns({"s": F.col("x.s"), "e": F.col("x.e")}).drop("x", "ranges")


def repeated_ranges(spark: SparkSession, texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, lo, hi): ranges of starts of repeated windows in the documents of (k1, k2, text)."""
    long_enough = texts.where(F.octet_length("text") >= length)
    levels = [scratch.save(_anchors(long_enough, length, gram))]
    repeats = None

    def located(of: DataFrame) -> DataFrame:
        copies = F.when(F.col("rows") > 1, F.array("x", "y")).otherwise(F.array("x"))
        of = of.select("h", "fp", F.posexplode(copies).alias("copy", "o")).select("h", "fp", "copy", "o.*")
        places = of.groupBy("k1", "k2").agg(F.collect_list(F.struct(*[c for c in of.columns if c not in ("k1", "k2")])).alias("at"))
        return long_enough.join(places, ["k1", "k2"]).select("k1", "k2", "text", "at")

    for block in (max(1, min(BLOCK, length // 4)), 1, 0):
        rows = levels[-1]
        # Two periods show that a repetition's windows repeat.
        to = F.least(F.col("hi"), 2 * F.col("unit") - F.col("lo") + 1)
        place = F.struct("k1", "k2", "lo", "unit", to.alias("to"), "a")
        folded = rows.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(place).alias("x"), F.max(place).alias("y"))
        folded = scratch.save(folded)
        met = folded.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where(F.col("all") > 1)
        folded = scratch.save(folded.join(met.drop("all"), "h").select("h", "fp", "rows", "kinds", "x", "y"))
        sorted_out = folded.where(F.col("kinds") <= hot)
        size = sorted_out.agg(F.sum((F.col("x.to") - F.col("x.lo") + length) * F.least("rows", F.lit(2)))).first()[0] or 0
        if size:
            tasks = max(1, -(-size // TASK_BYTES))
            dealt = _segments(located(sorted_out), length).repartition(tasks, "h").sortWithinPartitions("h", "fp", "copy")
            found = scratch.save(_by_suffix_array(dealt, length))
            for parts in levels[:0:-1]:
                # What holds for a part of a segment, as ranges of the whole.
                found = _everywhere(parts, found).select(F.col("h0").alias("h"), F.col("fp0").alias("fp"), (F.col("s") - F.col("base")).alias("p"), (F.col("e") - F.col("base")).alias("q"))
            repeats = found if repeats is None else repeats.union(found)
        over = folded.where(F.col("kinds") > hot)
        if not block or not over.limit(1).count():
            break
        levels.append(scratch.save(_narrower(located(over), length, block)))
    if repeats is None:
        return spark.createDataFrame([], "k1 long, k2 long, lo int, hi int")
    return _everywhere(levels[0], repeats).select("k1", "k2", F.col("s").alias("lo"), F.col("e").alias("hi"))


def _removed(docs: DataFrame, names: list[str], length: int) -> DataFrame:
    """Cuts the windows at ``_at`` out of ``_text``; both columns go, four are added."""

    def run(batches):
        for batch in B.small_batches(batches):
            texts, at = B.as_bytes(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_pylist()
            kept, removed, spans = [], [], []
            for text, ranges in zip(texts, at, strict=True):
                parts, done, count, cut = [], 0, 0, 0
                for r in sorted((x["lo"], x["hi"] + length) for x in ranges or ()):
                    if r[0] > done or not count:
                        parts.append(text[done : r[0]])
                        count += 1
                        cut += r[1] - r[0]
                    else:
                        cut += max(0, r[1] - done)
                    done = max(done, r[1])
                parts.append(text[done:])
                kept.append(b"".join(parts))
                removed.append(cut)
                spans.append(count)
            new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *new], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), "n_bytes long, n_removed long, n_spans long, kept_bytes binary"])
    return docs.mapInArrow(run, schema)


def deduplicated(spark: SparkSession, docs: DataFrame, keep: list[str], text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The columns ``keep`` of every row with n_bytes, n_removed, n_spans and kept_bytes (UTF-8, characters may be torn)."""
    scratch = Scratch(spark, "suffix")
    keep = [k for k in keep if k not in ("n_bytes", "n_removed", "n_spans", "kept_bytes")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Rows of the same id and text share a key: their ranges are the same.
    key = [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit("k2"), "doc_id").alias("k2")]
    texts = docs.select(*key, text.alias("text"))
    ranges = repeated_ranges(spark, texts, scratch, length, gram, hot)
    places = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("_at"))
    given = with_columns_free(docs, "_text", "_at", "k1", "k2").select(*keep, *key, text.alias("_text"))
    return _removed(given.join(places, ["k1", "k2"], "left").select(*keep, "_text", "_at"), keep, length)
