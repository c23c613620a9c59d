"""Near-duplicate components by min-max hashing.

Every permutation of the shingle hashes is evaluated once and gives two signature
values, its minimum and its maximum, so ``bands * rows`` values take half as many
evaluations. Bands of ``rows`` values propose candidates; every link is confirmed on
the full shingle sets.

Scale: documents with the same shingle set are folded into one node before anything
is compared. Within a band bucket, members are held against one pivot at a time (a
star, linear in the bucket), the pivot leaves the bucket, components are contracted,
and only buckets that still hold several components go on. After ``pivot_rounds`` the
pivots of a round double, up to ``PIVOTS``, so a round never makes more than so many
pairs for each bucket row. Once the pairs left are at most ``PAIRS_A_ROW`` for each row,
they are met in one join, so no link is lost to a limit; a bucket of more than ``SALTED``
rows is dealt over as many tasks as it takes. That join drops, before it makes a row,
each pair whose parity sketches differ in more bits than the sets may differ in members;
a member of one set alone flips one bit, so no link can be dropped. Hubs are joined
through shuffles whose skewed partitions Spark splits.

Edge cases: a null or wordless text has an empty set and is linked with nothing; a
text of fewer words than a shingle has one shingle, the whole sequence; a null id is
never linked and its component is null; rows sharing an id count as one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .storage import Scratch, sent_if_small

#: Longs of a parity sketch.
SKETCH = 16
#: Pairs for each bucket row up to which those left are met at once.
PAIRS_A_ROW = 256
#: Pivots of a bucket in one round at most, and rows of a bucket that meet in one task of the last join.
PIVOTS, SALTED = 256, 1024

_FEATURES = "id long, n long, fp1 long, fp2 long, bands array<long>"
_SETS = "id long, fp1 long, fp2 long, shingles array<long>, sketch array<long>"


@dataclass(frozen=True)
class MinMaxHash:
    """Production parameters. ``percent``: least similarity, in hundredths.

    ``miss``: the chance that banding misses a pair just at the threshold; the number
    of bands follows from it. ``pivot_rounds``: rounds of one pivot a bucket, before they double.
    """

    words: int = 5
    percent: int = 80
    rows: int = 4
    miss: float = 1e-5
    pivot_rounds: int = 8

    @property
    def bands(self) -> int:
        hit = (self.percent / 100) ** self.rows
        return math.ceil(math.log(self.miss) / math.log(1 - hit))

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.bands * self.rows // 2
        draw = np.random.default_rng(7).integers(0, 1 << 63, (2, n), dtype=np.uint64)
        return draw[0] | np.uint64(1), draw[1]


def shingle_hashes(chunk: B.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle, repeats included, in document order."""
    start, end, doc = chunk.words(B.NOT_SPACE)
    unit = chunk.hash.of(start, end)
    h = B.window_hash(unit, size)
    keep = doc[: len(h)] == doc[size - 1 :] if len(h) else np.empty(0, bool)
    h, of = h[keep], doc[: len(keep)][keep]
    n_words = np.bincount(doc, minlength=chunk.n)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.array([B.window_hash(unit[a : a + n], n)[0] for a, n in zip(first, n_words[short], strict=True)], np.uint64)
        h, of = np.concatenate((h, extra)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of


def distinct_in_document(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True at one occurrence of each distinct (document, hash)."""
    key = h ^ B.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    ordered = key[order]
    keep = np.ones(len(h), bool)
    keep[order[1:]] = ordered[1:] != ordered[:-1]
    return keep


def _fingerprints(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = distinct_in_document(h, doc)
    h, doc = h[keep], doc[keep]
    size = np.bincount(doc, minlength=n)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (h, B.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
    edge = np.concatenate(([0], np.cumsum(size)))
    return size, *(s[edge[1:]] - s[edge[:-1]] for s in sums)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _list(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(_signed(values)))


def features(docs: DataFrame, p: MinMaxHash) -> DataFrame:
    """id, set size n, two fingerprints of the set and the band keys of every row of (id, text)."""
    bands, rows = p.bands, p.rows

    def run(batches):
        mul, add = p.multipliers()
        for batch in B.small_batches(batches):
            ids, texts = batch.column(0), B.as_bytes(batch.column(1))
            for c in B.chunks(texts, lower=True):
                h, doc = shingle_hashes(c, p.words)
                n, fp1, fp2 = _fingerprints(h, doc, c.n)
                have = np.flatnonzero(n)
                keys = np.empty((len(have), bands), np.uint64)
                if len(have):
                    at = np.searchsorted(doc, have)
                    for b in range(bands):
                        key = np.full(len(have), b + 1, np.uint64)
                        for j in range(b * rows // 2, (b + 1) * rows // 2):
                            v = (h ^ add[j]) * mul[j]
                            for extreme in (np.minimum, np.maximum):
                                key = B.mix(key * np.uint64(0x9E3779B97F4A7C15) + extreme.reduceat(v, at))
                        keys[:, b] = key
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), pa.array(n, pa.int64()), pa.array(_signed(fp1)), pa.array(_signed(fp2)), _list(keys.ravel(), np.where(n > 0, bands, 0))], names=["id", "n", "fp1", "fp2", "bands"])

    return docs.mapInArrow(run, _FEATURES)


def _parity(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document, 64 * SKETCH bits: bit b is the parity of its hashes that fall on b."""
    bits = 64 * SKETCH
    odd = np.bincount(doc * bits + (h % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def shingle_sets(docs: DataFrame, p: MinMaxHash) -> DataFrame:
    """id, fingerprints, the distinct shingle hashes and their parity sketch of every row of (id, text)."""

    def run(batches):
        for batch in B.small_batches(batches):
            ids, texts = batch.column(0), B.as_bytes(batch.column(1))
            for c in B.chunks(texts, lower=True):
                h, doc = shingle_hashes(c, p.words)
                keep = distinct_in_document(h, doc)
                n, fp1, fp2 = _fingerprints(h, doc, c.n)
                sketch = _parity(h[keep], doc[keep], c.n)
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), pa.array(_signed(fp1)), pa.array(_signed(fp2)), _list(h[keep], n), _list(sketch, np.full(c.n, SKETCH))], names=["id", "fp1", "fp2", "shingles", "sketch"])

    return docs.mapInArrow(run, _SETS)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), component being its smallest reachable id.

    Alternates the large-star and small-star contractions until no edge changes; a
    star of any size is contracted in two steps, and each step shuffles the edges once.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _checksum(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = scratch.save(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select("b", F.col("m"))
        small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = scratch.save(small.where("a <> b").distinct())
        scratch.drop(e, large)
        e, before, seen = new, seen, _checksum(new)
        if before == seen:
            break
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def _confirmed(pairs: DataFrame, sets: DataFrame, p: MinMaxHash) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return met.where(100 * F.col("both") >= p.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, p: MinMaxHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_shingles, component_id and kept."""
    scratch = Scratch(spark, "minhash")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.save(features(given, p))
    nodes = rows.where("n > 0 and id is not null").groupBy("n", "fp1", "fp2").agg(F.min("id").alias("id"), F.min("bands").alias("bands"))
    nodes = scratch.save(nodes)
    banded = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    buckets = scratch.save(banded.join(shared, "key"))
    members = sent_if_small(scratch.save(buckets.select("id").distinct()))
    sets = shingle_sets(given.join(members, "id", "left_semi"), p).join(nodes.select("id", "fp1", "fp2"), ["id", "fp1", "fp2"], "left_semi").dropDuplicates(["id"])
    sets = scratch.save(sets.select("id", "shingles", "sketch"))
    sketches = sets.select("id", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)))

    edges = spark.createDataFrame([], "a long, b long")
    tested = edges
    labels = None
    turn = -1
    while True:
        turn += 1
        at = buckets.withColumn("c", F.col("id")) if labels is None else buckets.join(labels, "id", "left").select("id", "n", "key", F.coalesce("component", "id").alias("c"))
        if labels is not None:
            open_keys = at.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
            at = scratch.save(at.join(open_keys, "key", "left_semi"))
        by_key = at.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("q"))
        left, pairs_left = by_key.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()
        if not left:
            break
        last = bool(turn and pairs_left <= PAIRS_A_ROW * left)
        if last:
            salts = by_key.select("key", F.ceil(F.col("m") / SALTED).cast("int").alias("salts"))
            met = at.join(sketches, "id").join(salts, "key")
            x = met.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
            x = x.select(*(F.col(c).alias(f"{c}_a") for c in x.columns))
            met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
            differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}"))) for i in range(SKETCH)), F.lit(0))
            # |A xor B| is at most this share of |A| + |B| where the similarity is reached.
            near = (200 - (100 - p.percent)) * differ <= (100 - p.percent) * (F.col("n_a") + F.col("n"))
            pairs = x.join(met, (F.col("key_a") == F.col("key")) & (F.col("salt_a") == F.col("salt")) & (F.col("c_a") != F.col("c")) & (F.col("id_a") < F.col("id")) & near)
            pairs = pairs.select(F.col("id_a").alias("a"), F.col("n_a").alias("na"), "id", "n")
        else:
            x = at.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), "key")
            order = (F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), F.col("id"))
            if turn < p.pivot_rounds:
                pivot = at.groupBy("key").agg(F.min(F.struct(F.struct(*order).alias("o"), F.col("id"), F.col("n"), F.col("c"))).alias("p")).select("key", "p.id", "p.n", "p.c")
            else:
                many = min(PIVOTS, 2 << (turn - p.pivot_rounds))
                pivot = at.withColumn("o", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("o") <= many).select("key", "id", "n", "c")
            pivot = scratch.save(pivot)
            pairs = x.join(pivot, "key").where("ca <> c")
            # All pairs of a pivot in its bucket are tested now; buckets of one component stay out.
            buckets = at.select("id", "n", "key").join(pivot.select("key", "id"), ["key", "id"], "left_anti")
        pairs = pairs.where(100 * F.least("na", "n") >= p.percent * F.greatest("na", "n"))
        pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        if labels is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        found = scratch.save(_confirmed(pairs, sets, p))
        tested, edges = tested.union(pairs), edges.union(found)
        labels = scratch.save(components(edges, scratch))
        if last:
            break
    by_set = nodes.select("n", "fp1", "fp2", "id")
    by_set = by_set.join(labels, "id", "left") if labels is not None else by_set.withColumn("component", F.col("id"))
    by_set = by_set.select("n", "fp1", "fp2", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "n", "fp1", "fp2").join(by_set, ["n", "fp1", "fp2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, p: MinMaxHash) -> DataFrame:
    """The documents of which each near-duplicate component keeps the smallest id; rows repeating a kept id count once."""
    found = near_duplicates(spark, docs, p)
    scratch = Scratch(spark, "kept")
    found = scratch.save(found.select("doc_id", "kept"))
    gone = sent_if_small(found.where("doc_id is not null and not kept").select("doc_id").distinct())
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        with_id = out.where("doc_id is not null").dropDuplicates(["doc_id"])
        out = with_id.unionByName(out.where("doc_id is null"))
    return out
