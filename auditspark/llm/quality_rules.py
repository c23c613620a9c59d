"""Quality rules: fixed rules, then robust multivariate outliers.

Per language and source, the minimum covariance determinant estimate of the
transformed statistics is found, and documents at a large Mahalanobis distance from it
are rejected. From several starts (medians with median absolute deviations, and keyed
subsets of about ``SUBSET`` rows) concentration steps are taken: the ``SUPPORT`` of the
rows nearest to an estimate, exactly so many, give the next one, whose determinant is
never larger. After ``FIRST`` steps each group goes on from its start of the smallest
determinant until that stops falling. A constant diagonal (``FLOOR``) is part of every
covariance, since most statistics are zero in most documents.

Scale: one pass makes a narrow table of statistics. A concentration step counts rows by
group and fine distance bin, which gives the bin that holds the last of the nearest, and
then sums the rows below it; only those within that bin are ordered, equal ones folded
first. Partial sums make a group of any size cheap. Estimates are joined by group:
broadcast while they are counted to be ``SENT_GROUPS`` at most, else by group and salt.

Edge cases: null or empty texts have zero statistics and fail the base rules; null
languages and sources are groups of their own; a group of fewer than ``LEAST`` rows of
ten words or more is judged by the estimate of its whole language, a language of fewer
by that of all documents, and where those are fewer than ``FEW`` nothing is rejected by
distance; of rows equally far the one of smaller statistics is nearer; columns that
clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .storage import Scratch, with_columns_free

#: Share of a group's rows whose covariance determinant is made small.
SUPPORT = 0.75
#: Rows that a group needs for an estimate of its own, and all rows for any (five a dimension).
LEAST, FEW = 200, 30
#: Starts from keyed subsets, their expected rows, and the steps taken from every start.
SUBSETS, SUBSET, FIRST = 3, 24, 2
#: Distance bins to each doubling.
BINS = 4096
#: Estimates that are broadcast at most (some 300 bytes each), and the salts beyond.
SENT_GROUPS, SALTS = 20_000, 16
#: A logarithm of a determinant that falls by less has stopped falling.
STILL = 1e-9
#: Median, and the cutoff (1 - 1e-6), of the chi-square distribution with six degrees of freedom.
CHI2_MEDIAN, CHI2_CUTOFF = 5.3481, 38.258
#: Least standard deviation of each transformed statistic; most are zero in most documents.
FLOOR = (0.05, 0.15, 0.35, 0.30, 0.30, 0.06)

DIMS = len(FLOOR)
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)]) & B.NOT_SPACE
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same", "n_upper")


def _within(mask: np.ndarray, c: B.Chunk) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask[c.data], dtype=np.int64)))
    return total[c.end] - total[c.start]


def repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(met twice or more in its document, met earlier in it) for each hash."""
    key = h ^ B.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def chunk_stats(c: B.Chunk) -> dict[str, np.ndarray]:
    start, end, doc = c.words(B.NOT_SPACE)
    unit = c.hash.of(start, end)
    same = np.flatnonzero((unit[1:] == unit[:-1]) & (doc[1:] == doc[:-1])) + 1
    windows = B.window_hash(unit, 5)
    whole = doc[: len(windows)] == doc[4:] if len(windows) else np.empty(0, bool)
    at = np.flatnonzero(whole)
    again = at[repeated(windows[whole], doc[at])[0]]
    covered = B.cover(again, again + 5, len(doc))
    first, last, line_doc = c.lines()
    filled = np.concatenate(([0], np.cumsum(B.NOT_SPACE[c.data], dtype=np.int64)))
    keep = filled[last] > filled[first]
    first, last, line_doc = first[keep], last[keep], line_doc[keep]
    later = repeated(c.hash.of(first, last), line_doc)[1]
    return {
        "n_words": np.bincount(doc, minlength=c.n),
        "word_chars": _within(_HEAD, c),
        "n_symbols": _within(_SYMBOL, c),
        "n_dup_lines": np.bincount(line_doc[later], minlength=c.n),
        "n_repeat_words": np.bincount(doc[covered], minlength=c.n),
        "n_same": np.bincount(doc[same], minlength=c.n),
        "n_upper": _within(_UPPER, c),
        "n_lines": np.bincount(line_doc, minlength=c.n),
    }


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of every row's whole text."""
    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = [*STATS, "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.small_batches(batches):
            for c in B.chunks(B.as_bytes(batch.column(batch.num_columns - 1))):
                s = chunk_stats(c)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(c.first, c.n) for i in range(len(keep))), *(pa.array(s[k].astype(np.int64)) for k in names)], names=[*keep, *names])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), *(f"{k} long" for k in names)])
    return chosen.mapInArrow(run, schema)


def transformed() -> list[Column]:
    """Ratios with a prior of some words, so that short texts are no outliers for being short; logarithms where they are skewed."""
    words, chars = F.col("n_words") + 20.0, F.col("word_chars") + 100.0
    return [
        F.log((F.col("word_chars") + 100.0) / words),
        F.log1p(F.lit(200.0) * F.col("n_symbols") / chars),
        F.log1p(F.lit(10.0) * F.col("n_dup_lines") / (F.col("n_lines") + 2.0)),
        F.log1p(F.lit(10.0) * F.col("n_repeat_words") / words),
        F.log1p(F.lit(20.0) * F.col("n_same") / words),
        F.sqrt(F.col("n_upper") / chars),
    ]


_X = [f"x{i}" for i in range(DIMS)]


def _grouped(stats: DataFrame, least: int, few: int) -> tuple[DataFrame, DataFrame]:
    """``stats`` with ``g``, the group whose estimate judges the row (null: none), and the rows (g, x...) of every such group."""
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    own, pool, rest = F.to_json(F.struct(lang.alias("l"), source.alias("s"))), F.to_json(F.struct(lang.alias("l"))), F.lit("all")
    full = (F.col("n_words") >= 10).cast("long")
    sizes = stats.groupBy(own.alias("own"), pool.alias("pool")).agg(F.sum(full).alias("n"))
    pools = sizes.groupBy("pool").agg(F.sum("n").alias("of_pool"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    last = rest if total >= few else F.lit(None).cast("string")
    sizes = sizes.join(pools, "pool").withColumn("g", F.when(F.col("n") >= least, F.col("own")).when(F.col("of_pool") >= least, F.col("pool")).otherwise(last))
    grouped = _joined(stats.withColumn("own", own), sizes.select("own", "g"), ["own"], "left").drop("own")
    used = sizes.where("g is not null").select("g").distinct()
    # A row counts in its own group, and in the larger ones that judge others.
    keys = F.array(own, pool, rest)
    rows = _joined(stats.where("n_words >= 10").select(F.explode(keys).alias("g"), *_X), used, ["g"], "left_semi")
    return grouped, rows


_MOMENTS = [*(f"m{i}" for i in range(DIMS)), *(f"p{i}{j}" for i, j in _PAIRS)]
_PARAM_SCHEMA = ", ".join(["g string, k int", *(f"{c} double" for c in _MOMENTS), "logdet double"])


def _joined(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with what ``small`` has of their group, without a task for each group."""
    if small.count() <= SENT_GROUPS:
        return rows.join(F.broadcast(small), on, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"], how).drop("salt")


def _sums(rows: DataFrame, weight: Column) -> DataFrame:
    w = weight.cast("double")
    return rows.groupBy("g", "k").agg(F.sum(w).alias("n"), *(F.sum(w * F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)), *(F.sum(w * F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS))


def moments(n: np.ndarray, total: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, inverses and log determinants of the covariances with the floor, from sums over n rows of each group."""
    mean = total / n[:, None]
    cov = square / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + np.diag(np.square(FLOOR))
    return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        square = np.zeros((len(b), DIMS, DIMS))
        for i, j in _PAIRS:
            square[:, i, j] = square[:, j, i] = b[f"q{i}{j}"].to_numpy(float)
        mean, inverse, logdet = moments(b["n"].to_numpy(float), b[[f"s{i}" for i in range(DIMS)]].to_numpy(float), square)
        yield pd.DataFrame({"g": b["g"].to_numpy(), "k": b["k"].to_numpy(), **{f"m{i}": mean[:, i] for i in range(DIMS)}, **{f"p{i}{j}": inverse[:, i, j] for i, j in _PAIRS}, "logdet": logdet})


def _medians(of: DataFrame) -> DataFrame:
    """The median of v for each (g, i), from counts of values rounded to thousandths."""
    counts = of.groupBy("g", "i", F.round("v", 3).alias("v")).agg(F.count("*").alias("n"))
    run, all_ = Window.partitionBy("g", "i").orderBy("v"), Window.partitionBy("g", "i")
    counts = counts.withColumn("below", F.sum("n").over(run)).withColumn("all", F.sum("n").over(all_))
    return counts.where("below * 2 >= all").groupBy("g", "i").agg(F.min("v").alias("median"))


def starts(rows: DataFrame) -> DataFrame:
    """Start 0 of each group is its medians with median absolute deviations; the others are keyed subsets."""
    long = rows.select("g", F.posexplode(F.array(*_X)).alias("i", "v"))
    centre = _medians(long)
    wide = centre.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"m{i}") for i in range(DIMS)))
    away = _joined(rows, wide, ["g"]).select("g", F.posexplode(F.array(*(F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(_X)))).alias("i", "v"))
    both = centre.join(_medians(away).withColumnRenamed("median", "mad"), ["g", "i"])
    wide = both.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{a}{i}") for a, c in (("m", "median"), ("s", "mad")) for i in range(DIMS)))
    sd = [F.greatest(F.lit(FLOOR[i]), 1.4826 * F.col(f"s{i}")) for i in range(DIMS)]
    logdet = sum((2 * F.log(x) for x in sd), F.lit(0.0))
    first = wide.select("g", F.lit(0).alias("k"), *(f"m{i}" for i in range(DIMS)), *((1 / (sd[i] * sd[i]) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS), logdet.alias("logdet"))
    sized = _joined(rows, rows.groupBy("g").agg(F.count("*").alias("all")), ["g"])
    drawn = [sized.where(F.pmod(F.xxhash64(*_X, F.lit(k)), F.col("all")) < SUBSET).select("g", F.lit(k).alias("k"), *_X) for k in range(1, SUBSETS + 1)]
    subsets = drawn[0]
    for x in drawn[1:]:
        subsets = subsets.union(x)
    return first.union(_sums(subsets, F.lit(1)).mapInPandas(_estimated, _PARAM_SCHEMA))


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * d[i] * d[j]
    return total


def _binned(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Every row with its distance, and that's bin, under each estimate of its group."""
    d = _joined(rows, params, ["g"]).withColumn("d2", _distance())
    return d.withColumn("bin", F.floor(BINS * F.log2(F.greatest("d2", F.lit(1e-6)))))


def _cumulated(rows: DataFrame, params: DataFrame) -> DataFrame:
    counts = _binned(rows, params).groupBy("g", "k", "bin").agg(F.count("*").alias("n"))
    run, all_ = Window.partitionBy("g", "k").orderBy("bin"), Window.partitionBy("g", "k")
    return counts.withColumn("below", F.sum("n").over(run)).withColumn("all", F.sum("n").over(all_))


def concentrated(rows: DataFrame, params: DataFrame, scratch: Scratch) -> DataFrame:
    """One concentration step: of each (g, k), the estimate from the nearest ``SUPPORT`` of the group's rows."""
    need = F.ceil(SUPPORT * F.col("all"))
    last = _cumulated(rows, params).where((F.col("below") >= need) & (F.col("below") - F.col("n") < need))
    last = last.select("g", "k", F.col("bin").alias("last"), (need - F.col("below") + F.col("n")).alias("rest"))
    bounded = scratch.save(params.join(last, ["g", "k"]))
    d = _binned(rows, bounded)
    edge = d.where(F.col("bin") == F.col("last")).groupBy("g", "k", "rest", "d2", *_X).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g", "k").orderBy("d2", *_X)) - F.col("n")
    edge = edge.withColumn("w", F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - before)))
    near = _sums(d.where(F.col("bin") < F.col("last")), F.lit(1)).unionByName(_sums(edge, F.col("w")))
    total = near.groupBy("g", "k").agg(*(F.sum(c).alias(c) for c in near.columns[2:]))
    return scratch.save(total.mapInPandas(_estimated, _PARAM_SCHEMA))


def least_determinant(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """For each group g of (g, x0, x1 ...) the estimate of smallest determinant that the starts lead to."""
    params = scratch.save(starts(rows))
    for _ in range(FIRST):
        params = concentrated(rows, params, scratch)
    order = F.struct("logdet", "k")
    best = params.groupBy("g").agg(F.min_by(F.struct(*[c for c in params.columns if c != "g"]), order).alias("x")).select("g", "x.*")
    best = scratch.save(best)
    while True:
        new = concentrated(rows, best, scratch)
        fell = best.select("g", F.col("logdet").alias("was")).join(new.select("g", "logdet"), "g").agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        if fell is None or fell <= STILL:
            return best
        # A group that has come to rest stays as it is, whatever rounding would make of it.
        both = best.unionByName(new).groupBy("g").agg(F.min_by(F.struct(*[c for c in new.columns if c != "g"]), F.col("logdet")).alias("x"))
        last, best = best, scratch.save(both.select("g", "x.*"))
        scratch.drop(last, new)


def scaled(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` with ``scale``: a group's median distance against that of the normal distribution."""
    half = _cumulated(rows, params).where(F.col("below") * 2 >= F.col("all")).groupBy("g").agg(F.min("bin").alias("bin"))
    return params.join(half.select("g", (F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS) / CHI2_MEDIAN).alias("scale")), "g")


def judged(spark: SparkSession, docs: DataFrame, keep: list[str], least: int = LEAST, few: int = FEW) -> DataFrame:
    """The columns ``keep`` with the statistics, base_failed, distance and kept."""
    scratch = Scratch(spark, "mcd")
    keep = [k for k in keep if k not in (*STATS, "n_lines", "base_failed", "distance", "kept", "g")]
    at = [*dict.fromkeys([*keep, "lang", "source"])]
    stats = scratch.save(statistics(docs, at))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    stats = stats.select("*", *(x.alias(f"x{i}") for i, x in enumerate(transformed())))
    grouped, rows = _grouped(stats, least, few)
    grouped, rows = scratch.save(grouped), scratch.save(rows)
    params = scratch.save(scaled(rows, least_determinant(rows, scratch)).drop("k", "logdet"))
    out = _joined(grouped, params, ["g"], "left").withColumn("distance", _distance() / F.greatest("scale", F.lit(1.0)))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI2_CUTOFF, F.lit(True)))
    return out.select(*keep, *STATS, "base_failed", "distance", "kept")


def filtered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that are kept."""
    return with_columns_free(docs, "kept").join(judged(spark, docs, ["doc_id"]).where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
