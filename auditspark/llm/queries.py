"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fmindex, html_extract, language_id, line_quality, minhash, packing, quality_rules, suffix_dedup, surrogates, toxicity
from .storage import read

#: op1 links three-word shingle sets at 85 hundredths.
OP1 = minhash.MinMaxHash(words=3, percent=85)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"), OP1)


def tokenizer_path() -> str:
    """The tokenizer of op2, from the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark, read(spark, sf_dir, "documents"), tokenizer_path())


def op3_fmindex_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.contamination(spark, docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(spark, read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(spark, read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judged(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(spark, read(spark, sf_dir, "documents")).drop("code_lengths")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark, read(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op4_mcd_quality_rules": op4_mcd_quality_rules,
        "op2_bestfit_packing": op2_bestfit_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_crf_toxicity": op6_crf_toxicity,
        "op8_crf_line_quality": op8_crf_line_quality,
        "op9_ppm_language": op9_ppm_language,
        "op10_html_main_text": op10_html_main_text,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op3_fmindex_decontamination": op3_fmindex_decontamination,
    }


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(%s, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
""" % _LOWER.format("text")  # noqa: UP031  the pattern holds braces


_OP3 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(%s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(%s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, greatest(2, len(w) - 8)),
    lambda i: array_to_string(w[i:i + 9], ' '))) AS win FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM d, sizes WHERE len(w) >= size
), m AS (SELECT doc_id, pos, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM m) GROUP BY doc_id
), i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(coalesce(w, []))::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
""" % (_LOWER.format("text"), _LOWER.format("text"))  # noqa: UP031


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": _OP1, "op3_fmindex_decontamination": _OP3}
