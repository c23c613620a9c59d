"""Training text from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents, so a lost executor repeats one
stage's tasks at most. All stages but the last return the columns of ``documents``:

1. quality: documents that the line field calls bad go;
2. near_duplicates: of every group of near copies (five-word shingles, 0.8) the smallest id stays;
3. decontamination: the words of benchmark phrases are cut out, the documents stay;
4. surrogates: personal data and secrets are replaced, the documents stay (the session sets the
   secret key as ``auditspark.surrogates.key``);
5. packing: every document's tokens in sequences of at most 4096.

Stages 1, 3 and 4 are models or byte-level rewriting, so SQL cannot express the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditspark.llm import fmindex, line_quality, minhash, packing, surrogates
from auditspark.llm.queries import tokenizer_path
from auditspark.llm.storage import Scratch, bounded_batches, packed_row, read, unpacked_row

NEAR = minhash.MinMaxHash(words=5, percent=80)

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.good_documents(spark, docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(spark, docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return unpacked_row(surrogates.pseudonymised(spark, packed_row(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers live through all stages: a smaller vocabulary leaves room for the others.
    return packing.packed(spark, docs, tokenizer_path(), cache=100_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", replace_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's input goes when its output is there."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        given, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(given)
    return docs
