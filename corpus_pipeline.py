"""A corpus made ready for training: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, folder of tables) and returns a DataFrame; all but the last return
the columns of ``documents``. A stage sees what the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm import bpe, decontamination, language_id, near_dedup, secret_scan
from wiretide.session import drop_written, scratch_folder, written

#: A document of which more than this share is benchmark text goes; of others the passages go.
MOST_CONTAMINATED = 0.5
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; rejected ones go."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.predict(docs, model, keep=tuple(docs.columns))
    return judged.where("known").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at 0.8."""
    return near_dedup.keep_one(docs, single=True)


def benchmark_free(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without passages of the benchmark; mostly contaminated ones go."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.cut(docs, items, max_share=MOST_CONTAMINATED)


def secret_free(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, live-looking secrets masked."""
    return secret_scan.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids per document, with the digest of the bytes that they decode to."""
    asked = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, out=asked)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", secret_free),
    ("byte-level BPE", encoded),
]

#: Learned models, similarity groups and merges have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The last stage's rows; what stages hand on is Parquet in the shared folder.

    A stage's table is dropped once the next one is written; the last is dropped when the process ends.
    """
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, here = written(stage(spark, docs, folder), scratch_folder(spark))
        if before:
            drop_written(spark, before)
        before = here
    return STAGES[-1][1](spark, docs, folder)
