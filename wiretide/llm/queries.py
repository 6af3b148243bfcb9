"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm import (
    bpe,
    decontamination,
    language_id,
    license_scan,
    merkle_manifest,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality_rules,
    secret_scan,
    substring_dedup,
    url_filters,
)

#: The vocabulary file; any rank file of fewer than 65,536 tokens serves.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=2)


#: The url rules (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    judged = url_filters.judge(table(spark, folder, "pages"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.duplicate_spans(table(spark, folder, "documents"), extend=True)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, folder, "documents")))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out))
    return language_id.predict(docs, model, keep=("doc_id",)).select(
        "row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.report(decontamination.matches(docs, items))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    asked = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, out=asked)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")  # no overflow
    return merkle_manifest.audit(docs, tampered, {"n_chars": more})


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.scan(table(spark, folder, "documents")))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_substring_dedup,
        op3_secret_scan,
        op4_language_id,
        op5_packing,
        op6_quality_rules,
        op7_decontamination,
        op8_byte_bpe,
        op9_license_scan,
        op10_near_dedup,
        op11_merkle_manifest,
        op12_pii,
        op13_prefix_trie,
    )
}
