"""A corpus pipeline of five training-data operators over ``documents``.

1. quality rules: documents that the host rules reject go.
2. SimHash near-dedup: of each group of near copies the document with the smallest id stays.
3. suffix-array dedup: bytes that a 100-byte string covers which starts earlier in the corpus are cut out of the text.
4. secret scans: every secret in the text is replaced by a mask.
5. packing: the texts become pieces of packed token sequences.

Each stage works on all rows that the one before kept, and all but the last return the columns of
``documents`` (n_chars follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import host_rules, packing, secret_scan, simhash_dedup, suffix_dedup
from cubeloom.llm.common import cut, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.representatives(docs).select(*COLUMNS)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A cut can part a character; what is left of one is dropped. Null text stays null."""
    rows = suffix_dedup.deduplicated(docs, rest=["lang", "source", F.isnull("text").alias("was_null")], with_text=True)
    text = F.when(F.col("rest.was_null"), F.lit(None)).otherwise(F.col("kept"))
    return rows.select("doc_id", text.alias("text"), "rest.lang", "rest.source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", repeated_bytes),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL can't express the fingerprints, the suffix sort and the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
