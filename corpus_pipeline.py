"""Corpus pipeline over ``documents``: each stage reads what the one before it wrote and returns what it keeps.

Every stage but the last returns the columns of ``documents``. Near-duplicates, benchmark edits and their thresholds are
beyond SQL, so ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` holds the stages against brute force.

NULLs, empty and very long texts, repeated rows, empty tables and additional columns are handled as the operators define:
a NULL or empty text fails the quality rules; of rows with equal ids and texts one stays; additional columns are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrovane.llm import decontaminate, mixing, quality_rules, secret_scan, superminhash
from agrovane.llm.common import packed, prepare, read
from agrovane.scale import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy of the quality ledger."""
    prepare(spark)
    entries = quality_rules.ledger(packed(docs, "text"), "_doc")
    return entries.where(quality_rules.passes(quality_rules.PRODUCTION)).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    prepare(spark)
    return superminhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, edits within its budget included."""
    return decontaminate.clean(docs, read(prepare(spark), sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that are not widely copied examples are replaced by their kind in brackets."""
    prepare(spark)
    rows = secret_scan.with_verdicts(packed(docs, "text", "source", "lang"), *secret_scan.owner_columns(), "_doc", "source", "lang")
    text = secret_scan.redact(F.col("_doc.text"), F.col("classes"))
    return rows.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is repeated so that the sources meet their targets; those taken no time are left out."""
    prepare(spark)
    return mixing.op9(docs).where(F.col("copies") > 0)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secrets),
    ("mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet in the shared folder and read again."""
    docs = read(prepare(spark), sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
