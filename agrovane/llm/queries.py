"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agrovane.llm import collocations, conversations, decontaminate, license_scan, mixing, polytope, quality_rules, recompression, rule_ensemble, secret_scan, suffix_index, superminhash, warc
from agrovane.llm.common import prepare, read


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return operator(*[read(spark, folder, table) for table in tables])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _over(quality_rules.op1, "documents"),
    "op2_license_scan": _over(license_scan.op2, "documents"),
    "op3_warc": _over(warc.op3, "pages"),
    "op4_recompression": _over(recompression.op4, "documents"),
    "op5_superminhash": _over(superminhash.op5, "documents"),
    "op6_rule_ensemble": _over(rule_ensemble.op6, "documents", "labels"),
    "op7_decontaminate": _over(decontaminate.op7, "documents", "benchmark"),
    "op8_suffix_index": _over(suffix_index.op8, "documents"),
    "op9_mixing": _over(mixing.op9, "documents"),
    "op10_secret_scan": _over(secret_scan.op10, "documents"),
    "op11_conversation_repair": _over(conversations.op11, "conversations"),
    "op12_polytope": _over(polytope.op12, "embeddings"),
    "op13_collocations": _over(collocations.op13, "documents"),
}
