"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns that
``documents`` has:

1. quality rules: documents that are rejected go;
2. near duplicates: the first document of each class stays;
3. secret scan: secrets are replaced by a mark;
4. packing: the texts' token pieces and where each goes.

Null texts are empty and rejected by the first stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import neardup, packing, quality, secrets_scan
from ledgerspark.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs, Scratch(spark, "near_dedup"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact(docs, secrets_scan.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: Models and tokenizers aren't for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
