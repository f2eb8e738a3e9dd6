"""From raw documents to a training mix: rules, near duplicates, benchmark passages, secrets, source weights.

Every stage reads doc_id, text and source of all rows it is given, hands on all columns, whatever their names, and gives an
empty table for an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.contamination import decontaminated
from panelspark.llm.minhash import unique_documents
from panelspark.llm.mixing import mixed_documents
from panelspark.llm.quality import passing_documents
from panelspark.llm.secrets import redact_secrets
from panelspark.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and so too few: they go. Repeated rows share their verdict.
    """
    return passing_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id.

    Of rows equal in id and text one stays, and without an id one of each text. Null and empty texts are groups of their
    own; a null id comes last in its group.
    """
    return unique_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null and empty texts stay; equal rows share their fate."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars, if there is such a column, is the new length; every document stays.

    Of a null text n_chars stays as it is. Repeated rows are replaced alike.
    """
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; ``_copy`` numbers its rows from 1.

    A null source is a source of its own. Null and empty texts go. Equal rows share their fate. A column named ``_copy``
    stays, and the number is ``__copy`` then.
    """
    return mixed_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("mixing", mixing),
]

ORACLE_SQL = None  # learned rules, alignments and the seeded choice are not SQL; tests/llm checks them stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
