"""The corpus pipeline: documents in, encoded documents out. Each stage's rows are written and read again by the next.

All stages take null ids and texts, empty and very long texts, repeated rows, empty tables and any further columns; the
first four return the columns that they were given, whatever their names, with the rows that they keep as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import byte_bpe, decontamination, jaccard_join, secrets, toxicity
from tabloom.llm.shared import discard, written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject. A null or empty text scores as one without words; of repeated
    rows all stay or none."""
    return toxicity.drop_toxic(docs, _read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id (a null one is the largest). Texts
    without words, null or empty, are in no group and stay; of rows that repeat with a text one stays."""
    return jaccard_join.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage. Null and empty texts have none; of repeated rows all stay or none."""
    return decontamination.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live credentials in them replaced by a mark. Null texts stay null; repeated rows are changed alike."""
    return secrets.redact_live(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and the digests of its ids and of what they decode to. A null text is empty;
    repeated rows give equal rows."""
    return byte_bpe.digests(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", contaminated),
    ("secret_scans", secret_values),
    ("byte_bpe", encoded),
]
#: SQL can express neither the classifier nor the encoding; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table of documents. A stage's table is deleted once the next one's is written."""
    docs, tables = _read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, *tables)
        tables = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
