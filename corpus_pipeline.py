"""A training corpus from ``documents``: five stages, each on all its predecessor kept.

Every stage is written as Parquet into the shared folder and read again, so a lost
executor costs at most one stage. All but the last stage return the columns of
documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from locatext.llm.queries import byte_vocabulary
from locatext.session import table, written

#: Documents whose language is less certain than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def _ids(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").alias("__id")).distinct()


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a known language stay; texts without a letter (and null or empty ones)
    or of uncertain language go. Repeated rows are each judged; of an empty table, or
    one without a labelled row to learn from, nothing stays."""
    return language_id.certain(docs, language_id.fit_unheld(docs), MIN_LANGUAGE_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. Null is empty; a null id
    ranks below every other; rows that repeat the id that stays all stay."""
    return exact_dedup.keep_largest_id(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, similarity 0.8 or more)
    the document with the smallest doc_id stays; all other documents stay, as do texts
    without words, null texts and rows with a null id. Rows that repeat an id are one
    document."""
    stay = _ids(near_dedup.near_duplicates(docs, shingle=5).where("kept"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and with them rows that repeat their id;
    null and wordless texts hold none."""
    leaks = _ids(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["__id"]), "left_anti")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row that is left; a null text has no tokens."""
    return bpe.encode_decode(docs, byte_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact duplicates", exact_stage),
    ("near duplicates", near_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Naive Bayes and byte-pair encoding have no SQL form; the tests hold the pipeline
#: against a brute-force version of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows. Columns besides
    doc_id, text and lang may have any name and pass through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
