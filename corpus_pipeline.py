"""A pipeline over ``documents``: stages that each call one operator of ``retentio.llm``.

Each stage takes the documents its predecessor kept and returns documents again (the last
one returns its own columns); between stages the documents are written as Parquet and read
again, so a stage never recomputes an earlier one and a lost executor costs one stage's tasks.

The stages keep every row they do not reject, null ids and repeated rows included; columns
beyond those of ``documents`` do not go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import decontam, langid, piece_fst, simhash, substring_dedup
from retentio.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on: those that language ID finds none in (``und``) are rejected.

    These are the documents without letters: the nearest of the learned languages is taken however
    far it is, so no cosine rejects a document. Prototypes are learned from the given documents'
    text and lang; a wrong or missing lang is no reason to reject a document, nor is it if
    no document has one.
    """
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.fit_prototypes(docs), unlearned=langid.UNLEARNED)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near-duplicates stays: the one with the smallest doc_id."""
    return simhash.first_of_each_class(docs.select(*COLUMNS), width=3, radius=3).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of which nothing but white space is left go."""
    cut = substring_dedup.dedup_substrings(docs, keep=("lang", "source", "n_chars"))
    changed = F.col("removed_bytes") > 0
    left = cut.filter(~changed | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return left.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark are rejected."""
    return decontam.without_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids: doc_id, n_ids, n_fallback, restored (decoding gives the text back), ids."""
    return piece_fst.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", tokens),
]

#: Fingerprints, chunks and piece ids have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
