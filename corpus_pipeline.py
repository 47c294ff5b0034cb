"""From raw documents to piece ids: five stages, each over all that the one before kept.

language_id drops documents without an identifiable language; near_dedup keeps one of each near-duplicate
component; pii replaces personal data by linked pseudonyms; mix repeats and drops documents so that the sources
meet their target weights; encode cuts the texts into pieces.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import jaccard_dedup, language_id, merge_dropout, mixing, pii, simhash_dedup
from rillwork.llm.scratch import free_tables, write_table
from rillwork.plans.deploy import ship


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (``language_id.keep_identified``)."""
    ship(spark)
    return language_id.keep_identified(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least ``doc_id``.

    Texts are linked as ``op5`` links them, by near SimHash fingerprints from a byte-position index (``simhash_dedup``); similar sets of
    word shingles (``jaccard_dedup``) add the links between texts whose fingerprints lie further apart.
    """
    ship(spark)
    texts = docs.where("doc_id is not null").select(jaccard_dedup.text_id("text").alias("id"), "text")
    return jaccard_dedup.drop_near_duplicates(docs, links=simhash_dedup.key_links(texts, "id"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The key is the session's (``pii.SECRET``); where there is none, one is drawn for this run and forgotten."""
    return pii.pseudonymise(docs, pii.secret_of(spark, secrets.token_hex(32)), counts=False)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (``mixing.mixed_copies``)."""
    return mixing.mixed_copies(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip``; every row is cut in its own way, so the copies of a document differ."""
    ship(spark)
    return merge_dropout.encode_column(docs, copies=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _language_id),
    ("near_dedup", _near_dedup),
    ("pii", _pii),
    ("mix", _mix),
    ("encode", _encode),
]

#: Fingerprints, trigram models and keyed permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, and what stages wrote for themselves goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
        free_tables(spark, collect=True)
    return STAGES[-1][1](spark, docs, sf_dir)
