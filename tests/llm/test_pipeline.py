"""The pipeline's stages one by one, on their own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import mixing

from .test_jaccard_dedup import slow_kept


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    from rillwork.llm.scratch import write_table

    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(write_table(stage(spark, tables[-1], sf_dir), name))
    return tables


def test_stages_may_be_chained_without_storing(spark, sf_dir, steps):
    """Two chains at once, neither stored between stages; both see their tables to the end."""
    from rillwork.llm.scratch import free_tables

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chains = [source, source]
    for _, stage in corpus_pipeline.STAGES:
        chains = [stage(spark, c, sf_dir) for c in chains]
        free_tables(spark, collect=True)
    assert [c.count() for c in chains] == [steps[5].count()] * 2


def test_all_but_the_last_keep_the_columns(steps):
    assert all(t.columns == steps[0].columns for t in steps[:-1])


def test_language_stage_keeps_clean_documents(steps):
    assert steps[1].count() >= 0.97 * steps[0].count()


def test_dedup_stage_keeps_the_least_of_each_component(steps):
    blank = lambda t: not (t or "").strip(" \t\n\x0b\f\r")
    texts = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    without = [k for k, t in texts.items() if blank(t)]
    want = sorted(slow_kept({k: t for k, t in texts.items() if not blank(t)}) + sorted(without)[:1])
    assert sorted(r["doc_id"] for r in steps[2].collect()) == want


def test_pii_stage_keeps_rows(steps):
    assert steps[3].count() == steps[2].count() and steps[3].where(F.col("text").contains("@")).count() == steps[2].where(F.col("text").contains("@")).count()


def test_mix_stage_takes_what_the_operator_says(steps):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(steps[3]).collect() if r["taken"]}
    words = steps[4].groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r["doc_id"]: r["n"] for r in words.collect()} == taken


def test_encode_stage_is_lossless(steps):
    assert steps[5].count() == steps[4].count() and steps[5].where("not round_trip").count() == 0


def test_run(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[5].count()


@pytest.mark.parametrize("repeats", [0, 1, 3])
def test_run_over_odd_rows(spark, sf_dir, tmp_path, repeats):
    """From end to end: nulls in any column, blank and long texts, repeated rows and keys, clashing columns, and an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, None, 0), (None, "the of and to in is was " * 20, "en", None, 9), (2, "the of and to in is was " * 30_000, "en", "s", None)]
    some = docs.limit(20).union(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("clash") for c in ("size", "rank", "ids", "grams", "component")})
    all_ = some.limit(0)
    for _ in range(repeats):
        all_ = all_.union(some)
    all_.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == bool(repeats) and all(r["round_trip"] for r in got if r["ids"] is not None)


def test_dedup_stage_links_near_fingerprints(spark, sf_dir):
    """1 and 2 are linked by their fingerprints alone, 2 and 3 by their sets of shingles alone; 4 and 5 are copies, 6 is neither."""
    from rillwork.llm import simhash_dedup

    from .test_jaccard_dedup import slow_similarity

    tail = lambda c: " ".join(f"{c}{i}" for i in range(40))
    phrase = "alpha beta gamma delta epsilon "
    texts = [phrase * 300 + tail("p"), phrase * 300 + tail("q"), phrase * 3 + tail("q"), tail("r"), tail("r"), tail("s")]
    bits = lambda a, b: (simhash_dedup.fingerprint(texts[a]) ^ simhash_dedup.fingerprint(texts[b])).bit_count()
    assert bits(0, 1) <= 3 < min(bits(0, 2), bits(1, 2)) and slow_similarity(texts[1], texts[2]) >= 0.8 > slow_similarity(texts[0], texts[1])
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir).collect()) == [1, 4, 6]
