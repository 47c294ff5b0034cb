"""The pipeline's near-duplicate stage against brute force over exact shingle sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from rillwork.llm import jaccard_dedup

SCHEMA = "doc_id long, text string"


def slow_similarity(a, b):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def slow_kept(texts):
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(texts, 2):
        if slow_similarity(texts[a], texts[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted({root(k) for k in texts})


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def texts():
    """Pairs on both sides of 0.8, and a group of copies of one text that are less like each other than like it."""
    rng = random.Random(5)
    out = []
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14] * 3:
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        out += [words, edited(rng, words, n)]
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    out += [edited(rng, words, rng.randrange(1, 12)) for _ in range(40)]
    return {i: " ".join(w) for i, w in enumerate(out)}


def test_stage_drops_what_is_alike_from_four_fifths_on(spark, sf_dir, texts):
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = stage(spark, spark.createDataFrame(list(texts.items()), SCHEMA), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(texts)


def test_parted_groups_lose_no_pair(spark, texts):
    kept = jaccard_dedup.drop_near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA), part=4)
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(texts)


def test_rows_are_dropped_by_text_not_by_key(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (2, long + " end"), (2, "nobody's copy"), (2, "nobody's copy"), (None, long), (3, None), (4, " \n"), (5, "one"), (6, "One")]
    kept = jaccard_dedup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in kept.collect()} == {(1, long), (2, "nobody's copy"), (None, long), (3, None), (5, "one")} and kept.count() == 5
    assert jaccard_dedup.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
