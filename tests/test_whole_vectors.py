"""Whitening and principal directions run over all vectors and components."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.plans.space_queries import g17_whiten, g18_principal


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}


def gathered(df) -> dict[int, np.ndarray]:
    """Vectors of a query that gives a row a component."""
    rows = df.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v")).collect()
    return {int(r["station"][1:]): np.array([x["value"] for x in r["v"]]) for r in rows}


def test_whiten_covers_all_vectors(spark, sf_dir, vectors):
    got = gathered(g17_whiten(spark, sf_dir))
    assert got.keys() == vectors.keys()
    x = np.array([vectors[k] for k in sorted(vectors)])
    values, turned = np.linalg.eigh(np.cov(x.T) + 1e-6 * np.eye(x.shape[1]))
    want = (x - x.mean(axis=0)) @ (turned / np.sqrt(values)) @ turned.T
    assert np.allclose([got[k] for k in sorted(got)], want, atol=1e-5)


def test_principal_covers_all_vectors(spark, sf_dir, vectors):
    got = gathered(g18_principal(spark, sf_dir))
    assert got.keys() == vectors.keys()
    x = np.array([vectors[k] for k in sorted(vectors)])
    scores = np.array([got[k] for k in sorted(got)])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(scores.var(axis=0, ddof=1), values[: scores.shape[1]], rtol=1e-6)
