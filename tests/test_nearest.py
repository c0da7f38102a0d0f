"""Dense top-k over blocks with bounds gives what all products give."""

import numpy as np
import pytest

from trawl.operators import nearest, retrieve


def brute(q, x, k, same=False):
    out = {}
    for i, v in q.items():
        scored = sorted((-round(float(np.dot(v, w)), 9), c) for c, w in x.items() if same or c != i)
        out[i] = [c for _, c in scored[:k]]
    return out


def frame(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v]) for i, v in rows], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(5)
    centers = g.normal(size=(20, 12)) * 3
    x = {i: centers[i % 20] + g.normal(size=12) * 0.2 for i in range(3000)}
    x |= {10_000 + i: x[7] for i in range(40)}  # ties
    q = {i: x[i] for i in range(0, 3000, 50)} | {7: x[7], 99_999: np.zeros(12)}
    return x, q, frame(spark, [*x.items(), (77_777, None)], "chunk_id").repartition(3).cache(), frame(spark, [*q.items(), (88_888, None)], "qid")


@pytest.mark.parametrize("stored,sample,numbers,same", [(True, 8192, 1 << 22, False), (True, 200, 100, True), (False, 3, 1 << 22, False)])
def test_dense(vectors, monkeypatch, stored, sample, numbers, same):
    x, q, corpus, queries = vectors
    monkeypatch.setattr(nearest, "QUERY_NUMBERS", numbers)
    index = nearest.vector_index(corpus, rows=64, sample=sample, stored=stored)
    got = {}
    for r in retrieve.dense(queries, None, 9, same=same, index=index).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == brute(q, x, 9, same)


def test_most_blocks_are_skipped(vectors):
    _, _, corpus, queries = vectors
    found = nearest.search(queries.where("qid < 3000"), nearest.vector_index(corpus, rows=64, sample=1000), 9)
    told = nearest.reads(found).selectExpr("sum(blocks) a", "sum(blocks_scored) b").first()
    assert 0 < told.b < told.a / 3


def test_empty_sides(vectors):
    _, _, corpus, queries = vectors
    assert retrieve.dense(queries.limit(0), corpus, 3).count() == retrieve.dense(queries, corpus.limit(0), 3).count() == 0
    assert retrieve.dense(queries, None, 3, index=nearest.vector_index(corpus.limit(0))).count() == 0
    assert retrieve.dense(queries.where("qid = 7"), corpus.limit(2), 3).count() == 2
