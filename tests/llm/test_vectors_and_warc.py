import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from trawl.llm import embeddings as E
from trawl.llm import warc as W
from trawl.llm.embeddings import near_vectors
from trawl.llm.warc import warc_round_trip


def brute(rows, least):
    """(vec_id, n_links, component_id) by comparing all pairs."""
    ok = [r.label is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding) for r in rows]
    n = len(rows)
    links = {i: [] for i in range(n)}
    unit = [np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) if ok[i] else None for i, r in enumerate(rows)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i].append(j)
                links[j].append(i)
    comp = {}
    for i in range(n):
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                new = [y for y in links[todo.pop()] if y not in seen]
                seen.update(new)
                todo += new
            name = min((rows[x].vec_id for x in seen if rows[x].vec_id is not None), default=None)
            comp |= dict.fromkeys(seen, name)
    return Counter((r.vec_id, len(links[i]), comp[i]) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(500):
        b = base[i % 12]
        rows.append((i, [x + r.gauss(0, 0.11) for x in b], i % 3 if i % 50 else None, "x"))
    rows += [(1000 + i, [float(x) for x in base[0]], 0, "x") for i in range(40)]  # one vector often
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 0, "x"), (2001, [0.0] * 16, 0, "x"), (2002, [nan] + [1.0] * 15, 0, "x"), (2003, [inf] + [1.0] * 15, 0, "x"), (2004, [None] + [1.0] * 15, 0, "x"), (2005, [], 0, "x"), (2006, [1.0, 2.0], 0, "x"), (2007, [2.0, 4.0], 0, "x"), (2008, [1e30] * 16, 0, "x"), (2009, [1e-30] * 16, 0, "x")]
    rows += [(None, rows[0][1], 0, None), (None, [9.0] + [0.0] * 15, 1, None), (5, rows[5][1], rows[5][2], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")


@pytest.mark.parametrize("members,visitors,k", [(2048, 8192, None), (16, 8, 24)])
def test_near_vectors(spark, sf, vectors, monkeypatch, members, visitors, k):
    monkeypatch.setattr(E, "MEMBERS", members)
    monkeypatch.setattr(E, "VISITORS", visitors)
    got = Counter((g.vec_id, g.n_links, g.component_id) for g in near_vectors(vectors, k=k).collect())
    assert got == brute(vectors.collect(), 0.98)


def test_near_vectors_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert Counter((g.vec_id, g.n_links, g.component_id) for g in near_vectors(df).collect()) == brute(df.collect(), 0.98)
    assert near_vectors(df.limit(0)).count() == 0


def test_double_precision(spark):
    """Components beyond single precision, and vectors that only differ below it."""
    rows = [(1, [1e39, 0.0], 0), (2, [1e39, 1e37], 0), (3, [1.0, 0.0], 0), (4, [1.0, 1e-12], 0), (5, [0.0, 1e-300], 0), (6, [0.0, 1.0], 0), (7, [1e308, 1e308], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: (g.n_links, g.component_id) for g in near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_index_prunes():
    """For a large label more cells are chosen than for a small one, and near vectors still meet."""
    g = np.random.default_rng(2)
    centres = g.normal(size=(200, 64))
    x = E.unit(np.repeat(centres, 10, axis=0) + 0.01 * g.normal(size=(2000, 64)))
    few, many = E.chosen(x, 0.04, 1000), E.chosen(x, 0.04, 10_000_000)
    assert few < many
    books = E.codebook(x[:, :32], many), E.codebook(x[:, 32:], many)
    row, cell, own = E.visits(x, books, 0.04)
    kept = E.halved(row, cell, own)
    home = np.empty(len(x), int)
    home[row[own]] = cell[own]
    load = np.bincount(home, minlength=many * many)
    assert load[cell[kept]].sum() < 0.2 * len(x) ** 2
    seen = set(zip(row[kept].tolist(), cell[kept].tolist(), strict=True))
    near = np.argwhere(x @ x.T >= 0.98)
    assert len(near) > 10_000 and all((i, home[j]) in seen or (j, home[i]) in seen for i, j in near.tolist())


def test_cells_within_the_bound_hold_all_neighbours():
    g = np.random.default_rng(1)
    x = E.unit(g.normal(size=(400, 8)))
    books = (E.codebook(x[:, :4], 9), E.codebook(x[:, 4:], 7))
    row, cell, own = E.visits(x, books, 0.3)
    assert len(set(zip(row.tolist(), cell.tolist(), strict=True))) == len(row) and own.sum() == len(x)
    home = np.empty(len(x), int)
    home[row[own]] = cell[own]
    seen = set(zip(row.tolist(), cell.tolist(), strict=True))
    near = np.argwhere(2 - 2 * (x @ x.T) <= 0.3)
    assert all((int(i), int(home[j])) in seen for i, j in near) and len(near) > len(x)


def pages_brute(rows):
    sha = [base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode() for r in rows]
    first = {}
    for r, s in zip(rows, sha, strict=True):
        if r.page_id is not None:
            first[s] = min(first.get(s, r.page_id), r.page_id)
    out = Counter()
    for r, s in zip(rows, sha, strict=True):
        revisit = s in first and r.page_id != first[s]
        out[r.page_id, len((r.html or "").encode()), s, "revisit" if revisit else "response", first[s] if revisit else None] += 1
    return out


@pytest.mark.parametrize("block,archive", [(512, 1 << 28), (2, 300)])
def test_warc_round_trip(spark, sf, monkeypatch, block, archive):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "ARCHIVE", archive)
    odd = [(1, "http://a.example.com/x", None, "c"), (2, None, "", "c"), (3, "not a url\r\n\tat all", "<p>é😀\r\n\r\nx", "c"), (4, "http://a.example.com:99/x", "<p>é😀\r\n\r\nx", "c"), (None, "http://[bad", "alone", None), (None, "http://b.example.com", "<p>é😀\r\n\r\nx", None), (7, "http://a.example.com/x", "y" * 300_000, None), (-5, "http://a.example.com/x", "y" * 300_000, None), (-5, "http://a.example.com/x", "y" * 300_000, None)]
    df = spark.createDataFrame(odd, "page_id long, url string, html string, key string")
    for t in (df, spark.read.parquet(f"{sf}/pages.parquet")):
        got = Counter((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in warc_round_trip(t).collect())
        assert got == pages_brute(t.collect())
    assert warc_round_trip(df.limit(0)).count() == 0


def test_captures_are_found_by_their_key_alone(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 3)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    shards = W.write_index(W.write_archives(pages, f"file://{tmp_path}"), f"file://{tmp_path}", 4)
    want = pages.where("page_id % 50 = 0").collect()
    keys = spark.createDataFrame([(W.capture_key(r.url, r.page_id),) for r in want] + [("no such key",)], "key string")
    got = {r.page_id: r for r in W.look_up(keys, shards, 2, payload=True).collect()}
    assert {r.page_id: r.html.encode() for r in want} == {k: bytes(v.payload) for k, v in got.items()}
    assert W.surt("HTTP://www.Example.com:80/a?b#c") == "com,example,www):80/a?b".replace("):80", ":80)")


def test_vectors_of_one_component(spark):
    rows = [(1, "x", [1.0]), (2, "x", [2.0]), (3, "x", [2.0]), (4, "x", [-3.0]), (5, "x", [-1.0]), (6, "y", [5.0]), (7, "x", [0.0]), (8, None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8)}
