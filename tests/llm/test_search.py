import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from trawl.llm import search as S
from trawl.llm.oracles import ORACLES
from trawl.llm.queries import QUERIES

NAME = "op13_lexical_search"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    have = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(have), sum(c.total() for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, c in have:
            m = 100 - 75 + 75 * c.total() * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def made():
    r = random.Random(3)
    words = ["the", "Of", "and", "naïve", "Été", "x1", "42", "Łódź", "日本", "w", "q.r"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.03)), len(words) - 1)] + r.choice(["", ",", ".", "\n", "-"]) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 20, 200]))) for i in range(900)]
    docs += [(2000 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(None, docs[7][1]), (5, docs[5][1]), (5, docs[5][1]), (3000, None), (3001, ""), (3002, " .,;\u0000"), (3003, text(30000)), (3004, "the " * 5000), (3005, "İstanbul ISTANBUL ﬁ")]
    items = [(i, text(25)) for i in range(30)] + [(40, docs[7][1]), (41, None), (42, "..."), (43, "unheard"), (44, "the the THE of"), (44, "x1 42 x1"), (None, "naïve Été"), (45, "istanbul")]
    return docs, items


@pytest.mark.parametrize("leaf,docs_at_once,chars", [(16, 1 << 14, 2_000_000), (3, 50, 900)])
def test_against_brute_force(spark, monkeypatch, leaf, docs_at_once, chars):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "GROUP_DOCS", docs_at_once)
    docs, items = made()
    d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, item_id string, n int").repartition(3)
    q = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, score int")
    got = S.ranked_search(d, q, block_chars=chars).collect()
    assert Counter(map(tuple, got)) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.ranked_search(d, q).collect() == []
    assert S.ranked_search(q.withColumnRenamed("item_id", "doc_id"), q.limit(0)).collect() == []


def test_most_ranges_stay_closed():
    r = np.random.default_rng(1)
    docs, width = 4096, 500
    sizes = np.full(docs, 20)
    terms_ = np.concatenate([r.choice(width, 20, replace=False) for _ in range(docs)])
    g = S.group(list(range(docs)), np.full(docs, 20), sizes, terms_, np.ones(len(terms_), np.int64), width, docs, docs * 20)
    asked = terms_[:12].astype(np.int64)
    weights = np.full(12, 1000, np.int64)
    best, opened = S.search(g, asked, weights, np.zeros(width, np.int64), [], 1)
    assert best[0][1] == 0 and opened < docs // S.LEAF // 10


def test_sums_beyond_64_bits():
    n = np.array([10**9, 5], np.int64)
    assert S.lengths(n, 10**11, 10**15).tolist() == [25 + 75 * 10**9 * 10**11 // 10**15, 25 + 75 * 5 * 10**11 // 10**15]


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[NAME])
    names = [d[0] for d in found.description]
    want = Counter(tuple(r[names.index(c)] for c in ("item_id", "rank", "doc_id", "score")) for r in found.fetchall())
    got = QUERIES[NAME](spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want
