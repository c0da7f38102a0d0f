import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from trawl.llm import language as L
from trawl.llm.queries import QUERIES

WORDS = {"aa": "tha ing and the of whe ers".split(), "bb": "der und sch ein ver ung ich".split(), "cc": "que les ment eau oui elle vre".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(2)
    rows = [(i, text(r, lang, 60), lang) for i, lang in enumerate(list(WORDS) * 40)]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain(text, model):
    """Shares and certainty by loops over words, without merging, settling or shortcuts beyond the rounds."""
    low = text.lower()
    words, at = [], 0
    while at < len(low):
        end = at
        while end < len(low) and low[end].isalpha():
            end += 1
        if end > at:
            words.append(low[at:end])
        at = max(end, at + 1)
    if not words:
        return {}, 0.0
    pad = lambda w: np.array([10, *map(ord, w), 10], np.uint32)
    logs = [np.sum([model.logs[b] for b in L._units(pad(w), np.zeros(len(w), int), slice(1, len(w) + 1)).buckets], axis=0).astype(float) for w in words]
    width = len(model.languages)

    def em(shares):
        value = 0
        for _ in range(L.ROUNDS):
            new, value = np.zeros(width), 0
            for x in logs:
                p = shares * np.exp(x - x.max())
                value += math.log(p.sum())
                new += p / p.sum()
            new /= len(logs)
            moved = abs(new - shares).max()
            shares = new
            if moved <= L.SETTLED:
                break
        return shares, value

    single = sum(x - x.max() for x in logs)
    won, best = single.max(), np.eye(width)[single.argmax()]
    sure = 1 / np.exp(single - won).sum()
    whole, _ = em(np.full(width, 1 / width))
    for k in range(2, width + 1):
        mask = np.zeros(width, bool)
        mask[np.argsort(-whole, kind="stable")[:k]] = True
        start = np.where(mask, np.maximum(whole, 1e-6), 0)
        shares, value = em(start / start.sum())
        if value - (k - 1) * 0.5 * math.log(len(words)) > won:
            won, best, sure = value - (k - 1) * 0.5 * math.log(len(words)), shares, shares.max()
    return {v: s for v, s in zip(model.languages, best, strict=True) if s > 0}, sure


def test_against_plain_loops(spark, model):
    r = random.Random(5)
    texts = [text(r, lang, n) for lang in WORDS for n in (1, 2, 5, 30)]
    texts += [text(r, "aa", 40) + ".\n" + text(r, "bb", n) for n in (2, 15, 40, 90)] + [text(r, "aa", 30) + text(r, "bb", 30) + " " + text(r, "cc", 35), "é", "", "42 ...", "Zq xw", "ТЕСТ один", "İ ß ﬁ"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    got = {g.doc_id: g for g in L.languages_of(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        shares, sure = plain(t or "", model)
        assert {x.lang: x.share for x in got[i].languages} == pytest.approx(shares, abs=2e-3), t
        assert got[i].score == pytest.approx(sure, abs=2e-3)
        assert got[i].lang_pred == (max(shares, key=shares.get) if shares else "und")


def test_shares_of_a_mixture(spark, model):
    r = random.Random(8)
    rows = [(1, text(r, "aa", 300) + "\n" + text(r, "cc", 100)), (2, text(r, "bb", 400))]
    got = {g.doc_id: {x.lang: x.share for x in g.languages} for g in L.languages_of(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["aa"] == pytest.approx(0.75, abs=0.05) and set(got[1]) == {"aa", "cc"}
    assert got[2] == {"bb": 1.0}


def test_long_texts_in_stretches(spark, model, monkeypatch):
    r = random.Random(6)
    long = text(r, "cc", 3000)
    whole = L.mixtures(L.words_of_texts([long], model), 1)[0]
    monkeypatch.setattr(L, "STRETCH", 777)
    parts = L.mixtures(L.words_of_texts([long, "a" * 5000], model), 2)[0]
    assert parts[0] == pytest.approx(whole[0], abs=0.01)


def test_odd_tables(spark):
    cols = "doc_id long, text string, lang string, held_out int, score string"
    assert L.language_id(spark.createDataFrame([], cols)).collect() == []
    rows = [(1, "und so", None, 1, "x"), (None, "und", "de", 1, "x"), (2, None, "de", 1, "x")]
    got = L.language_id(spark.createDataFrame(rows, cols)).collect()
    assert {(g.doc_id, g.lang_pred, g.score) for g in got} == {(1, "und", 0.0), (None, "und", 0.0), (2, "und", 0.0)}
    assert [g.held_out for g in got if g.doc_id is None] == [False]
    same = spark.createDataFrame([(7, "der die das", "de", 1, "x")] * 3 + [(8, "the of and", "en", 1, "x")] * 2, cols)
    assert Counter((g.doc_id, g.lang_pred) for g in L.language_id(same).collect()).total() == 5


def test_more_languages_than_the_model_may_have(spark):
    df = spark.createDataFrame([(i, "a", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 8"):
        L.train(df, most_languages=8)


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    out = [g for g in got if g.held_out]
    assert {g.doc_id for g in out} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(g.lang_pred == truth[g.doc_id] for g in out) / len(out) > 0.95
    assert all(0 <= g.score <= 1 for g in got)
