"""Sub-word tokens equal a public library's with the same vocabulary, and windows a plain slicing of them."""

import random

import pytest
from pyspark.sql import functions as F

from trawl.functions.text import words
from trawl.operators import subword as S

P = pytest.importorskip("public_tokenizers")
NAME = "byte_bpe_50k.tiktoken"


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@pytest.fixture(scope="module")
def ranks():
    return S.read_ranks(P.path(NAME))


@pytest.fixture(scope="module")
def texts(spark, sf):
    out = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    return [*out, "", " ", "  a\n\n b  c's we'll 12three", "日本語のテキスト 🙂🙂 né́", "x" * 3000, "ab" * 2000, "a b" * 400, "\t\t\r\n !!??", "\u0000\u001c"]


def test_merges(ranks):
    r = random.Random(4)
    for _ in range(300):
        piece = "".join(r.choice("abcdetionhé ") for _ in range(r.randrange(1, 40))).encode()
        assert S.merged(piece, ranks) == ([piece] if piece in ranks else plain_merge(piece, ranks))
    toy = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaaa": 257, b"ba": 258}
    assert S.merged(b"aaaaab", toy) == [b"aaaa", b"a", b"b"] and S.merged(b"baa", toy) == [b"b", b"aa"]


def test_ids_are_the_library_s(spark, texts, ranks):
    lib = pytest.importorskip("tiktoken").Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id long, text string")
    got = {r.id: r for r in S.encoded(df, ranks).collect()}
    assert got[-1]._ids == []
    for i, t in enumerate(texts):
        assert got[i]._ids == lib.encode_ordinary(t), t[:50]
        assert (got[i]._ends or [0])[-1] == len(t)


def test_windows_and_clipping(spark, texts, ranks):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x")], "id long, text string, chunk_name string")
    by = {v: k for k, v in ranks.items()}
    coded = {r.id: r._ids for r in S.encoded(df, ranks).collect()}

    def cut(i, first, last):
        """Characters whose first byte lies in tokens first to last - 1."""
        raw = [by[t] for t in coded[i]]
        a, b = sum(map(len, raw[:first])), sum(map(len, raw[:last]))
        at, out = 0, ""
        for c in texts[i]:
            out += c if a <= at < b else ""
            at += len(c.encode())
        return out

    want = set()
    for i, t in enumerate(texts):
        n = len(coded[i])
        starts = [] if not n else [0] if n <= 448 else range(0, n, 336)
        want |= {(i, k, t if n <= 448 else cut(i, s, s + 448), min(448, n - s)) for k, s in enumerate(starts)}
    assert {(r.id, r.chunk_idx, r.text, r.n_tokens) for r in S.subword_windows(df, ranks).collect()} == want
    clipped = {r.id: r.text for r in S.clip_subwords(df, ranks).collect()}
    assert clipped == {-1: None} | {i: t if len(coded[i]) <= 460 else cut(i, 0, 460) for i, t in enumerate(texts)}
    assert {r.id: r.n_tokens for r in S.subword_lengths(df, ranks).collect()} == {i: len(v) for i, v in coded.items()}
    ratio = S.tokens_per_word(df, ranks, F.size(words(F.col("text")))).first()[0]
    assert ratio == pytest.approx(sum(map(len, coded.values())) / sum(len(t.split()) for t in texts), rel=0.01)


def test_batches_are_cut_by_their_pieces(monkeypatch):
    import pyarrow as pa

    from trawl.sources.store import slices

    rows = [["a"] * 3, None, [], ["b"] * 9, ["c"], ["d"] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows, pa.list_(pa.string()))], ["i", "p"])
    assert [b.column(0).to_pylist() for b in slices(batch, 1, 5)] == [[0, 1, 2], [3], [4, 5]]
    assert list(slices(batch.slice(0, 0), 1, 5)) == []
    seen = []
    monkeypatch.setattr(S, "PIECES", 5)
    monkeypatch.setattr(S, "tokens_of", lambda p, ranks: ([1, 2], [1, 1]))
    for b in S._encoding({})(iter([batch])):
        seen.append(b.num_rows)
        assert b.column(1).to_pylist() == [[1, 2] * len(rows[i] or []) for i in b.column(0).to_pylist()]
    assert seen == [3, 1, 2]
