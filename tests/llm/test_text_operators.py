"""Brute-force versions of the operators on texts, on the smallest tables and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawl.llm import queries as Q
from trawl.llm.mixing import mix
from trawl.llm.packing import pack_documents, plan
from trawl.llm.quality import quality
from trawl.llm.simhash import near_duplicates
from trawl.llm.tokens import TokenCounter, WordTransducer, token_counts

ODD = [None, "", " \n\t ", "a", "x " * 30000, "it's 'Super ''s they've 1234 <|endoftext|>b", "Straße ÉCOLE 日本語 😀 café", "same line here\n" * 40, "one two three four five six seven eight nine ten\n" * 9, "\x1c odd \x85 spaces here"]
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "s" if i % 2 else None, 7, "x") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[8], (None, "a null id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, length int, fp string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_token_counts_match_the_library(spark, sf, odd, empty):
    for df in (documents(spark, sf), odd):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        want = Counter((i, len(t.encode()), len(n), len(n) > 2048) for (i, t), n in zip(texts, library([t for _, t in texts]), strict=True))
        assert Counter(map(tuple, token_counts(df, Q.vocabulary()).collect())) == want
    assert token_counts(empty, Q.vocabulary()).count() == 0


def test_token_counts_of_random_strings():
    r = random.Random(5)
    texts = ["".join(r.choice("abth'es1.é́ßΣ日 😀\n<|> !") for _ in range(r.randrange(300))) for _ in range(300)] + ["ab" * 4000, "<|startoftext|>" * 3]
    c = TokenCounter(open(Q.vocabulary()).read())
    assert c.count(texts) == [len(x) for x in library(texts)]
    c.words.most_states = 10  # all states are dropped between batches
    c.most_labels = 500
    assert c.count(texts) == [len(x) for x in library(texts)]


def test_chunks_compose_whatever_their_length():
    import json

    spec = json.load(open(Q.vocabulary()))["model"]
    w = WordTransducer(spec["vocab"], spec["merges"], "</w>")
    c = TokenCounter(open(Q.vocabulary()).read())
    labels, _ = c.stream("some words and averyveryverylongwordwithoutanyend" * 3 + "\n")
    total = w.gains(labels, 10_000).sum()
    assert all(w.gains(labels, k).sum() == total for k in (1, 2, 3, 7, 64))


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_packing_places_every_piece_once(spark, sf, odd, empty):
    for df in (documents(spark, sf), odd):
        rows = df.collect()
        got = pack_documents(df, Q.vocabulary()).collect()
        want = Counter()
        for r, ids in zip(rows, library([x.text or "" for x in rows]), strict=True):
            ids = [*ids, 0]
            for p, s in enumerate(range(0, len(ids), 2048)):
                part = ids[s : s + 2048]
                want[r.doc_id, p, s, len(part), crc(part)] += 1
        assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
        places = defaultdict(list)
        for g in got:
            places[g.sequence_id].append((g.offset, g.length))
        for v in places.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 2048
        assert len(places) <= -(-sum(g.length for g in got) // 2048) + 1 + sum(g.length > 1024 for g in got)
    assert pack_documents(empty, Q.vocabulary()).count() == 0


def test_plan_uses_exact_complements():
    assert sorted(n for _, n in plan({7: 5, 3: 5}, 10)) == [5]
    assert plan({5: 1, 3: 1, 2: 1}, 10) == [((5, 3, 2), 1)]
    assert plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    r = random.Random(2)
    for _ in range(200):
        counts = {k: r.randrange(1, 6) for k in r.sample(range(1, 41), r.randrange(1, 20))}
        got = plan(counts, 40)
        used = Counter()
        for lengths, n in got:
            assert sum(lengths) <= 40
            for x in lengths:
                used[x] += n
        assert used == counts
        total = sum(k * n for k, n in counts.items())
        assert sum(n for _, n in got) <= 2 * -(-total // 40)


def simhash(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(links, nodes):
    """The nodes of each node's component."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    out = defaultdict(list)
    for n in nodes:
        out[top(n)].append(n)
    return {n: out[top(n)] for n in nodes}


def test_simhash_components(spark, sf, odd, empty):
    near = [(1000 + i, " ".join(f"w{j if j != 7 * i else -i}" for j in range(400)), "s") for i in range(30)]
    more = documents(spark, sf).select("doc_id", "text", "source").union(spark.createDataFrame(near, "doc_id long, text string, source string"))
    for df in (more, odd.select("doc_id", "text", "source")):
        rows = df.collect()
        fps = [simhash(r.text or "") for r in rows]
        n = range(len(rows))
        groups = reach([(i, j) for i in n for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], n)
        want = Counter((r.doc_id, f"{fps[i]:016x}", min((rows[j].doc_id for j in groups[i] if rows[j].doc_id is not None), default=None)) for i, r in enumerate(rows))
        assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in near_duplicates(df).collect()) == want
    assert near_duplicates(empty).count() == 0


def test_blocks_and_long_runs_lose_no_link(spark, monkeypatch):
    from trawl.llm import simhash as S

    r = random.Random(3)
    seeds = [r.getrandbits(63) for _ in range(5)]
    fps = list({s ^ sum(1 << b for b in r.sample(range(63), r.randrange(5))) for s in seeds for _ in range(150)} | {r.getrandbits(63) for _ in range(500)})
    want = reach([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4], fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block, short in ((4096, 48), (20, 48), (4096, 4)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "SHORT", short)
        edges = [(e.a, e.b) for e in S.link_edges(df).collect()]
        assert len(edges) <= 15 * len(fps) * (1 if block > 20 else 40)
        got = reach(edges, fps)
        assert all(sorted(got[f]) == sorted(want[f]) for f in fps)


def test_points_bound_the_distance_and_every_spare_finds_all(spark):
    from trawl.llm import simhash as S

    r = random.Random(5)
    fps = [r.getrandbits(63) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 5))) for f in fps]
    p = S.points(np.array(fps, np.int64))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            far = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
            assert int(np.bitwise_count(p[i] ^ p[j])) == far <= (a ^ b).bit_count()
    assert S.spare_groups(10) == 2 and S.spare_groups(1 << 27) == 3 and S.spare_groups(1 << 40) <= 8
    want = reach([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4], fps)
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    for spare in (2, 3, 4):
        got = reach([(e.a, e.b) for e in S.link_edges(df, 4, spare).collect()], fps)
        assert all(sorted(got[f]) == sorted(want[f]) for f in fps)


def test_clashing_names_change_nothing(spark, sf):
    """Further columns that are called like results or like an operator's own columns."""
    from trawl.llm.tokens import token_counts

    plain = documents(spark, sf)
    more = plain
    for k, c in enumerate(["fp", "fingerprint", "component_id", "kept", "host", "h", "n", "removed", "removed_words", "n_words", "_row", "_text", "_hash", "hash", "size", "target", "taken", "times", "_s", "piece", "length", "_salt", "_rank", "_id", "n_tokens"]):
        more = more.withColumn(c, F.lit(k))
    for op in (near_duplicates, quality, mix, lambda d: pack_documents(d, Q.vocabulary()).select("doc_id", "piece", "ids_crc32"), lambda d: token_counts(d, Q.vocabulary())):
        assert Counter(map(tuple, op(more).collect())) == Counter(map(tuple, op(plain).collect()))


def test_other_vocabularies_are_encoded_whole():
    """Where white space doesn't part tokens, ids are the library's for whole texts."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from trawl.llm.packing import WordIds

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with open(P.path(name), encoding="utf-8") as f:
            spec = f.read()
        texts = ["Two  blanks and a\nline, it's fine", "", "  x", "été 東京 12"]
        want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
        assert WordIds(spec).encode(texts) == want


def base(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def line_key(line):
    return re.sub("[\x20\x09-\x0d]+", " ", line).strip(" ").lower()


def judged(rows, share=0.1, least_texts=20, least_words=20):
    texts, holders = defaultdict(set), defaultdict(set)
    for r in rows:
        t = r.text or ""
        texts[r.source].add(t)
        for line in t.split("\n"):
            if WORD.search(line):
                holders[r.source, line_key(line)].add(t)
    above = {k for k, v in holders.items() if len(v) >= least_texts and len(v) > share * len(texts[k[0]])}
    return above


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_quality_rules(spark, sf, odd, empty, monkeypatch, broadcast):
    from trawl.llm import quality as Q6

    monkeypatch.setattr(Q6, "MOST_LINES", broadcast)
    common = "the very same footer line that everybody has on every single page of this site whatever it says over there\n"
    made = [(5000 + i, common * (1 + i % 2) + (f"only {i} words" if i % 3 else " ".join(f"u{i}x{j}" for j in range(40))), "host") for i in range(90)]
    more = documents(spark, sf).select("doc_id", "text", "source").union(spark.createDataFrame(made, "doc_id long, text string, source string"))
    for df in (more, odd.select("doc_id", "text", "source")):
        rows = df.collect()
        above = judged(rows)
        firsts = {}
        for r in rows:
            for line in (r.text or "").split("\n"):
                k = (r.source, line_key(line))
                if WORD.search(line) and k in above and r.doc_id is not None:
                    firsts[k] = min(firsts.get(k, r.doc_id), r.doc_id)
        want = Counter()
        for r in rows:
            t = r.text or ""
            m = base(t)
            failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
            gone = sum(len(WORD.findall(x)) for x in t.split("\n") if WORD.search(x) and (k := (r.source, line_key(x))) in above and firsts.get(k) != r.doc_id)
            want[(r.doc_id, *m, failed, not failed and m[0] - gone >= 20, gone)] += 1
        got = Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept, g.removed_words) for g in quality(df).collect())
        assert got == want
    kept = {r.doc_id: r.kept for r in quality(more).collect()}
    assert kept[5000] and kept[5006] and not kept[5002]
    assert quality(empty).count() == 0


def filled(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing_comes_near_its_targets(spark, sf, odd, empty):
    for df in (documents(spark, sf), odd.select("doc_id", "text", "source")):
        got = mix(df).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, mix(df.repartition(5)).collect()))
        by, size, most = Counter(), Counter(), Counter()
        for g in got:
            by[g.source] += g.taken
            size[g.source] += g.size
            most[g.source] = max(most[g.source], g.size)
            assert g.taken in (0, g.size, 2 * g.size)
        want = filled(size)
        for g in got:
            assert g.source_size == size[g.source] and abs(g.target - want[g.source]) < 1e-6 * (1 + g.target)
        for s in size:
            assert abs(by[s] - want[s]) <= max(1, most[s] * (1 if df is not None and s else 2))
    assert mix(empty).count() == 0
