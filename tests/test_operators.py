"""Hand-worked cases and properties of the operators."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import chunk, diagnose, label, metrics, mine, retrieve, select, split, stats
from trawl.sources import io, schemas


@pytest.mark.parametrize("n,want", [(0, []), (1, [0]), (300, [0]), (301, [0, 240]), (480, [0, 240]), (481, [0, 240, 480]), (530, [0, 240, 480]), (721, [0, 240, 480, 720])])
def test_window_starts(spark, n, want):
    assert spark.range(1).select(chunk.window_starts(F.lit(n), 300, 60).alias("v")).first().v == want


def test_chunks_cover_and_overlap(spark):
    text = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([("a", text), ("b", " x  y "), ("c", "")], "id string, text string")
    got = {(r.id, r.chunk_idx): r.text for r in chunk.chunk_words(df, size=4, overlap=1).collect()}
    assert [len(got["a", i].split()) for i in range(4)] == [4, 4, 4, 1] and got["a", 1].split()[0] == "w3"
    assert got["b", 0] == " x  y " and not any(k[0] == "c" for k in got)


def run_of(spark, lists):
    rows = [(s, q, c, 1.0 / r, r) for (s, q), v in lists.items() for r, c in enumerate(v, 1)]
    return spark.createDataFrame(rows, "system string, qid string, chunk_id string, score double, rank int")


def test_fusion(spark):
    r = run_of(spark, {("d", "q"): "abc", ("s", "q"): "bd"})
    got = [(x.chunk_id, round(x.score, 9)) for x in retrieve.fuse(r.where("system = 'd'"), r.where("system = 's'")).orderBy("rank").collect()]
    assert got == [("b", 0.032522475), ("a", 0.016393443), ("d", 0.016129032), ("c", 0.015873016)]


def test_metrics(spark):
    r = run_of(spark, {("s", "q"): "nxym"})
    gold = spark.createDataFrame([("q", "x", 2), ("q", "y", 1), ("q", "z", 1), ("other", "a", 1)], "qid string, chunk_id string, grade int")
    queries = spark.createDataFrame([("q",), ("other",), ("without",)], "qid string")
    got = {x.qid: x for x in metrics.per_query(r, gold, queries).collect()}
    assert got["q"].mrr_10 == 0.5 and round(got["q"].ndcg_10, 6) == 0.562727 and round(got["q"].ndcg_exp_10, 6) == 0.579237 and round(got["q"].recall_5, 6) == round(2 / 3, 6)
    assert got["other"].ndcg_10 == got["without"].recall_100 == 0
    assert metrics.means(metrics.per_query(r, gold, queries), "system").first().mrr_10 == round(0.5 / 3, 6)


def test_bm25(spark):
    corpus = spark.createDataFrame([("d1", "net sales rose net"), ("d2", "sales fell"), ("d3", "costs rose sharply in costs")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "net sales net")], "qid string, text string")
    got = {x.chunk_id: round(x.score, 6) for x in retrieve.bm25(q, corpus, 10).collect()}
    assert got == {"d1": 1.470645, "d2": 0.068805}
    assert retrieve.bm25(q, corpus.limit(0), 10).count() == 0


def test_greedy_coverage():
    e = Counter(total=3, rev=2, net=1)
    cand = [("c1", Counter(total=2, rev=1, foo=9)), ("c2", Counter(total=1, rev=2, net=1)), ("c3", Counter(foo=4))]
    assert label.pick(e, cand, 0.8) == ([("c2", 4), ("c1", 2)], 6)
    assert label.pick(Counter(), cand, 0.8) == ([], 0)
    r = random.Random(1)
    for _ in range(50):
        e = Counter(r.choices("abcdef", k=8))
        cand = [(i, Counter(r.choices("abcdefgh", k=5))) for i in range(6)]
        told = []
        picked, covered = label.pick(e, cand, 0.8, told)
        left, want, open_ = e.copy(), [], list(cand)
        while sum(g for _, g in want) < 0.8 * e.total():
            gain, k = max(((sum(min(n, c[t]) for t, n in left.items()), -i) for i, (_, c) in enumerate(open_)), default=(0, 0))
            if not gain:
                break
            key, c = open_.pop(-k)
            want.append((key, gain))
            left = left - c
        assert picked == want and 6 <= told[0] <= 6 * (len(want) + 1)
        assert covered == sum(g for _, g in picked) and [g for _, g in picked] == sorted((g for _, g in picked), reverse=True)


def test_union_coverage_grades(spark):
    refs = spark.createDataFrame([("r", "q", "total total total rev rev net")], "ref string, qid string, text string")
    corpus = spark.createDataFrame([("c1", "A", "total total rev " + "foo " * 9), ("c2", "A", "total rev rev net"), ("c3", "A", "foo foo"), ("x", "B", "total rev net")], "chunk_id string, filing string, text string")
    resolved = spark.createDataFrame([("q", "A", False)], "qid string, filing string, ambiguous boolean")
    scores = spark.createDataFrame([("r", "c2", 0.9), ("r", "c1", 0.5), ("r", "x", 0.99)], "ref string, chunk_id string, score double")
    got = {x.chunk_id: (x.gain, x.grade) for x in label.union_coverage(scores, refs, corpus, resolved).collect()}
    assert got == {"c2": (4, 2), "c1": (2, 1)}
    labels = label.union_coverage(scores, refs, corpus, resolved).select("qid", "chunk_id", "grade")
    assert label.outside_filing(labels, corpus, resolved).count() == 0


def test_resolution(spark):
    rows = [("a", "x", 2.0), ("a", "y", 1.7), ("b", "x", 2.0), ("b", "y", 1.5), ("c", "x", 1.0)]
    scores = spark.createDataFrame(rows, "ref string, chunk_id string, score double")
    owners = spark.createDataFrame([(k, k) for k in "abc"], "ref string, qid string")
    filings = spark.createDataFrame([("x", "XX"), ("y", "YY")], "chunk_id string, filing string")
    got = label.resolve(scores, owners, filings)
    assert {r.qid: (r.filing, r.ambiguous) for r in got.collect()} == {"a": ("XX", True), "b": ("XX", False), "c": ("XX", False)}
    asked = spark.createDataFrame([("a", "about YY only"), ("b", "XX and YY"), ("new", "YY")], "qid string, text string")
    over = {r.qid: (r.filing, r.ambiguous) for r in label.override(got, asked, filings).collect()}
    assert over == {"a": ("YY", False), "b": ("XX", False), "c": ("XX", False)}


def test_overlap_band(spark):
    corpus = spark.createDataFrame([("g", "alpha beta beta"), ("c", "alpha alpha beta gamma"), ("e", "a b")], "chunk_id string, text string")
    gold = spark.createDataFrame([("q", "g", 2)], "qid string, chunk_id string, grade int")
    cand = spark.createDataFrame([("q", "c"), ("q", "e")], "qid string, chunk_id string")
    assert [(r.chunk_id, r.share) for r in mine.shares(cand, gold, corpus).collect()] == [("c", 0.5)]


def test_adjacency(spark):
    df = spark.createDataFrame([("q", "f", i) for i in (3, 4, 5, 9)], "qid string, filing string, chunk_idx int")
    r = diagnose.adjacency(df).first()
    assert (r.n_runs, r.n_relevant, round(r.adjacent_share, 6)) == (2, 4, round(2 / 3, 6))


def test_splits(spark):
    got = {r.filing for r in split.seeded(spark, [f"F{i}" for i in range(10)]).where("side = 'test'").collect()}
    assert got == {"F3", "F7"}
    sides = spark.createDataFrame([("A", "train"), ("B", "test")], "filing string, side string")
    gold = spark.createDataFrame([("a", "x", 1, "A"), ("b", "y", 1, "B"), ("c", "x", 1, "A"), ("c", "y", 1, "B")], "qid string, chunk_id string, grade int, filing string")
    assert {r.qid: r.side for r in select.assign_sides(gold, sides).collect()} == {"a": "train", "b": "test", "c": "spanning"}
    with pytest.raises(ValueError):
        split.side_tables(gold, gold.select("qid").distinct(), sides)
    q, _ = split.side_tables(gold.where("qid <> 'c'"), gold.select("qid").distinct(), sides)
    assert q.count() == 2
    frozen, drift = split.frozen_or_new(sides, spark, spark.createDataFrame([("A",), ("C",)], "filing string"))
    assert {(r.filing, r.change) for r in drift.collect()} == {("B", "missing"), ("C", "extra")} and frozen is sides


def test_movement(spark):
    r = run_of(spark, {("before", "q"): "ab", ("after", "q"): "bc"})
    gold = spark.createDataFrame([("q", c, 1) for c in "abc"], "qid string, chunk_id string, grade int")
    got = diagnose.movement(r.where("system = 'before'"), r.where("system = 'after'"), gold).first()
    assert (got.kept, got.pushed, got.pulled) == (1, 1, 1)


def test_bootstrap(spark):
    v = [i / 20 for i in range(20)]
    per = spark.createDataFrame([(s, i, x * k) for s, k in (("a", 1.0), ("b", 0.5)) for i, x in enumerate(v)], "system string, qid int, m double")
    got = {r.system: r for r in stats.bootstrap(per, "m").collect()}
    want = np.percentile(stats.resampled_means(np.array(v)), [2.5, 97.5])
    assert [got["a"].lo, got["a"].hi] == pytest.approx(want, rel=1e-12) and got["b"].lo == pytest.approx(want[0] / 2, rel=1e-12)
    d = stats.deltas(per, "m", [("a", "b"), ("a", "a")]).collect()
    assert {(r.a, r.b): r.significant for r in d} == {("a", "b"): True, ("a", "a"): False}
    assert np.isnan(stats.resampled_means(np.array([]), 3)).all()
    assert stats.bootstrap(per.limit(0), "m").count() == 0


@pytest.mark.parametrize("size,n,seed", [(1, 5, 42), (2, 40, 1), (64, 30, 2), (4999, 700, 42), (70_001, 3, 7)])
def test_the_matrix_is_the_generator_s(spark, monkeypatch, size, n, seed):
    """Drawn by tasks that jump into the stream, refused numbers included."""
    monkeypatch.setattr(stats, "STRETCH", 1 << 17)
    monkeypatch.setattr(stats, "BLOCK", 1 << 14)
    g = np.random.default_rng(seed)
    want = [np.bincount(g.integers(0, size, size=size), minlength=size) for _ in range(n)]
    rows = {(r.b, r.block): r.counts for r in stats.resample_counts(spark, size, n, seed, rows=4).collect()}
    got = [np.concatenate([rows[b, k] for k in range(-(-size // (1 << 14)))]) for b in range(n)]
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(got) == n


def test_numbered(spark):
    from trawl.sources.order import numbered

    r = random.Random(2)
    keys = r.sample(range(10_000), 900)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, t string").repartition(7)
    got = {x.k: x.at for x in numbered(df, "k", name="at", start=3).collect()}
    assert got == {k: i + 3 for i, k in enumerate(sorted(keys))}
    assert numbered(df.limit(0), "k").collect() == []


def test_positions_in_files_that_are_split(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 500)):
        (tmp_path / f"{name}.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"{name}{i}\tc\t1\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = io.read_qrels_with_position(spark, str(tmp_path))
        got = [r.qid for r in rows.orderBy("file_pos").collect()]
        assert sorted(r.file_pos for r in rows.collect()) == list(range(4500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"a{i}" for i in range(4000)] + [f"b{i}" for i in range(500)]


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([(i, f"id{i}" if i % 5 else None) for i in range(300)], "o long, i string").repartition(6)
    want = hashlib.sha1("".join(f"id{i}" for i in range(300) if i % 5).encode()).hexdigest()
    assert tuple(io.fingerprint(df, "i", "o").first()) == (want, 300)
    assert tuple(io.fingerprint(df.limit(0), "i", "o").first()) == (hashlib.sha1().hexdigest(), 0)


def test_sequence_metrics():
    r = random.Random(3)
    for _ in range(60):
        a, b = r.choices("abcd", k=r.randrange(9)), r.choices("abcd", k=r.randrange(9))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics.lcs(a, b) == t[-1][-1]


def plain_bleu(p, g):
    """Sentence BLEU by the published formula."""
    logs, missed, used, some = 0.0, 0, 0, 0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, g))
        if not a:
            break
        hits = (a & b).total()
        some += hits
        missed += not hits
        logs += math.log(hits / a.total() if hits else 1 / (2**missed * a.total()))
        used += 1
    return min(1.0, math.exp(1 - len(g) / len(p))) * math.exp(logs / used) if some else 0.0


def test_bleu(spark):
    r = random.Random(3)
    word = ["the", "cat,", "sat", "1,000", "3.5", "a-b", "2-3", "(x)", "&amp;", "É.", "no."]
    split = {"cat,": ["cat", ","], "2-3": ["2", "-", "3"], "(x)": ["(", "x", ")"], "&amp;": ["&"], "É.": ["É", "."], "no.": ["no", "."]}
    rows = [(i, r.choices(word, k=r.randrange(9)), r.choices(word, k=r.randrange(9))) for i in range(80)] + [(90, word, word), (91, word[:3], word)]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, a, b in rows], "k long, prediction string, gold string")
    got = {x.k: x.bleu for x in metrics.bleu(df, ["k"]).collect()}
    parted = lambda ws: [t for w in ws for t in split.get(w, [w])]
    for i, a, b in rows:
        assert got[i] == pytest.approx(plain_bleu(parted(a), parted(b)), abs=1e-9), (a, b)
    assert got[90] == 1.0 and 0 < got[91] < 1


def test_stems(spark):
    from trawl.functions.stem import stems

    want = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
    hissing hiss fizzed fizz failing fail filing file happy happi skies sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal
    decisiveness decis hopefulness hope formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
    goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
    communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die news news
    using use geology geolog the the was was 10k 10k yields yield yearly yearli supplies suppli flies fli died die""".split()
    pairs = dict(zip(want[::2], want[1::2], strict=True))
    got = {r.word: r.stem for r in stems(spark.createDataFrame([(w,) for w in pairs], "word string")).collect()}
    assert got == pairs


def test_stemmed_texts(spark):
    df = spark.createDataFrame([(1, "The hopping CATS, the hopping!", "x", 5), (2, "", None, 6)], "k long, a string, b string, other int")
    got = {r.k: (r.a, r.b, r.other) for r in metrics.stemmed(df, ["k"], "a", "b").collect()}
    assert got == {1: ("the hop cat the hop", "x", 5), 2: ("", "", 6)}


def test_negatives_and_rows(spark):
    r = run_of(spark, {("s", "q"): "abcde", ("s", "all"): "a"})
    gold = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("all", "a", 1)], "qid string, chunk_id string, grade int")
    t = mine.basic(r, gold, 50, 2)
    assert [(x.qid, x.pos_id, x.negatives) for x in t.collect()] == [("q", "a", ["c", "d"])]
    assert mine.contrastive(t, 1, packed=False).first().negative == "c" and mine.contrastive(t, 1).first().negatives == ["c"]
    assert sorted((x.chunk_id, x.label) for x in mine.pairwise(t, 1).collect()) == [("a", 1.0), ("c", 0.0)]
    sides = mine.seeded_holdout(spark, [f"q{i}" for i in range(40)], 0.05)
    assert sides.where("side = 'val'").count() == 2


def test_round_trips(spark, tmp_path):
    gold = spark.createDataFrame([("q", "x", 2), ("r", "y", 1)], schemas.QRELS)
    io.write_qrels(gold, f"{tmp_path}/qrels")
    assert Counter(map(tuple, io.read_qrels(spark, f"{tmp_path}/qrels").collect())) == Counter(map(tuple, gold.collect()))
    (tmp_path / "twice.tsv").write_text("query-id\tcorpus-id\tscore\nq\tx\t1\nq\ty\t1\nq\tx\t2\n")
    assert {(r.chunk_id, r.grade) for r in io.read_qrels(spark, f"{tmp_path}/twice.tsv").collect()} == {("x", 2), ("y", 1)}
    first = select.first_by_position(io.read_qrels_with_position(spark, f"{tmp_path}/twice.tsv"), "qid", "chunk_id", "file_pos")
    assert first.first().chunk_id == "x"
    r = run_of(spark, {("a@50", "q"): "xy", ("b", "q"): "y"})
    io.write_run(r, f"{tmp_path}/runs")
    lines = spark.read.text(f"{tmp_path}/runs")
    assert {(x.system, x.value) for x in lines.collect()} >= {("a_at_50", "q Q0 x 1 1.000000 a@50"), ("b", "q Q0 y 1 1.000000 b")}
    (tmp_path / "m_at_10.trec").write_text("q Q0 y 2 0.5 m\nq Q0 x 2 0.5 m\nq Q0 z 1 0.9 m\n")
    got = io.read_run(spark, f"{tmp_path}/m_at_10.trec").orderBy("rank").collect()
    assert [(x.system, x.chunk_id) for x in got] == [("m@10", "z"), ("m@10", "x"), ("m@10", "y")]
    (tmp_path / "A.html").write_bytes(b"<p>ok\xff</p>")
    assert [tuple(x) for x in io.read_html_folder(spark, str(tmp_path)).collect()] == [("A", "<p>ok</p>")]
    history = spark.createDataFrame([("m", [[1.0, 0.5]], [[2.0, 0.4]])], schemas.LOSS)
    io.write_jsonl(history, f"{tmp_path}/loss")
    assert {tuple(x) for x in io.loss_points(io.read_jsonl(spark, f"{tmp_path}/loss", schemas.LOSS)).collect()} == {("m", "train", 1, 0.5), ("m", "val", 2, 0.4)}
    pred = spark.createDataFrame([("m", ["1"], ["g"], ["b"], ["t"])], schemas.PREDICTIONS)
    assert {tuple(x) for x in io.prediction_rows(pred).collect()} == {("m", "1", "g", "base", "b"), ("m", "1", "g", "qlora", "t")}


def test_guard_and_resume(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], schemas.EMBEDDINGS)
    good = io.manifest(v, "m")
    assert io.guarded(v, good, "m") is v
    for bad in (good.limit(0), good.withColumn("n_chunks", F.lit(9).cast("long"))):
        with pytest.raises(ValueError):
            io.guarded(v, bad, "m")
    todo = spark.createDataFrame([("s", 1, "x"), ("t", 1, "y")], "system string, bucket int, v string")
    path = f"{tmp_path}/parts"
    assert io.unfinished(todo, spark, path, "system", "bucket").count() == 2
    io.write_partitions(todo.where("system = 's'"), path, "system", "bucket")
    assert [r.system for r in io.unfinished(todo, spark, path, "system", "bucket").collect()] == ["t"]
    assert io.markdown_table([{"a": 0.5, "b": "x"}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 0.5000 | x |"
    with pytest.raises(ValueError):
        io.require_empty(io.duplicate_keys(todo.unionByName(todo), "system"), "twice")


def test_rerank_and_routes(spark):
    r = run_of(spark, {("s", "q"): "abc"})
    scores = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.9), ("q", "c", 5.0)], "qid string, chunk_id string, score double")
    assert [x.chunk_id for x in retrieve.rerank(r, scores, 2).orderBy("rank").collect()] == ["b", "a"]
    sweep = retrieve.depth_sweep(r, scores, (1, 3), "x")
    assert {(x.system, x.chunk_id) for x in sweep.where("rank = 1").collect()} == {("x@1", "a"), ("x@3", "c")}
    filings = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "A")], "chunk_id string, filing string")
    routes = spark.createDataFrame([("q", "B")], "qid string, filing string")
    assert [x.chunk_id for x in retrieve.routed(scores, routes, filings, 5).collect()] == ["b"]
    assert retrieve.routed(scores, routes.limit(0), filings, 5).count() == 3
    corpus = spark.createDataFrame([(c, f"text {c}") for c in "abc"], "chunk_id string, text string")
    assert retrieve.contexts(r, corpus, 2).first().context == "text a\n\ntext b"


def test_dense_blocks(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    q = df.where("chunk_id < 7").withColumnRenamed("chunk_id", "qid")
    got = {(r.qid, r.rank): r.chunk_id for r in retrieve.dense(q, df, 5).collect()}
    for i in range(7):
        s = x @ x[i]
        s[i] = -np.inf
        assert [got[i, k] for k in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_stages(spark, tmp_path):
    """Tables that are there are kept, a failing stage stops those that need it alone, and a dry run makes nothing."""
    from trawl.plans.stages import Stage, pending, run_stages

    def broken(s, t):
        raise ValueError("no data")

    stages = [Stage("a", lambda s, t: s.range(3)), Stage("b", broken, ("a",)), Stage("c", lambda s, t: t["b"], ("b",)), Stage("d", lambda s, t: t["a"].where("id > 0"), ("a",))]
    assert [o for _, o in run_stages(spark, stages, str(tmp_path), dry=True)] == ["planned"] * 4
    assert [o for _, o in run_stages(spark, stages, str(tmp_path))] == ["made", "failed: no data", "skipped", "made"]
    assert pending(spark, stages, str(tmp_path)) == ["b", "c"]
    stages[1] = Stage("b", lambda s, t: t["a"], ("a",))
    assert [o for _, o in run_stages(spark, stages, str(tmp_path))] == ["kept", "made", "made", "kept"]
    assert spark.read.parquet(f"{tmp_path}/d").count() == 2


def test_one_json_object(spark, tmp_path):
    import pytest

    from trawl.sources import io

    with pytest.raises(ValueError):
        io.write_json_object(spark.range(2), str(tmp_path / "x"))


def test_seeded_row_holdout(spark):
    rows = list(range(500))
    random.Random(42).shuffle(rows)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "i long, t string").repartition(5)
    got = mine.seeded_row_holdout(df, "i", n=20)
    assert {r.i for r in got.where("side = 'val'").collect()} == set(rows[:20]) and got.count() == 500 and got.columns == ["i", "t", "side"]


def test_encode(spark):
    from trawl.operators import encode

    def maker():
        def model(texts):
            assert len(texts) <= 4 and len(set(texts)) == len(texts)
            return encode.hashed_words(16)()(texts)

        return model

    texts = ["a b", "b a", "a b", "", None, "ü x", *[f"w{i} a" for i in range(9)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, other int").repartition(2)
    got = {r.id: r for r in encode.encode(df, maker, batch=4).collect()}
    plain = encode.hashed_words(16)()
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].embedding is None
            continue
        v = plain([t])[0]
        assert got[i].embedding == pytest.approx(v / (np.linalg.norm(v) or 1), abs=1e-6)
    asked = encode.encode(df.where("id = 0"), maker, queries=True).first().embedding
    assert asked != got[0].embedding
    pairs = spark.createDataFrame([(0, "c0"), (0, "c1"), (1, "c0"), (0, "c0"), (2, "c1")], "qid long, chunk_id string")
    q = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "qid long, text string")
    c = spark.createDataFrame([("c0", "x y"), ("c1", "z")], "chunk_id string, text string")

    def scorer():
        def model(both):
            assert len(set(both)) == len(both)
            return [len(x) * 10 + len(y) for x, y in both]

        return model

    assert {tuple(r) for r in encode.score_pairs(pairs, q, c, scorer).collect()} == {(0, "c0", 13.0), (0, "c1", 11.0), (1, "c0", 13.0)}


def test_gold_that_measures_look_at(spark, tmp_path):
    """Few rows of the gold of large labels, the same metrics as with all of it."""
    from trawl.operators import diagnose, metrics
    from trawl.plans import tables as P

    rows = [(i, [1.0, float(i % 7)], None if i % 97 == 5 else 9 if i == 600 else i % 2) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf, q = str(tmp_path), P.vector_queries(spark, str(tmp_path))
    run = spark.createDataFrame([("s", i, (i * 31 + r * 17) % 2000, 1.0 / r, r) for i in range(0, 2000, 50) for r in range(1, 31)], "system string, qid long, chunk_id long, score double, rank int").where("qid <> chunk_id")
    filings = P.vectors(spark, sf).select("chunk_id", F.floor(F.col("chunk_id") / 25).alias("filing"))
    every, near = P.vector_qrels(spark, sf), P.near_qrels(spark, sf, run, filings=filings)
    assert near.count() < 40 * (30 + 3 * 21 + 20) < every.count()
    assert near.exceptAll(every).count() == 0
    same = lambda f: sorted(map(repr, f(every).collect()))
    for f in (lambda g: metrics.per_query(run, g, q, n_gold=P.gold_counts(spark, sf)), lambda g: metrics.ndcg_of_lists(run, g, q), lambda g: diagnose.first_ranks(run, g, q, 30), lambda g: diagnose.failures(run, g, filings, q), lambda g: g.groupBy("qid").agg(F.min("chunk_id"))):
        assert sorted(map(repr, f(near).collect())) == same(f)
    assert sorted(map(repr, metrics.per_query(run, near, q, n_gold=P.gold_counts(spark, sf)).collect())) == sorted(map(repr, metrics.per_query(run, every, q).collect()))


def test_words_are_made_of_top_chunks_alone(spark, monkeypatch):
    """Coverage splits the texts of candidates, not those of the whole corpus."""
    from trawl.operators import label

    made = spark.sparkContext.accumulator(0)

    def split(text):
        made.add(1)
        return sorted(set(text.split()))

    monkeypatch.setattr(label, "word_set", F.udf(split, "array<string>"))
    corpus = spark.range(2000).selectExpr("concat('c', id) AS chunk_id", "concat('word', id, ' other') AS text")
    refs = spark.createDataFrame([(1, "word5 other"), (2, "word7 none")], "ref long, text string")
    scores = spark.createDataFrame([(1, "c5", 0.9), (1, "c6", 0.8), (2, "c7", 0.7), (2, "c9", 0.1)], "ref long, chunk_id string, score double")
    got = {(r.ref, r.chunk_id): (r.coverage, r.grade) for r in label.graded_by_coverage(scores, refs, corpus, top=2).collect()}
    assert got == {(1, "c5"): (1.0, 2), (1, "c6"): (0.5, 1), (2, "c7"): (0.5, 1)}
    assert made.value < 100
