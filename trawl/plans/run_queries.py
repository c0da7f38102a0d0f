"""Queries over runs: dense retrieval, fusion, routing, metrics, intervals, mining, training rows, generation metrics, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.stem import stems, stems_sql
from trawl.operators import diagnose, encode, metrics, mine, nearest, pairs, retrieve, select, stats
from trawl.plans import text_queries as X
from trawl.plans.tables import ascii_words, chunks, gold_counts, load, lower_ascii_words, near_qrels, questions, vector_queries, vectors
from trawl.sources import io
from trawl.sources.order import numbered
from trawl.sources.store import cut

DEPTH = 100
DEPTHS = (20, 50, 100)
#: Nine comparisons: the scorers, fusion with each of them, reranking with what it ranks anew, and its depths.
PAIRS = [("dense", "half"), ("hybrid", "dense"), ("hybrid", "half"), ("rerank@20", "half"), ("rerank@50", "half"), ("rerank@100", "half"), ("rerank@50", "hybrid"), ("rerank@50", "rerank@20"), ("rerank@100", "rerank@50")]

CTE = {
    "q": "SELECT vec_id AS qid, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0",
    "sims": "SELECT qid, vec_id AS chunk_id, list_dot_product(e, embedding::DOUBLE[]) AS score, list_dot_product(e[1:32], embedding[1:32]::DOUBLE[]) AS hscore FROM q JOIN embeddings ON vec_id <> qid",
    "dense": "SELECT 'dense' AS system, qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sims",
    "half": "SELECT 'half' AS system, qid, chunk_id, hscore AS score, row_number() OVER (PARTITION BY qid ORDER BY round(hscore, 9) DESC, chunk_id) AS rank FROM sims",
    "fused": "SELECT qid, chunk_id, sum(1 / (60 + rank)) AS score FROM (SELECT qid, chunk_id, rank FROM dense WHERE rank <= 100 UNION ALL SELECT qid, chunk_id, rank FROM half WHERE rank <= 100) GROUP BY ALL",
    "hybrid": "SELECT 'hybrid' AS system, qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused",
    "reranked": "SELECT 'rerank@' || d AS system, half.qid, half.chunk_id, dense.score, row_number() OVER (PARTITION BY d, half.qid ORDER BY round(dense.score, 9) DESC, half.chunk_id) AS rank FROM half JOIN dense USING (qid, chunk_id), (SELECT unnest([20, 50, 100]) AS d) WHERE half.rank <= d",
    "runs": "SELECT * FROM dense WHERE rank <= 100 UNION ALL SELECT * FROM half WHERE rank <= 100 UNION ALL SELECT * FROM hybrid WHERE rank <= 100 UNION ALL SELECT * FROM reranked",
    "vq": "SELECT qid, vec_id AS chunk_id, CASE WHEN qid % 3 = vec_id % 3 THEN 2 ELSE 1 END AS grade FROM q JOIN embeddings USING (label) WHERE vec_id <> qid",
    "ideal": "SELECT qid, count(*) AS n_gold, sum(CASE WHEN p <= 10 THEN grade / log2(p + 1) END) AS i10, sum(CASE WHEN p <= 20 THEN grade / log2(p + 1) END) AS i20, sum(CASE WHEN p <= 10 THEN (2 ** grade - 1) / log2(p + 1) END) AS x10 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS p FROM vq) GROUP BY qid",
    "hits": "SELECT system, qid, min(CASE WHEN rank <= 10 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) END) AS d10, sum(CASE WHEN rank <= 20 THEN grade / log2(rank + 1) END) AS d20, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END) AS e10, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, count(*) FILTER (rank <= 100) AS h100 FROM runs JOIN vq USING (qid, chunk_id) GROUP BY ALL",
    "per": "SELECT system, qid, round(coalesce(1 / first, 0), 9) AS mrr_10, round(coalesce(d10 / i10, 0), 9) AS ndcg_10, round(coalesce(d20 / i20, 0), 9) AS ndcg_20, round(coalesce(e10 / x10, 0), 9) AS ndcg_exp_10, round(coalesce(h5 / n_gold, 0), 9) AS recall_5, round(coalesce(h10 / n_gold, 0), 9) AS recall_10, round(coalesce(h20 / n_gold, 0), 9) AS recall_20, round(coalesce(h100 / n_gold, 0), 9) AS recall_100 FROM (SELECT DISTINCT qid FROM q) CROSS JOIN (SELECT DISTINCT system FROM runs) LEFT JOIN hits USING (system, qid) LEFT JOIN ideal USING (qid)",
    "vfil": "SELECT vec_id AS chunk_id, vec_id // 25 AS filing, CAST(vec_id % 25 AS INTEGER) AS chunk_idx FROM embeddings",
}


def sql(last: str, *names: str) -> str:
    """As text_queries.sql(), over the expressions of both modules."""
    import re

    both = X.CTE | CTE
    need: set[str] = set()

    def want(name: str) -> None:
        if name not in need:
            need.add(name)
            for k in both:
                if k != name and re.search(rf"\b(?:FROM|JOIN) {k}\b", both[name]):
                    want(k)

    for n in names:
        want(n)
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({both[k]})" for k in both if k in need) + " " + last


def first_half(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.slice("embedding", 1, 32))


def dense_run(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    return retrieve.dense(vector_queries(spark, sf), vectors(spark, sf), k)


def half_run(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    return retrieve.dense(first_half(vector_queries(spark, sf)), first_half(vectors(spark, sf)), k)


def pair_scores(run: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Exact scores of given pairs: what a second scorer is asked for."""
    q = vector_queries(spark, sf).select("qid", F.col("embedding").alias("x"))
    c = vectors(spark, sf).select("chunk_id", F.col("embedding").alias("y"))
    return run.select("qid", "chunk_id").join(q, "qid").join(c, "chunk_id").select("qid", "chunk_id", T.dot(F.col("x"), F.col("y")).alias("score"))


def all_runs(spark: SparkSession, sf: str) -> DataFrame:
    dense, half = cut(dense_run(spark, sf)), cut(half_run(spark, sf))
    hybrid = retrieve.fuse(dense, half, k=DEPTH)
    out = retrieve.depth_sweep(half, pair_scores(retrieve.truncate(half, max(DEPTHS)), spark, sf), DEPTHS).select("system", "qid", "chunk_id", "score", "rank")
    for name, run in (("dense", dense), ("half", half), ("hybrid", hybrid)):
        out = out.unionByName(run.select(F.lit(name).alias("system"), "qid", "chunk_id", "score", "rank"))
    return out


def per_query(spark: SparkSession, sf: str) -> DataFrame:
    runs = cut(all_runs(spark, sf))
    return metrics.per_query(runs, near_qrels(spark, sf, runs), vector_queries(spark, sf), n_gold=gold_counts(spark, sf))


def filings_of_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("chunk_id", F.floor(F.col("chunk_id") / 25).alias("filing"), (F.col("chunk_id") % 25).cast("int").alias("chunk_idx"))


def dense_topk(spark, sf):
    index = nearest.vector_index(vectors(spark, sf))
    return retrieve.dense(vector_queries(spark, sf), None, 10, index=index).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def encoded_topk(spark, sf):
    """From texts to a ranking: chunks and questions encoded by a stand-in for a neural model, then dense retrieval."""
    model = encode.hashed_words(64)
    c = encode.encode(chunks(spark, sf).select("chunk_id", "text"), model)
    q = encode.encode(questions(spark, sf), model)
    return retrieve.dense(q, c, 10).select("qid", "chunk_id", F.round("score", 5).alias("score"), "rank")


def dense_fusion(spark, sf):
    return retrieve.fuse(dense_run(spark, sf), half_run(spark, sf), k=DEPTH).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_routes(spark: SparkSession, sf: str) -> DataFrame:
    """qid, filing: every second query is told the filing of its own vector."""
    return vector_queries(spark, sf).where("qid % 100 = 0").select("qid", F.floor(F.col("qid") / 25).alias("filing"))


def inside_scores(routes: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """qid, chunk_id, score of the vectors of each route's filing."""
    q, c = vector_queries(spark, sf), vectors(spark, sf)
    inside = c.join(filings_of_vectors(spark, sf), "chunk_id").join(routes.withColumnRenamed("qid", "q"), "filing").join(q.select(F.col("qid").alias("q"), F.col("embedding").alias("x")), "q").where("chunk_id <> q")
    return inside.select(F.col("q").alias("qid"), "chunk_id", T.dot(F.col("x"), F.col("embedding")).alias("score"))


def routed_dense(spark, sf):
    """Queries with a route stay in its filing; others search everywhere."""
    q, c, routes = vector_queries(spark, sf), vectors(spark, sf), vector_routes(spark, sf)
    scores = inside_scores(routes, spark, sf)
    rest = retrieve.dense(q.join(routes, "qid", "left_anti"), c, 10).select("qid", "chunk_id", "score", "rank")
    return retrieve.ranked(scores, 10, "qid").unionByName(rest).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def retrieval_metrics(spark, sf):
    return per_query(spark, sf)


def system_table(spark, sf):
    return metrics.means(per_query(spark, sf), "system")


def recall_curve(spark, sf):
    runs = cut(all_runs(spark, sf))
    per = metrics.per_query(runs, near_qrels(spark, sf, runs), vector_queries(spark, sf), (1, 3, 5, 10, 20, 50, 100), (), gold_counts(spark, sf))
    names = [c for c in per.columns if c.startswith("recall")]
    means = per.groupBy("system").agg(*[F.avg(c).alias(c) for c in names])
    return io.unpivot_metrics(means, "system", names).select("system", F.substring("metric", 8, 9).cast("int").alias("k"), F.round("value", 6).alias("recall"))


def bootstrap_numpy(spark, sf):
    return stats.bootstrap(per_query(spark, sf), "ndcg_10")


def delta_pairs(spark, sf):
    return stats.deltas(per_query(spark, sf), "ndcg_10", PAIRS)


def bootstrap_hash(spark, sf):
    return stats.hashed_bootstrap(per_query(spark, sf), "ndcg_10")


def mean_deltas(spark, sf):
    per = per_query(spark, sf).select("system", "qid", "ndcg_10")
    wanted = spark.createDataFrame(PAIRS, "a string, b string")
    a, b = per.select(F.col("system").alias("a"), "qid", F.col("ndcg_10").alias("x")), per.select(F.col("system").alias("b"), "qid", F.col("ndcg_10").alias("y"))
    return a.join(F.broadcast(wanted), "a").join(b, ["b", "qid"]).groupBy("a", "b").agg(F.round(F.avg(F.col("x") - F.col("y")), 6).alias("delta"), F.count_if(F.col("x") > F.col("y")).alias("better"))


def failure_decomposition(spark, sf):
    runs, filings = cut(all_runs(spark, sf)), filings_of_vectors(spark, sf)
    return diagnose.failures(runs, near_qrels(spark, sf, runs, filings=filings), filings, vector_queries(spark, sf))


def rerank_movement(spark, sf):
    runs = cut(all_runs(spark, sf))
    return diagnose.movement(runs.where("system = 'half'"), runs.where("system = 'rerank@50'"), near_qrels(spark, sf, runs))


def circularity(spark, sf):
    named = vector_queries(spark, sf).where("label % 2 = 0")
    return diagnose.circularity(per_query(spark, sf), named)


def dense_first(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    run = cut(dense_run(spark, sf, depth))
    return diagnose.first_ranks(run, near_qrels(spark, sf, run), vector_queries(spark, sf), depth)


def rank_histogram(spark, sf):
    return diagnose.rank_histogram(dense_first(spark, sf, DEPTH), DEPTH)


def rank_histogram_deep(spark, sf):
    """With all ranges of ranks, from a run of depth 1000."""
    return diagnose.rank_histogram(dense_first(spark, sf, 1000), 1000, "beyond")


def ratio_gains(spark, sf):
    return metrics.gains(system_table(spark, sf), "system", "ndcg_10", "half")


def gold_separation(spark, sf):
    return diagnose.separation(dense_first(spark, sf, DEPTH))


def embedding_geometry(spark, sf):
    """Over all pairs of the stated query set."""
    return pairs.pair_geometry(vector_queries(spark, sf), "qid")


def unit_vectors(spark, sf):
    v = T.unit(F.col("embedding"), 1e-9)
    return vectors(spark, sf).select("chunk_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.array_max(v), 6).alias("largest"))


def negatives_basic(spark, sf):
    run = cut(dense_run(spark, sf, 50))
    return mine.basic(run, near_qrels(spark, sf, run), 50, 8)


def by_document(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", F.col("doc_id").alias("filing"), "chunk_idx", "text")


def mining_inputs(spark: SparkSession, sf: str, depth: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(global run, scores within the filings of gold, qrels, corpus), over one stored index."""
    q, c = questions(spark, sf), cut(by_document(spark, sf))
    qrels = cut(X.text_qrels(spark, sf, c))
    index = retrieve.term_index(c, lower_ascii_words)
    score = lambda k, pairs: retrieve.bm25(q, c, k, terms=lower_ascii_words, index=index, pairs=pairs)
    return score(depth, None), score(None, mine.in_filing_pairs(qrels, c)), qrels, c


def banded(spark: SparkSession, sf: str, depth: int = 200, **how) -> DataFrame:
    return mine.banded(*mining_inputs(spark, sf, depth), depth=depth, **how)


def negatives_banded(spark, sf):
    return banded(spark, sf)


def negatives_rerank(spark, sf):
    return banded(spark, sf, depth=100, n_in=4, n_cross=2, band=0.50)


def contrastive_rows(spark, sf):
    return mine.contrastive(negatives_basic(spark, sf), 2, packed=False)


def pairwise_rows(spark, sf):
    return mine.pairwise(negatives_basic(spark, sf), 4)


def triplet_accuracy(spark, sf):
    pairs = mine.contrastive(negatives_basic(spark, sf), 8, packed=False)
    pos = pair_scores(pairs.select("qid", F.col("pos_id").alias("chunk_id")).distinct(), spark, sf).select("qid", F.col("score").alias("pos"))
    neg = pair_scores(pairs.select("qid", F.col("negative").alias("chunk_id")), spark, sf).select("qid", F.col("score").alias("neg"))
    return mine.triplet_accuracy(pos.join(neg, "qid"))


def sft_rows_holdout(spark, sf):
    q = questions(spark, sf)
    asked = numbered(q.select("qid", "text"), "qid", start=1).withColumn("pos", F.col("pos").cast("int"))
    answers = q.select("qid", F.when(F.col("qid") % 7 == 0, " ").otherwise(F.concat(F.lit(" answer "), F.col("qid").cast("string"))).alias("answer"))
    labels = numbered(cut(X.text_qrels(spark, sf)), "qid", "chunk_id", name="file_pos")
    rows = mine.sft_rows(asked, answers, labels, chunks(spark, sf))
    return select.hold_out_last(rows, "pos", 2).select("pos", "question", "context", "answer", "side")


def label_mask(spark, sf):
    w = load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    a = load(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    ids = F.transform(ascii_words(F.col("a")), lambda x: F.length(x))
    return w.join(a, ["conv_id", "turn"]).select("conv_id", "turn", T.label_mask(F.size(ascii_words(F.col("u"))), ids, 64).alias("labels"))


def batch_padding(spark, sf):
    rows = numbered(questions(spark, sf).select("qid", F.transform(ascii_words(F.col("text")), lambda x: F.length(x)).alias("ids")), "qid", name="at")
    return mine.pad_batches(rows, "ids", "at", 16).select("qid", "batch", "input_ids", "attention_mask")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn as the prediction, the assistant's next one as gold."""
    c = load(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.where("role = 'user'").join(a.hint("merge"), ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("prediction"), "gold")


def rouge_n(spark, sf):
    keys = ["conv_id", "turn"]
    return metrics.rouge_n(turns(spark, sf), 1, keys).join(metrics.rouge_n(turns(spark, sf), 2, keys), keys)


def rouge_stemmed(spark, sf):
    keys = ["conv_id", "turn"]
    rows = cut(metrics.stemmed(turns(spark, sf), keys, "prediction", "gold"))
    return metrics.rouge_n(rows, 1, keys).join(metrics.rouge_n(rows, 2, keys), keys)


def word_stems(spark, sf):
    """The different lower-case words of the documents and their stems."""
    return stems(load(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct())


def bleu_13a(spark, sf):
    return metrics.bleu(turns(spark, sf), ["conv_id", "turn"])


def rouge_l_bleu(spark, sf):
    keys = ["conv_id", "turn"]
    rows = metrics.stemmed(turns(spark, sf), keys, "prediction", "gold").withColumn("key", F.concat_ws("-", *keys))
    bleu = metrics.bleu(turns(spark, sf), keys).select(F.concat_ws("-", *keys).alias("key"), "bleu")
    return metrics.sequence_scores(rows, "key").join(bleu.hint("merge"), "key")


def prompts(spark, sf):
    m = T.chat("Answer from the context.", F.col("gold"), F.col("prediction"))
    return turns(spark, sf).select("conv_id", "turn", F.element_at(m, 2)["content"].alias("prompt"), F.size(m).alias("n_messages"))


def results_upsert(spark, sf):
    old = load(spark, sf, "labels").select("doc_id", "quality")
    new = load(spark, sf, "labels").where("toxic = 1").select("doc_id", (F.col("quality") + 10).alias("quality"))
    return io.upsert(old, new, "doc_id")


def results_overlay(spark, sf):
    old = load(spark, sf, "labels").where("toxic = 0").select("doc_id", "quality")
    new = load(spark, sf, "labels").where("quality = 1").select("doc_id", (F.col("quality") + 20).alias("quality"))
    return io.overlay(old, new, "doc_id", "quality")


def trec_lines(spark, sf):
    return io.run_lines(X.bm25_run(spark, sf, 10).withColumn("score", F.round("score", 6)).withColumn("system", F.lit("bm25"))).select("qid", "rank", "line")


def embedding_manifest(spark, sf):
    return io.manifest(vectors(spark, sf), "given", "chunk_id", "chunk_id")


_GRAMS = "SELECT conv_id, turn, unnest({}) AS g FROM (SELECT conv_id, turn, regexp_extract_all(lower({}), '[a-z0-9]+') AS t FROM turns)"
_ONE, _TWO = "t", "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
_TURNS = "turns AS MATERIALIZED (SELECT u.conv_id, u.turn, u.text AS prediction, a.text AS gold FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"


def _rouge(name: str, grams: str) -> str:
    p, g = _GRAMS.format(grams, "prediction"), _GRAMS.format(grams, "gold")
    count = "SELECT conv_id, turn, g, count(*) AS n FROM ({}) GROUP BY ALL"
    return f"{name}p AS ({count.format(p)}), {name}g AS ({count.format(g)}), {name} AS (SELECT conv_id, turn, 2 * sum(least({name}p.n, {name}g.n)) / any_value(tp + tg) AS f FROM {name}p JOIN {name}g USING (conv_id, turn, g) JOIN (SELECT conv_id, turn, sum(n) AS tp FROM {name}p GROUP BY ALL) USING (conv_id, turn) JOIN (SELECT conv_id, turn, sum(n) AS tg FROM {name}g GROUP BY ALL) USING (conv_id, turn) GROUP BY conv_id, turn)"


_TOP = "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM {} WHERE rank <= {}"
_BASIC = "neg AS MATERIALIZED (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM dense WHERE rank <= 50 AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM vq)), pos AS MATERIALIZED (SELECT qid, min(chunk_id) AS pos_id FROM vq GROUP BY qid), basic AS MATERIALIZED (SELECT qid, pos_id, list(chunk_id ORDER BY r) AS negatives FROM neg JOIN pos USING (qid) WHERE r <= 8 GROUP BY ALL)"
_MEANS = "count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("mrr_10", "ndcg_10", "ndcg_20", "ndcg_exp_10", "recall_5", "recall_10", "recall_20", "recall_100"))
_FIRST = "f AS MATERIALIZED (SELECT q.qid, coalesce(min(rank) FILTER (vq.grade IS NOT NULL), 101) AS r, max(score) FILTER (vq.grade IS NOT NULL) AS g, max(score) FILTER (rank = 1) AS t FROM q LEFT JOIN (SELECT * FROM dense WHERE rank <= 100) d ON d.qid = q.qid LEFT JOIN vq ON vq.qid = d.qid AND vq.chunk_id = d.chunk_id GROUP BY q.qid)"


def _banded(depth: int, n_in: int, n_cross: int, band: float, last: str = "SELECT * FROM mined") -> str:
    parts = {
        "own": "SELECT qid, min(doc_id) AS own FROM gold GROUP BY qid",
        "banned": "SELECT DISTINCT g.qid, c.chunk_id FROM gold g JOIN chunks c ON c.doc_id = g.doc_id AND abs(c.chunk_idx - g.chunk_idx) <= 1",
        "cand": f"SELECT qid, chunk_id, score, kind FROM (SELECT b.qid, b.chunk_id, score, unnest(list_filter([CASE WHEN doc_id = own THEN 'in' END, CASE WHEN doc_id <> own AND rank <= {depth} THEN 'cross' END], lambda x: x IS NOT NULL)) AS kind FROM bm_ranked b JOIN chunks USING (chunk_id) JOIN own ON own.qid = b.qid) WHERE (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM banned)",
        "ctok": "SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS term FROM chunks) GROUP BY ALL",
        "gtok": "SELECT qid, term, sum(tf) AS g FROM qrels JOIN ctok USING (chunk_id) GROUP BY ALL",
        "share": "SELECT c.qid, c.chunk_id, sum(least(tf, coalesce(g, 0))) / sum(tf) AS share FROM cand c JOIN ctok USING (chunk_id) LEFT JOIN gtok ON gtok.qid = c.qid AND gtok.term = ctok.term GROUP BY ALL",
        "kept": f"SELECT * FROM (SELECT qid, chunk_id, kind, row_number() OVER (PARTITION BY qid, kind ORDER BY round(score, 9) DESC, chunk_id) AS r FROM cand JOIN share USING (qid, chunk_id) WHERE round(share, 9) < {band}) WHERE r <= CASE WHEN kind = 'in' THEN {n_in} ELSE {n_cross} END",
        "lists": "SELECT qid, list(chunk_id ORDER BY kind = 'cross', r) AS negatives, count(*) FILTER (kind = 'in') AS n_in_filing, count(*) FILTER (kind = 'cross') AS n_cross_filing FROM kept GROUP BY qid",
    }
    parts["mined"] = "SELECT qid, chunk_id AS pos_id, negatives, n_in_filing, n_cross_filing FROM (SELECT *, bool_or(grade = 2) OVER (PARTITION BY qid) AS has2 FROM qrels) JOIN lists USING (qid) WHERE grade = 2 OR NOT has2"
    more = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items())
    return _with(sql("@" + last, "bm_ranked", "gold"), more)


def _with(query: str, more: str) -> str:
    """More expressions before a query's last SELECT, marked by @."""
    return query.replace(") @", f"), {more} ", 1)


def _stemmed_turns() -> str:
    """turns as _TURNS, their texts stemmed."""
    sides = " UNION ALL ".join(f"SELECT conv_id, turn, '{c}' AS c, t[i] AS word, i FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower({c}), '[a-z0-9]+') AS t FROM turns0))" for c in ("prediction", "gold"))
    made = ", ".join(f"coalesce(string_agg(stem, ' ' ORDER BY i) FILTER (c = '{c}'), '') AS {c}" for c in ("prediction", "gold"))
    return f"{_TURNS.replace('turns AS', 'turns0 AS', 1)}, sides AS MATERIALIZED ({sides}), {stems_sql('SELECT DISTINCT word FROM sides')}, turns AS MATERIALIZED (SELECT conv_id, turn, {made} FROM (SELECT conv_id, turn FROM turns0) LEFT JOIN sides USING (conv_id, turn) LEFT JOIN stems USING (word) GROUP BY conv_id, turn)"


def _tokens_13a(text: str) -> str:
    for found, put in metrics.PLAIN_13A:
        text = f"replace({text}, '{found}', '{put}')"
    text = f"' ' || {text} || ' '"
    for pattern, put in metrics.PARTS_13A:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"list_filter(regexp_split_to_array({text}, '[\\s\\x0B\\p{{Z}}]+'), lambda t: t <> '')"


def _grams_13a(side: str) -> str:
    return f"SELECT conv_id, turn, n, array_to_string({side}[i:i + n - 1], ' ') AS x, count(*) AS k FROM (SELECT *, unnest(range(1, greatest(len({side}) - n + 2, 1))) AS i FROM bt, ns) GROUP BY ALL"


_BLEU = f"""WITH {_TURNS}, bt AS MATERIALIZED (SELECT conv_id, turn, {_tokens_13a("prediction")} AS p, {_tokens_13a("gold")} AS g FROM turns), ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
bh AS (SELECT a.conv_id, a.turn, a.n, sum(least(a.k, b.k)) AS h FROM ({_grams_13a("p")}) a JOIN ({_grams_13a("g")}) b USING (conv_id, turn, n, x) GROUP BY ALL),
bo AS (SELECT bt.conv_id, bt.turn, ns.n, len(p) AS lp, len(g) AS lg, len(p) - ns.n + 1 AS there, coalesce(h, 0) AS h FROM bt JOIN ns ON len(p) >= ns.n LEFT JOIN bh ON bh.conv_id = bt.conv_id AND bh.turn = bt.turn AND bh.n = ns.n),
bm AS (SELECT *, count(*) FILTER (h = 0) OVER (PARTITION BY conv_id, turn ORDER BY n) AS missed FROM bo),
bs AS (SELECT conv_id, turn, CASE WHEN sum(h) = 0 THEN 0 ELSE CASE WHEN any_value(lp) < any_value(lg) THEN exp(1 - any_value(lg) / any_value(lp)) ELSE 1 END * exp(avg(CASE WHEN h > 0 THEN ln(h / there) ELSE -ln(2.0::DOUBLE ** missed * there) END)) END AS bleu FROM bm GROUP BY conv_id, turn)
SELECT conv_id, turn, round(coalesce(bleu, 0), 9) AS bleu FROM turns LEFT JOIN bs USING (conv_id, turn)"""

ORACLES = {
    "bleu_13a": _BLEU,
    "word_stems": "WITH " + stems_sql("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents") + " SELECT word, stem FROM stems",
    "rouge_stemmed": f"WITH {_stemmed_turns()}, {_rouge('r1', _ONE)}, {_rouge('r2', _TWO)} SELECT conv_id, turn, round(coalesce(r1.f, 0), 9) AS rouge_1, round(coalesce(r2.f, 0), 9) AS rouge_2 FROM turns LEFT JOIN r1 USING (conv_id, turn) LEFT JOIN r2 USING (conv_id, turn)",
    "dense_topk": sql(_TOP.format("dense", 10), "dense"),
    "dense_fusion": sql(_TOP.format("hybrid", 100), "hybrid"),
    "routed_dense": sql("SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sims WHERE qid % 100 <> 0 OR qid // 25 = chunk_id // 25) WHERE rank <= 10", "sims"),
    "retrieval_metrics": sql("SELECT * FROM per", "per"),
    "system_table": sql(f"SELECT system, {_MEANS} FROM per GROUP BY system", "per"),
    "recall_curve": sql("SELECT s.system, CAST(k AS INTEGER) AS k, round(avg(coalesce(h / n_gold, 0)), 6) AS recall FROM (SELECT qid, system, k FROM (SELECT DISTINCT qid FROM q), (SELECT DISTINCT system FROM runs), (SELECT unnest([1, 3, 5, 10, 20, 50, 100]) AS k)) s LEFT JOIN ideal USING (qid) LEFT JOIN (SELECT system, qid, k, count(*) AS h FROM runs JOIN vq USING (qid, chunk_id), (SELECT unnest([1, 3, 5, 10, 20, 50, 100]) AS k) WHERE rank <= k GROUP BY ALL) USING (system, qid, k) GROUP BY ALL", "runs", "ideal", "q"),
    "bootstrap_hash": sql("SELECT system, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT system, b, avg(ndcg_10) AS m FROM (SELECT b, ((b * 1000003 + j * 7919 + 17) * 48271) % 2147483647 % (SELECT count(*) FROM q) AS place FROM (SELECT unnest(range(200)) AS b), (SELECT unnest(range((SELECT count(*) FROM q))) AS j)) JOIN (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM q) USING (place) JOIN per USING (qid) GROUP BY ALL) GROUP BY system", "per", "q"),
    "mean_deltas": sql("SELECT x.system AS a, y.system AS b, round(avg(x.ndcg_10 - y.ndcg_10), 6) AS delta, count(*) FILTER (x.ndcg_10 > y.ndcg_10) AS better FROM per x JOIN per y USING (qid) WHERE (x.system, y.system) IN (" + ", ".join(map(str, PAIRS)) + ") GROUP BY ALL", "per"),
    "failure_decomposition": sql("SELECT system, outcome, n, round(100 * n / sum(n) OVER (PARTITION BY system), 6) AS pct, round(sum(t) OVER (PARTITION BY system) / sum(n) OVER (PARTITION BY system), 6) AS same_filing_share FROM (SELECT system, outcome, count(*) AS n, sum(s) AS t FROM (SELECT system, qid, CASE WHEN bool_or(grade IS NOT NULL) THEN 'found' WHEN bool_or(home) THEN 'right filing' ELSE 'absent' END AS outcome, avg(CASE WHEN home THEN 1.0::DOUBLE ELSE 0 END) AS s FROM (SELECT system, r.qid, vq.grade, (r.qid, vfil.filing) IN (SELECT (vq.qid, vfil.filing) FROM vq JOIN vfil USING (chunk_id)) AS home FROM runs r JOIN vfil USING (chunk_id) LEFT JOIN vq ON vq.qid = r.qid AND vq.chunk_id = r.chunk_id WHERE rank <= 10) WHERE qid IN (SELECT qid FROM vq) GROUP BY system, qid) GROUP BY system, outcome)", "runs", "vq", "vfil"),
    "rerank_movement": sql("SELECT count(*) FILTER (a AND b) AS kept, count(*) FILTER (a AND NOT b) AS pushed, count(*) FILTER (b AND NOT a) AS pulled FROM (SELECT qid, chunk_id, bool_or(system = 'half') AS a, bool_or(system = 'rerank@50') AS b FROM runs JOIN vq USING (qid, chunk_id) WHERE rank <= 10 AND system IN ('half', 'rerank@50') GROUP BY ALL)", "runs", "vq"),
    "circularity": sql("SELECT system, label % 2 = 0 AS named, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg_10 FROM per JOIN q USING (qid) GROUP BY ALL", "per", "q"),
    "rank_histogram": _with(sql("@SELECT CASE WHEN r > 100 THEN 'missed' WHEN r = 1 THEN '1' WHEN r <= 10 THEN '2-10' WHEN r <= 20 THEN '11-20' ELSE '21-100' END AS ranks, count(*) AS n FROM f GROUP BY ALL", "dense", "vq", "q"), _FIRST),
    "rank_histogram_deep": sql("SELECT CASE WHEN r > 1000 THEN 'beyond' WHEN r = 1 THEN '1' WHEN r <= 10 THEN '2-10' WHEN r <= 20 THEN '11-20' WHEN r <= 100 THEN '21-100' ELSE '101-1000' END AS ranks, count(*) AS n FROM (SELECT q.qid, coalesce(min(rank), 1001) AS r FROM q LEFT JOIN (SELECT qid, rank FROM dense JOIN vq USING (qid, chunk_id) WHERE rank <= 1000) d ON d.qid = q.qid GROUP BY q.qid) GROUP BY ALL", "dense", "vq", "q"),
    "ratio_gains": sql("SELECT system, round(round(avg(ndcg_10), 6) / greatest((SELECT round(avg(ndcg_10), 6) FROM per WHERE system = 'half'), 1e-9), 6) AS gain FROM per GROUP BY system", "per"),
    "gold_separation": _with(sql("@SELECT round(avg(t - g), 6) AS mean_gap, count(g) AS n_found, count(*) FILTER (r BETWEEN 21 AND 100) AS recoverable, count(*) AS n_queries FROM f", "dense", "vq", "q"), _FIRST),
    "embedding_geometry": sql("SELECT count(*) AS n_pairs, round(avg(c), 6) AS mean_cos, round(stddev_pop(c), 6) AS std_cos, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.95), 6) AS p95 FROM (SELECT list_dot_product(a.e, b.e) AS c FROM q a JOIN q b ON a.qid < b.qid)", "q"),
    "unit_vectors": "SELECT vec_id AS chunk_id, round(list_dot_product(v, v), 6) AS norm2, round(list_max(v), 6) AS largest FROM (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))",
    "negatives_basic": _with(sql("@SELECT * FROM basic", "dense", "vq"), _BASIC),
    "negatives_banded": _banded(200, 4, 4, 0.35),
    "negatives_rerank": _banded(100, 4, 2, 0.50),
    "contrastive_rows": _with(sql("@SELECT qid, pos_id, unnest(negatives[1:2]) AS negative FROM basic", "dense", "vq"), _BASIC),
    "pairwise_rows": _with(sql("@SELECT qid, pos_id AS chunk_id, 1.0::DOUBLE AS label FROM basic UNION ALL SELECT qid, unnest(negatives[1:4]), 0.0::DOUBLE FROM basic", "dense", "vq"), _BASIC),
    "triplet_accuracy": _with(sql("@SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(p.score), 6) AS mean_pos, round(avg(n.score), 6) AS mean_neg, count(*) AS n FROM (SELECT qid, pos_id, unnest(negatives) AS neg FROM basic) b JOIN sims p ON p.qid = b.qid AND p.chunk_id = pos_id JOIN sims n ON n.qid = b.qid AND n.chunk_id = neg", "dense", "vq", "sims"), _BASIC),
    "sft_rows_holdout": sql("SELECT pos, text AS question, context, 'answer ' || qid AS answer, CASE WHEN pos >= min(CASE WHEN last <= 2 THEN pos END) OVER () THEN 'test' ELSE 'train' END AS side FROM (SELECT CAST(p.pos AS INTEGER) AS pos, p.qid, p.text, c.text AS context, row_number() OVER (ORDER BY p.pos DESC) AS last FROM (SELECT item_id AS qid, text, row_number() OVER (ORDER BY item_id) AS pos FROM benchmark) p JOIN (SELECT qid, min(chunk_id) AS chunk_id FROM qrels GROUP BY qid) USING (qid) JOIN chunks c USING (chunk_id) WHERE p.qid % 7 <> 0)", "qrels", "chunks"),
    "label_mask": "SELECT u.conv_id, u.turn, list_concat(list_transform(range(len(list_filter(regexp_split_to_array(u.text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))), lambda x: -100), list_transform(list_filter(regexp_split_to_array(a.text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''), lambda x: length(x)))[1:64] AS labels FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
    "batch_padding": "SELECT qid, batch, list_concat(ids, list_transform(range(m - len(ids)), lambda x: 0)) AS input_ids, list_concat(list_transform(ids, lambda x: 1), list_transform(range(m - len(ids)), lambda x: 0)) AS attention_mask FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM (SELECT item_id AS qid, (row_number() OVER (ORDER BY item_id) - 1) // 16 AS batch, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''), lambda x: length(x)) AS ids FROM benchmark))",
    "rouge_n": f"WITH {_TURNS}, {_rouge('r1', _ONE)}, {_rouge('r2', _TWO)} SELECT conv_id, turn, round(coalesce(r1.f, 0), 9) AS rouge_1, round(coalesce(r2.f, 0), 9) AS rouge_2 FROM turns LEFT JOIN r1 USING (conv_id, turn) LEFT JOIN r2 USING (conv_id, turn)",
    "prompts": f"WITH {_TURNS} SELECT conv_id, turn, 'Context:' || chr(10) || gold || chr(10) || chr(10) || 'Question: ' || prediction AS prompt, 2 AS n_messages FROM turns",
    "results_upsert": "SELECT doc_id, CASE WHEN toxic = 1 THEN quality + 10 ELSE quality END AS quality FROM labels",
    "results_overlay": "SELECT doc_id, CASE WHEN quality = 1 THEN 21 ELSE quality END AS quality FROM labels WHERE toxic = 0 OR quality = 1",
    "trec_lines": X.sql("SELECT qid, CAST(rank AS INTEGER) AS rank, qid || ' Q0 ' || chunk_id || ' ' || rank || ' ' || format('{:.6f}', score) || ' bm25' AS line FROM (SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm_ranked WHERE rank <= 10)", "bm_ranked"),
    "embedding_manifest": "SELECT 'given' AS model, count(*) AS n_chunks, max(len(embedding))::BIGINT AS dim, sha1(string_agg(CAST(vec_id AS VARCHAR), '' ORDER BY vec_id)) AS fingerprint FROM embeddings",
}
WITHOUT_SQL = ("bootstrap_numpy", "delta_pairs", "rouge_l_bleu", "encoded_topk")
QUERIES = {name: globals()[name] for name in [*ORACLES, *WITHOUT_SQL]}

