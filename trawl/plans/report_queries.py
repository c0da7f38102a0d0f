"""Queries over files that are written and read back, over filters, windows of tokens, mining reports and cross-checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import chunk, label, metrics, mine, retrieve, select, split, subword
from trawl.plans import run_queries as R
from trawl.plans import text_queries as X
from trawl.plans.stages import Stage, run_stages
from trawl.plans.tables import chunks, gold_counts, load, near_qrels, questions, vector_qrels, vector_queries, vectors
from trawl.sources import io, schemas
from trawl.sources.store import cut, shared_dir

#: Labels of either grade for each file that one task sorts and writes.
FILE_ROWS = 3_000_000
#: What weighted_pairs leaves out.
STOP = T.ENGLISH_STOP_WORDS


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- files ---------------------------------------------------------------------


def jsonl_round_trip(spark, sf):
    path = folder(spark, "queries")
    io.write_jsonl(questions(spark, sf).select(F.col("qid").cast("string").alias("_id"), "text"), path)
    return io.read_jsonl(spark, path, schemas.QUERIES).select(F.col("_id").alias("qid"), "text")


def qrels_round_trip(spark, sf):
    path = folder(spark, "qrels")
    io.write_qrels(vector_qrels(spark, sf), path)
    return io.read_qrels(spark, path)


def gold_sets(spark, sf):
    """How many different chunks are gold for each query, grades dropped."""
    path = folder(spark, "qrels")
    io.write_qrels(vector_qrels(spark, sf), path)
    return select.histogram(io.gold_sets(io.read_qrels(spark, path)), "qid")


def first_gold(spark, sf):
    """A query's gold that stands first in files ordered by grade, one after the other."""
    path = folder(spark, "qrels")
    order = ["qid", F.desc("chunk_id")]
    files = -(-(gold_counts(spark, sf).agg(F.sum("n_gold")).first()[0] or 1) // FILE_ROWS)
    io.write_qrels(vector_qrels(spark, sf).where("grade = 2").repartitionByRange(files, *order).sortWithinPartitions(*order), path)
    return select.first_by_position(io.read_qrels_with_position(spark, path), "qid", "chunk_id", "file_pos")


def run_round_trip(spark, sf):
    path = folder(spark, "runs")
    io.write_run(R.dense_run(spark, sf, 10).select(F.lit("dense@10").alias("system"), "qid", "chunk_id", F.round("score", 6).alias("score")), path)
    return io.read_run(spark, path)


def frozen_split(spark, sf):
    """A split kept as a JSON object, read again and used although filings are gone since."""
    path = folder(spark, "split")
    io.write_json_object(io.split_object(split.by_hash(chunks(spark, sf)), 42, 0.2), path)
    kept = io.split_sides(io.read_json_object(spark, path, schemas.SPLIT))
    return split.frozen_or_new(kept, spark, load(spark, sf, "documents").where("lang = 'en'").select(F.col("source").alias("filing")))[0]


def split_object(spark, sf):
    path = folder(spark, "split")
    io.write_json_object(io.split_object(split.by_hash(chunks(spark, sf)), 42, 0.2), path)
    return io.read_json_object(spark, path, schemas.SPLIT)


def result_rows(spark, sf):
    path = folder(spark, "results")
    means = load(spark, sf, "labels").groupBy(F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("system")).agg(F.round(F.avg("toxic"), 6).alias("toxic"), F.count("*").alias("n"))
    io.write_jsonl(means, path)
    return io.read_results(spark, path, "system", ["toxic", "n"])


def stats_object(spark, sf):
    path = folder(spark, "stats")
    io.write_json_object(load(spark, sf, "conversations").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"), F.max("turn").alias("last_turn")), path)
    return io.read_json_object(spark, path, schemas._of(n=schemas.L, n_conversations=schemas.L, last_turn=schemas.L))


def resumed(spark, sf):
    """The sources that are still to be done after some were written."""
    path = folder(spark, "parts")
    todo = load(spark, sf, "documents").groupBy(F.col("source").alias("filing")).agg(F.count("*").alias("n"))
    io.write_partitions(todo.where("filing < 'src2'"), path, "filing")
    return io.unfinished(todo, spark, path, "filing")


def staged_counts(spark, sf):
    """chunk_counts by a plan of two stages, the second of which reads what the first has written."""
    root = folder(spark, "stages")
    plan = [Stage("chunks", lambda s, _: chunks(s, sf)), Stage("counts", lambda s, t: t["chunks"].groupBy("filing").agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words")), ("chunks",))]
    failed = [o for o in run_stages(spark, plan, root) if o[1] != "made"]
    if failed:
        raise RuntimeError(f"stages not made: {failed}")
    return spark.read.parquet(f"{root}/counts")


def loss_points(spark, sf):
    """Regions stand for models, their nations' keys for steps."""
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    pair = F.array(F.col("n_nationkey").cast("double"), F.length("n_name").cast("double"))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("model"))
    return io.loss_points(rows.agg(F.collect_list(F.when(F.col("n_nationkey") < 15, pair)).alias("train"), F.collect_list(F.when(F.col("n_nationkey") >= 15, pair)).alias("val")))


def prediction_rows(spark, sf):
    """Conversations stand for models: a turn's text, its beginning and its capitals for gold and two predictions."""
    path = folder(spark, "predictions")
    at = lambda c, name: F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("v")))), lambda x: x["v"]).alias(name)
    rows = load(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("model"))
    text = F.col("text")
    rows.agg(at(F.col("turn").cast("string"), "ids"), at(text, "gold"), at(F.substring(text, 1, 20), "base"), at(F.concat(F.lit("A: "), text), "qlora")).write.parquet(path)
    return io.prediction_rows(spark.read.schema(schemas.PREDICTIONS).parquet(path))


# --- text ----------------------------------------------------------------------


def undecodable_bytes(spark, sf):
    """Texts with bytes around them that are no UTF-8."""
    broken = F.concat(F.unhex(F.lit("FF41C3")), F.col("text").cast("binary"), F.unhex(F.lit("EFBFBD80")))
    return load(spark, sf, "documents").select("doc_id", T.strip_undecodable(broken).alias("text"))


def html_hostile(spark, sf):
    """Texts between markup that a pattern of <, anything and > would get wrong."""
    clean = F.regexp_replace("text", "[<&]", " ")
    before, behind = "<p title=\"a>b\" alt='1>0' x=y>", "</p><!-- <b> > --><SCRIPT type=\"a>b\">if (a < b) \"</p>\"</script > &eacute b<br/>&copy 1 &#150; 2 < 3<style>p > a"
    return load(spark, sf, "documents").select("doc_id", T.html_to_text(F.concat(F.lit(before), clean, F.lit(behind))).alias("text"))


def references_decoded(spark, sf):
    # before a letter or # the & is written as a reference too, as it would begin one with what the text has there
    last = F.when(F.col("text").rlike("^[#A-Za-z]"), "&amp;").otherwise("&")
    coded = F.concat(F.lit("&lt;&#8364;&#x41;&eacute;&amp;amp;&nothing;"), last, F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")))
    return load(spark, sf, "documents").select("doc_id", T.decode_references(coded).alias("text"))


def model_slugs(spark, sf):
    name = F.concat(F.lit("Hub/"), F.upper("lang"), F.lit("-0.5."), F.upper("source"))
    return load(spark, sf, "documents").select(T.model_slug(name).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


def token_windows(spark, sf):
    """Windows of 448 word tokens, each sharing 112 with the one before."""
    out = chunk.chunk_words(load(spark, sf, "documents").select("doc_id", "text"), "text", 448, 112, T.tokens)
    return out.select("doc_id", "chunk_idx", "text", F.col("n_words").alias("n_tokens"))


def ranks() -> subword.Ranks:
    """The vocabulary that the sub-word queries use, a public file; another one is a parameter."""
    import public_tokenizers

    return subword.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def subword_lengths(spark, sf):
    return subword.subword_lengths(load(spark, sf, "documents").select("doc_id", "text"), ranks())


def subword_windows(spark, sf):
    """Windows of 448 sub-word tokens, each sharing 112 with the one before, as the text has them."""
    return subword.subword_windows(load(spark, sf, "documents").select("doc_id", "text"), ranks())


def subword_clipped(spark, sf):
    return subword.clip_subwords(load(spark, sf, "documents").select("doc_id", "text"), ranks())


def subword_ratio(spark, sf):
    out = subword.tokens_per_word(load(spark, sf, "documents"), ranks(), T.word_count(F.col("text")))
    return out.select(F.round("tokens_per_word", 6).alias("tokens_per_word"))


def weighted_pairs(spark, sf):
    """tfidf_align over words without stop words and pairs of neighbours, the vocabulary capped."""
    best = retrieve.capped_topk(questions(spark, sf).withColumnRenamed("qid", "ref"), chunks(spark, sf), T.analysed, 1, least=0.30)
    return label.align(best).select("ref", "chunk_id", F.round("score", 6).alias("score"))


# --- filters, labels, splits ---------------------------------------------------


def answers(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    return q.select("qid", F.when(F.col("qid") % 7 == 0, " ").otherwise(F.concat(F.lit("answer "), F.col("qid").cast("string"))).alias("answer"))


def answerable(spark, sf):
    return select.with_gold_and_answer(questions(spark, sf), X.text_qrels(spark, sf), answers(spark, sf)).select("qid")


def first_with_gold(spark, sf):
    """The first five questions that have gold, a quick look by design."""
    return select.first_n(select.with_gold(questions(spark, sf), X.text_qrels(spark, sf)), "qid", 5).select("qid")


def resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scores, c = X.weighted(spark, sf)
    return label.resolve(scores, X.owners(spark, sf), c), c


def unambiguous(spark, sf):
    return select.without_ambiguous(questions(spark, sf), resolved(spark, sf)[0]).select("qid")


def labels_elsewhere(spark, sf):
    """Labels outside the filing that their question resolves to; none if labels were made within it."""
    at, c = resolved(spark, sf)
    return label.outside_filing(X.text_qrels(spark, sf), c, at)


def gold_neighbours(spark, sf):
    rows = X.gold(spark, sf).select("qid", F.col("doc_id").alias("filing"), "chunk_idx")
    return select.neighbours(rows).join(R.by_document(spark, sf).select("filing", "chunk_idx", "chunk_id"), ["filing", "chunk_idx"]).select("qid", "chunk_id")


def side_grades(spark, sf):
    """Labels of each side with their grades, of gold in a question's own filing."""
    c = chunks(spark, sf)
    inside = mine.own_filings(X.text_qrels(spark, sf), c)
    rows = X.gold(spark, sf).join(inside, "qid").where("filing = own").select("qid", "chunk_id", "grade", "filing")
    return split.side_tables(rows, questions(spark, sf), split.by_hash(c))[0].select("qid", "chunk_id", "grade", "side")


def row_holdout(spark, sf):
    rows = R.pairwise_rows(spark, sf).withColumn("key", F.concat_ws("/", "qid", "chunk_id"))
    return mine.row_holdout(rows, "key", 10).select("key", "side")


# --- mining --------------------------------------------------------------------


def overlap_shares(spark, sf):
    return mine.shares(X.bm25_run(spark, sf, 10), X.text_qrels(spark, sf), chunks(spark, sf)).select("qid", "chunk_id", F.round("share", 9).alias("share"))


def band_counters(spark, sf):
    run, inside, qrels, c = R.mining_inputs(spark, sf, 200)
    return mine.band_counters(mine.candidates(run, inside, qrels, c), qrels, c)


def mining_report(spark, sf):
    return mine.report(R.negatives_rerank(spark, sf), 4, 2)


def negatives_half(spark, sf):
    """Negatives of another retriever: its first six of the top 50."""
    run = cut(R.half_run(spark, sf, 50))
    return mine.basic(run, near_qrels(spark, sf, run), 50, 6)


# --- runs ----------------------------------------------------------------------


def ndcg_check(spark, sf):
    run = cut(R.dense_run(spark, sf))
    return metrics.ndcg_of_lists(run, near_qrels(spark, sf, run), vector_queries(spark, sf))


def routed_subset(spark, sf):
    routes = R.vector_routes(spark, sf)
    runs = [r.select(F.lit(name).alias("system"), "qid", "chunk_id", "score", "rank") for name, r in (("dense", R.dense_run(spark, sf)), ("routed", retrieve.ranked(R.inside_scores(routes, spark, sf), R.DEPTH, "qid")))]
    both = cut(runs[0].unionByName(runs[1]))
    return metrics.routed_means(metrics.per_query(both, near_qrels(spark, sf, both), vector_queries(spark, sf), n_gold=gold_counts(spark, sf)), routes)


def two_rerankers(spark, sf):
    """One list of candidates by two scorers: whole vectors, and their second halves."""
    top = retrieve.truncate(R.half_run(spark, sf), 20)
    whole = R.pair_scores(top, spark, sf)
    q = vector_queries(spark, sf).select("qid", F.slice("embedding", 33, 32).alias("x"))
    c = vectors(spark, sf).select("chunk_id", F.slice("embedding", 33, 32).alias("y"))
    second = top.select("qid", "chunk_id").join(q, "qid").join(c, "chunk_id").select("qid", "chunk_id", T.dot(F.col("x"), F.col("y")).alias("score"))
    runs = [retrieve.rerank(top, s, 20).select(F.lit(name).alias("system"), "qid", "chunk_id", F.round("score", 6).alias("score"), "rank") for name, s in (("whole", whole), ("second", second))]
    return runs[0].unionByName(runs[1])


def greedy_match(spark, sf):
    """Vectors of one filing with even ids as the tokens of a prediction, with odd ids as those of its gold."""
    rows = vectors(spark, sf).join(R.filings_of_vectors(spark, sf), "chunk_id")
    side = lambda k: F.collect_list(F.when(F.col("chunk_id") % 2 == k, F.col("embedding")))
    both = rows.groupBy("filing").agg(side(0).alias("p"), side(1).alias("g"))
    m = both.select("filing", T.greedy_match(F.col("p"), F.col("g")).alias("m"))
    return m.select("filing", *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")])


_SIDE = "CASE WHEN ('0x' || substring(md5({0}), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END"
_SPLIT = f"SELECT DISTINCT source AS filing, {_SIDE.format('source')} AS side FROM documents"
_ONE = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]+'), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{s}'" for s in STOP) + "))"
_TERMS = "unnest(list_concat(v, list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])))"
_IDF = "(ln((1 + (SELECT count(*) FROM chunks)) / (1 + df)) + 1)"
_PAIRS = {
    "pp": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, {_TERMS} AS term FROM (SELECT chunk_id, {_ONE} AS v FROM chunks)) GROUP BY ALL",
    "pd": "SELECT term, count(*) AS df FROM pp GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 200000",
    "pw": f"SELECT chunk_id, term, tf * {_IDF} AS w FROM pp JOIN pd USING (term)",
    "pn": "SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM pw GROUP BY chunk_id",
    "pq": f"SELECT ref, term, tf * {_IDF} AS w FROM (SELECT ref, term, count(*) AS tf FROM (SELECT ref, {_TERMS} AS term FROM (SELECT item_id AS ref, {_ONE} AS v FROM benchmark)) GROUP BY ALL) JOIN pd USING (term)",
    "pm": "SELECT ref, sqrt(sum(w * w)) AS norm FROM pq GROUP BY ref",
    "ps": "SELECT ref, chunk_id, sum(pq.w / pm.norm * (pw.w / pn.norm)) AS score FROM pq JOIN pm USING (ref) JOIN pw USING (term) JOIN pn USING (chunk_id) GROUP BY ref, chunk_id",
}
_CTOK = "ctok AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS term FROM chunks) GROUP BY ALL), gtok AS MATERIALIZED (SELECT qid, term, sum(tf) AS g FROM qrels JOIN ctok USING (chunk_id) GROUP BY ALL)"
_ROUTED = "SELECT * FROM dense WHERE rank <= 100 UNION ALL SELECT 'routed' AS system, qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sims WHERE qid // 25 = chunk_id // 25 AND qid % 100 = 0"

ORACLES = {
    "jsonl_round_trip": "SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark",
    "qrels_round_trip": R.sql("SELECT CAST(qid AS VARCHAR) AS qid, CAST(chunk_id AS VARCHAR) AS chunk_id, grade FROM vq", "vq"),
    "gold_sets": R.sql("SELECT CAST(qid AS VARCHAR) AS qid, count(DISTINCT chunk_id) AS n FROM vq GROUP BY vq.qid", "vq"),
    "first_gold": R.sql("SELECT CAST(qid AS VARCHAR) AS qid, CAST(max(chunk_id) AS VARCHAR) AS chunk_id FROM vq WHERE grade = 2 GROUP BY vq.qid", "vq"),
    "run_round_trip": R.sql("SELECT 'dense@10' AS system, CAST(qid AS VARCHAR) AS qid, CAST(chunk_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY dense.qid ORDER BY round(score, 6) DESC, dense.chunk_id) AS rank, round(score, 6) AS score FROM dense WHERE rank <= 10", "dense"),
    "frozen_split": _SPLIT,
    "split_object": f"SELECT CAST(42 AS BIGINT) AS seed, 0.2::DOUBLE AS test_frac, list(filing ORDER BY filing) FILTER (side = 'train') AS train, list(filing ORDER BY filing) FILTER (side = 'test') AS test FROM ({_SPLIT})",
    "result_rows": "WITH m AS (SELECT 'quality' || quality AS system, round(avg(toxic), 6) AS toxic, count(*)::DOUBLE AS n FROM labels GROUP BY quality) SELECT system, 'toxic' AS metric, toxic AS value FROM m UNION ALL SELECT system, 'n', n FROM m",
    "stats_object": "SELECT count(*) AS n, count(DISTINCT conv_id) AS n_conversations, max(turn) AS last_turn FROM conversations",
    "resumed": "SELECT source AS filing, count(*) AS n FROM documents GROUP BY source HAVING source >= 'src2'",
    "staged_counts": X.ORACLES["chunk_counts"],
    "loss_points": "SELECT r_name AS model, CASE WHEN n_nationkey < 15 THEN 'train' ELSE 'val' END AS series, CAST(n_nationkey AS BIGINT) AS step, length(n_name)::DOUBLE AS loss FROM nation JOIN region ON n_regionkey = r_regionkey",
    "prediction_rows": "SELECT CAST(conv_id AS VARCHAR) AS model, CAST(turn AS VARCHAR) AS qid, text AS gold, unnest(['base', 'qlora']) AS system, unnest([substring(text, 1, 20), 'A: ' || text]) AS prediction FROM conversations",
    "undecodable_bytes": "SELECT doc_id, 'A' || text || chr(65533) AS text FROM documents",
    "html_hostile": "SELECT doc_id, trim(trim(regexp_replace(regexp_replace(text, '[<&]', ' ', 'g'), '[\\s\\x0B\\p{Z}]+', ' ', 'g')) || ' é b © 1 – 2 < 3') AS text FROM documents",
    "references_decoded": "SELECT doc_id, '<€Aé&amp;¬hing;&' || text AS text FROM documents",
    "model_slugs": "SELECT lower(lang) || '-0-5-' || lower(source) AS slug, count(*) AS n FROM documents GROUP BY ALL",
    "token_windows": "SELECT doc_id, CAST(i // 336 AS INTEGER) AS chunk_idx, CASE WHEN len(t) <= 448 THEN text ELSE array_to_string(t[i + 1:i + 448], ' ') END AS text, CAST(len(t[i + 1:i + 448]) AS INTEGER) AS n_tokens FROM (SELECT doc_id, text, t, unnest(CASE WHEN len(t) = 0 THEN []::BIGINT[] WHEN len(t) <= 448 THEN [0]::BIGINT[] ELSE range(0, len(t), 336) END) AS i FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents))",
    "weighted_pairs": R._with(X.sql("@SELECT ref, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ps) WHERE rank = 1 AND round(score, 9) >= 0.3", "chunks"), ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in _PAIRS.items())),
    "answerable": X.sql("SELECT DISTINCT qid FROM qrels WHERE qid % 7 <> 0", "qrels"),
    "first_with_gold": X.sql("SELECT DISTINCT qid FROM qrels ORDER BY qid LIMIT 5", "qrels"),
    "unambiguous": X.sql("SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM resolved WHERE ambiguous)", "resolved"),
    "labels_elsewhere": X.sql("SELECT gold.qid, gold.chunk_id, gold.filing, resolved.filing AS own FROM gold LEFT JOIN resolved USING (qid) WHERE gold.filing IS DISTINCT FROM resolved.filing", "gold", "resolved"),
    "gold_neighbours": X.sql("SELECT DISTINCT gold.qid, chunks.chunk_id FROM gold JOIN chunks ON chunks.doc_id = gold.doc_id AND abs(chunks.chunk_idx - gold.chunk_idx) <= 1", "gold"),
    "side_grades": X.sql(f"SELECT qid, chunk_id, grade, {_SIDE.format('filing')} AS side FROM (SELECT *, min(filing) OVER (PARTITION BY qid) AS own FROM gold) WHERE filing = own", "gold"),
    "row_holdout": R._with(R.sql("@SELECT key, CASE WHEN row_number() OVER (ORDER BY md5(key)) <= 10 THEN 'val' ELSE 'train' END AS side FROM (SELECT qid || '/' || pos_id AS key FROM basic UNION ALL SELECT qid || '/' || unnest(negatives[1:4]) FROM basic)", "dense", "vq"), R._BASIC),
    "overlap_shares": R._with(X.sql("@SELECT c.qid, c.chunk_id, round(sum(least(tf, coalesce(g, 0))) / sum(tf), 9) AS share FROM bm_ranked c JOIN ctok USING (chunk_id) LEFT JOIN gtok ON gtok.qid = c.qid AND gtok.term = ctok.term WHERE rank <= 10 GROUP BY ALL", "bm_ranked", "qrels"), _CTOK),
    "band_counters": R._banded(200, 4, 4, 0.35, "SELECT kind, count(*) AS n_candidates, count(*) FILTER (share IS NULL OR round(share, 9) >= 0.35) AS n_dropped FROM cand LEFT JOIN share USING (qid, chunk_id) GROUP BY kind"),
    "mining_report": R._banded(100, 4, 2, 0.50, "SELECT count(*) AS n_rows, round(sum(n_in_filing) / sum(n_in_filing + n_cross_filing), 6) AS in_filing_share, count(*) FILTER (n_in_filing < 4) AS short_in, count(*) FILTER (n_cross_filing < 2) AS short_cross FROM mined"),
    "negatives_half": R._with(R.sql("@SELECT * FROM basic", "half", "vq"), R._BASIC.replace("FROM dense", "FROM half").replace("r <= 8", "r <= 6")),
    "ndcg_check": R.sql("SELECT qid, ndcg_10 AS ndcg FROM per WHERE system = 'dense'", "per"),
    "routed_subset": R.sql(f"SELECT system, {R._MEANS} FROM per WHERE qid % 100 = 0 GROUP BY system", "per").replace(R.CTE["runs"], _ROUTED),
    "two_rerankers": R.sql("SELECT system, qid, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY system, qid ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM (SELECT half.qid, half.chunk_id, unnest(['whole', 'second']) AS system, unnest([list_dot_product(q.e, c.embedding::DOUBLE[]), list_dot_product(q.e[33:64], c.embedding[33:64]::DOUBLE[])]) AS s FROM half JOIN q ON q.qid = half.qid JOIN embeddings c ON c.vec_id = half.chunk_id WHERE rank <= 20)", "half", "q"),
    "greedy_match": "WITH v AS (SELECT vec_id // 25 AS filing, vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.filing, a.vec_id AS p, b.vec_id AS g, list_dot_product(a.e, b.e) AS c FROM v a JOIN v b USING (filing) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1), m AS (SELECT filing, (SELECT avg(c) FROM (SELECT max(c) AS c FROM s x WHERE x.filing = s.filing GROUP BY x.p)) AS p, (SELECT avg(c) FROM (SELECT max(c) AS c FROM s x WHERE x.filing = s.filing GROUP BY x.g)) AS r FROM s GROUP BY s.filing) SELECT filing, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m",
}
WITHOUT_SQL = ("subword_lengths", "subword_windows", "subword_clipped", "subword_ratio")
QUERIES = {name: globals()[name] for name in [*ORACLES, *WITHOUT_SQL]}
