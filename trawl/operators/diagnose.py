"""Why a system fails: audits of chunks and labels, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import junk_ratio, numeric_density, prefix_key, words
from trawl.operators.select import percentage


def chunk_quality(chunks: DataFrame, short: int = 50, split=words) -> DataFrame:
    """One row: number, mean and median words, short ones, mean junk share and distinct beginnings of chunks."""
    rows = chunks.select(F.size(split(F.col("text"))).alias("n"), junk_ratio(F.col("text")).alias("junk"), prefix_key(F.col("text")).alias("key"))
    return rows.agg(
        F.count("*").alias("n_chunks"),
        F.round(F.avg("n"), 6).alias("mean_words"),
        F.expr("percentile(n, 0.5)").alias("median_words"),
        F.count_if(F.col("n") < short).alias("n_short"),
        F.round(F.avg("junk"), 6).alias("mean_junk"),
        F.count_distinct("key").alias("distinct_prefixes"),
    )


def density(corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: mean numeric density of all chunks and of gold ones, and whether gold's is more than 1.3 times higher."""
    rows = corpus.join(qrels.select("chunk_id", F.lit(True).alias("gold")).distinct(), "chunk_id", "left").select(numeric_density(F.col("text")).alias("d"), "gold")
    out = rows.agg(F.round(F.avg("d"), 6).alias("corpus_density"), F.round(F.avg(F.when(F.col("gold"), F.col("d"))), 6).alias("gold_density"))
    return out.withColumn("flagged", F.coalesce(F.col("gold_density") > 1.3 * F.col("corpus_density"), F.lit(False)))


def adjacency(qrels: DataFrame) -> DataFrame:
    """qid, n_relevant, n_runs, n_filings, adjacent_share of labels with filing and chunk_idx: how far relevant chunks stand side by side."""
    w = Window.partitionBy("qid", "filing").orderBy("chunk_idx")
    rows = qrels.select("qid", "filing", "chunk_idx").distinct().withColumn("island", F.col("chunk_idx") - F.row_number().over(w)).withColumn("next", (F.col("chunk_idx") - F.lag("chunk_idx").over(w)) == 1)
    out = rows.groupBy("qid").agg(F.count("*").alias("n_relevant"), F.count_distinct("filing", "island").alias("n_runs"), F.count_distinct("filing").alias("n_filings"), F.count_if("next").alias("adjacent"))
    gaps = F.col("n_relevant") - F.col("n_filings")
    return out.select("qid", "n_relevant", "n_runs", "n_filings", F.round(F.when(gaps > 0, F.col("adjacent") / gaps).otherwise(0.0), 6).alias("adjacent_share"))


def first_ranks(run: DataFrame, qrels: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """qid, first_rank of gold (depth + 1 if missed), best gold score, top-1 score."""
    top = run.where(F.col("rank") <= depth)
    hits = top.join(qrels.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"]).groupBy("qid").agg(F.min("rank").alias("r"), F.max("score").alias("gold_score"))
    best = top.where("rank = 1").select("qid", F.col("score").alias("top_score"))
    return queries.select("qid").join(hits, "qid", "left").join(best, "qid", "left").select("qid", F.coalesce("r", F.lit(depth + 1)).alias("first_rank"), "gold_score", "top_score")


def rank_histogram(first: DataFrame, depth: int, missed: str = "missed") -> DataFrame:
    """How many queries find gold first in each range of ranks; `missed` names those that don't within depth."""
    r = F.col("first_rank")
    name = F.when(r > depth, missed).when(r == 1, "1").when(r <= 10, "2-10").when(r <= 20, "11-20").when(r <= 100, "21-100").when(r <= 1000, "101-1000").otherwise("beyond")
    return first.groupBy(name.alias("ranks")).agg(F.count("*").alias("n"))


def separation(first: DataFrame) -> DataFrame:
    """Mean gap between the top score and the best gold's, over queries whose gold was found, and how many could be recovered from ranks 21 to 100."""
    return first.agg(F.round(F.avg(F.col("top_score") - F.col("gold_score")), 6).alias("mean_gap"), F.count_if(F.col("gold_score").isNotNull()).alias("n_found"), F.count_if(F.col("first_rank").between(21, 100)).alias("recoverable"), F.count("*").alias("n_queries"))


def failures(run: DataFrame, qrels: DataFrame, filings: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """system, outcome, n, pct, same_filing_share: found, the right filing with the wrong chunk, or the filing absent, of the top `depth`."""
    gold = qrels.join(filings.select("chunk_id", "filing"), "chunk_id")
    home = gold.select("qid", "filing").distinct()
    top = run.where(F.col("rank") <= depth).join(filings.select("chunk_id", "filing"), "chunk_id")
    top = top.join(qrels.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left").join(home.withColumn("home", F.lit(1)), ["qid", "filing"], "left")
    per = top.groupBy("system", "qid").agg(F.max("hit").alias("hit"), F.max("home").alias("home"), F.avg(F.coalesce("home", F.lit(0))).alias("share"))
    every = home.select("qid").distinct().join(queries.select("qid"), "qid", "left_semi").join(run.select("system").distinct())
    per = every.join(per, ["system", "qid"], "left")
    outcome = F.when(F.col("hit") == 1, "found").when(F.col("home") == 1, "right filing").otherwise("absent")
    per = per.select("system", outcome.alias("outcome"), F.coalesce("share", F.lit(0.0)).alias("share"))
    counts = per.groupBy("system", "outcome").agg(F.count("*").alias("n"), F.sum("share").alias("s"))
    w = Window.partitionBy("system")
    return counts.select("system", "outcome", "n", F.round(100 * F.col("n") / F.sum("n").over(w), 6).alias("pct"), F.round(F.sum("s").over(w) / F.sum("n").over(w), 6).alias("same_filing_share"))


def movement(before: DataFrame, after: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """One row: gold of the top `depth` that a second ranking keeps, pushes out and pulls in."""
    gold = qrels.select("qid", "chunk_id").distinct()
    top = lambda r, name: r.where(F.col("rank") <= depth).join(gold, ["qid", "chunk_id"], "left_semi").select("qid", "chunk_id", F.lit(1).alias(name))
    both = top(before, "a").join(top(after, "b"), ["qid", "chunk_id"], "full")
    return both.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("kept"), F.count_if(F.col("b").isNull()).alias("pushed"), F.count_if(F.col("a").isNull()).alias("pulled"))


def circularity(per: DataFrame, named: DataFrame, metric: str = "ndcg_10") -> DataFrame:
    """system, named, n, mean of a metric by whether a query names its filing."""
    rows = per.join(named.select("qid", F.lit(True).alias("named")).distinct(), "qid", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    return rows.groupBy("system", "named").agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias(metric))


def truncation(queries: DataFrame, chunks: DataFrame, n, limit: int = 512, extra: int = 4) -> DataFrame:
    """One row: over-long chunks, the mean share cut from chunks, and what is left for a chunk beside a mean query."""
    q = queries.agg(F.avg(n(F.col("text"))).alias("mean_query"))
    c = chunks.select(n(F.col("text")).alias("n")).agg(percentage(F.col("n") > limit).alias("pct_over"), F.round(F.avg(F.when(F.col("n") > 0, F.greatest(F.col("n") - limit, F.lit(0)) / F.col("n")).otherwise(0.0)), 6).alias("mean_cut"))
    return c.join(q).select("pct_over", "mean_cut", F.round("mean_query", 6).alias("mean_query"), F.round(limit - F.col("mean_query") - extra, 6).alias("budget"))
