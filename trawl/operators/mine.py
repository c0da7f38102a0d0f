"""Hard negatives and training rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions.text import content_tokens
from trawl.operators.retrieve import ranked
from trawl.operators.select import neighbours, not_gold
from trawl.sources.order import numbered
from trawl.sources.store import cut


def gathered(rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """Values in the order of rank, as an array."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def basic(run: DataFrame, qrels: DataFrame, depth: int = 50, n: int = 8) -> DataFrame:
    """qid, pos_id, negatives: the first n of the top `depth` that aren't gold; the positive is the gold with the smallest id. Queries without negatives have no row."""
    negatives = ranked(not_gold(run.where(F.col("rank") <= depth), qrels).select("qid", "chunk_id", "score"), n, "qid")
    positive = qrels.groupBy("qid").agg(F.min("chunk_id").alias("pos_id"))
    return gathered(negatives, "chunk_id", "negatives", "qid").join(positive, "qid").select("qid", "pos_id", "negatives")


def shares(candidates: DataFrame, qrels: DataFrame, corpus: DataFrame, terms=content_tokens) -> DataFrame:
    """qid, chunk_id, share: how much of a candidate's content tokens the gold of its query has too, with multiplicity; gold texts are added up. Candidates without content are left out."""
    def counted(ids: DataFrame) -> DataFrame:
        return corpus.join(ids, "chunk_id", "left_semi").select("chunk_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))

    gold = qrels.select("qid", "chunk_id").distinct().join(counted(qrels.select("chunk_id").distinct()), "chunk_id").groupBy("qid", "term").agg(F.sum("tf").alias("g"))
    mine = candidates.select("qid", "chunk_id").distinct().join(counted(candidates.select("chunk_id").distinct()), "chunk_id")
    both = mine.join(gold, ["qid", "term"], "left")
    return both.groupBy("qid", "chunk_id").agg((F.sum(F.least("tf", F.coalesce("g", F.lit(0)))) / F.sum("tf")).alias("share"))


def own_filings(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, own: the filing of a query's gold, the least one where it lies in several."""
    return qrels.join(corpus.select("chunk_id", "filing"), "chunk_id").groupBy("qid").agg(F.min("filing").alias("own"))


def in_filing_pairs(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, chunk_id: the chunks of each query's own filing."""
    return corpus.select("chunk_id", F.col("filing").alias("own")).join(cut(own_filings(qrels, corpus)), "own").select("qid", "chunk_id")


def candidates(run: DataFrame, inside: DataFrame, qrels: DataFrame, corpus: DataFrame, depth: int = 200, reach: int = 1) -> DataFrame:
    """qid, chunk_id, score, kind: what may become a negative of a query, "in" its gold's filing or "cross" from another, without gold and what lies beside it."""
    where = corpus.select("chunk_id", "filing", "chunk_idx")
    own = cut(own_filings(qrels, corpus))
    # what is small is written before it meets the corpus, so that Spark knows its size
    banned = cut(neighbours(qrels.join(where, "chunk_id"), reach)).join(where, ["filing", "chunk_idx"]).select("qid", "chunk_id")
    top = cut(ranked(run.select("qid", "chunk_id", "score"), depth, "qid")).join(where.select("chunk_id", "filing"), "chunk_id").join(own, "qid")
    cross = top.where(F.col("filing") != F.col("own")).select("qid", "chunk_id", "score", F.lit("cross").alias("kind"))
    inside = inside.select("qid", "chunk_id", "score", F.lit("in").alias("kind"))
    return cut(cross.unionByName(inside).join(banned, ["qid", "chunk_id"], "left_anti"))


def band_counters(found: DataFrame, qrels: DataFrame, corpus: DataFrame, band: float = 0.35) -> DataFrame:
    """kind, n_candidates, n_dropped of candidates(): those that share `band` or more with gold, or have no content."""
    rows = found.join(shares(found, qrels, corpus), ["qid", "chunk_id"], "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n_candidates"), F.count_if(F.coalesce(F.round("share", 9) >= band, F.lit(True))).alias("n_dropped"))


def report(triples: DataFrame, n_in: int = 4, n_cross: int = 4) -> DataFrame:
    """One row about mined triples: how many, the share of in-filing negatives, and how many are short of either kind."""
    both = F.sum(F.col("n_in_filing") + F.col("n_cross_filing"))
    return triples.agg(F.count("*").alias("n_rows"), F.round(F.sum("n_in_filing") / both, 6).alias("in_filing_share"), F.count_if(F.col("n_in_filing") < n_in).alias("short_in"), F.count_if(F.col("n_cross_filing") < n_cross).alias("short_cross"))


def row_holdout(rows: DataFrame, key: str, n: int = 200) -> DataFrame:
    """Adds side: "val" for the n rows whose keys have the least md5, else "train". Splits rows, so one question can be on both sides; for comparison with splits by question. The boundary is found by a top-n."""
    mark = F.md5(F.col(key).cast("string").cast("binary"))
    last = rows.select(mark.alias("_m")).orderBy("_m").limit(n).agg(F.max("_m").alias("_to"))
    return rows.join(F.broadcast(last)).withColumn("side", F.when(mark <= F.col("_to"), "val").otherwise("train")).drop("_to")


def seeded_row_holdout(rows: DataFrame, *by: str, n: int = 200, seed: int = 42) -> DataFrame:
    """Adds side: "val" for the n rows that a seeded shuffle of all rows in the order of `by` puts first, else "train".

    Rows are split, so one question can be on both sides; for comparison with
    splits by question. The shuffle is a chain of draws over places: the driver
    holds one whole number for each row, and sends n of them.
    """
    placed = cut(numbered(rows, *by, name="_pos"))
    order = list(range(placed.count()))
    random.Random(seed).shuffle(order)
    chosen = rows.sparkSession.createDataFrame([(p,) for p in order[:n]], "_chosen long")
    return placed.join(F.broadcast(chosen), F.col("_pos") == F.col("_chosen"), "left").withColumn("side", F.when(F.col("_chosen").isNotNull(), "val").otherwise("train")).drop("_pos", "_chosen")


def banded(run: DataFrame, inside: DataFrame, qrels: DataFrame, corpus: DataFrame, depth: int = 200, n_in: int = 4, n_cross: int = 4, band: float = 0.35, reach: int = 1) -> DataFrame:
    """qid, pos_id, negatives, n_in_filing, n_cross_filing: a row for each primary positive.

    run: (qid, chunk_id, score) of the global top `depth` or more; inside: of
    in_filing_pairs(); corpus: chunk_id, filing, chunk_idx, text. Gold, what lies beside it, and what shares `band` or more
    of its content with it are banned. Cross-filing negatives come from the
    global top `depth`, in-filing ones from the filing of the gold. Primary are
    grade-2 chunks, or all gold where there is none.
    """
    both = candidates(run, inside, qrels, corpus, depth, reach)
    kept = both.join(shares(both, qrels, corpus).where(F.round("share", 9) < band), ["qid", "chunk_id"])
    kept = ranked(kept, max(n_in, n_cross), "qid", "kind").where(((F.col("kind") == "in") & (F.col("rank") <= n_in)) | ((F.col("kind") == "cross") & (F.col("rank") <= n_cross)))
    order = F.struct((F.col("kind") == "cross").alias("k"), "rank")
    lists = kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "chunk_id"))), lambda x: x["chunk_id"]).alias("negatives"), F.count_if(F.col("kind") == "in").alias("n_in_filing"), F.count_if(F.col("kind") == "cross").alias("n_cross_filing"))
    primary = qrels.withColumn("has2", F.max(F.col("grade") == 2).over(Window.partitionBy("qid"))).where(~F.col("has2") | (F.col("grade") == 2))
    return primary.select("qid", F.col("chunk_id").alias("pos_id")).join(lists, "qid")


def contrastive(triples: DataFrame, n: int = 4, packed: bool = True) -> DataFrame:
    """Rows of the contrastive loss: with up to n negatives each, or one row per negative."""
    few = F.slice("negatives", 1, n)
    return triples.withColumn("negatives", few) if packed else triples.select(*[c for c in triples.columns if c != "negatives"], F.explode(few).alias("negative"))


def pairwise(triples: DataFrame, n: int = 4) -> DataFrame:
    """qid, chunk_id, label: the positive with 1.0, up to n negatives with 0.0."""
    pair = lambda c, y: F.struct(c.alias("chunk_id"), F.lit(y).alias("label"))
    rows = F.concat(F.array(pair(F.col("pos_id"), 1.0)), F.transform(F.slice("negatives", 1, n), lambda c: pair(c, 0.0)))
    return triples.select("qid", F.explode(rows).alias("r")).select("qid", "r.*")


def seeded_holdout(spark: SparkSession, ids: list[str], n: int | float, seed: int = 42) -> DataFrame:
    """qid, side: a seeded shuffle of the sorted ids; n of them, or that share, are for validation."""
    names = sorted(set(ids))
    random.Random(seed).shuffle(names)
    k = max(1, int(n * len(names))) if isinstance(n, float) else n
    return spark.createDataFrame([(q, "val" if i < k else "train") for i, q in enumerate(names)], "qid string, side string")


def triplet_accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """Of scored (pos, neg) pairs: how often the positive wins, and mean scores, by kind of negative if asked."""
    return scored.groupBy(*by).agg(F.round(F.avg((F.col("pos") > F.col("neg")).cast("double")), 6).alias("accuracy"), F.round(F.avg("pos"), 6).alias("mean_pos"), F.round(F.avg("neg"), 6).alias("mean_neg"), F.count("*").alias("n"))


def sft_rows(queries: DataFrame, answers: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """pos, question, context, answer: a question's first gold chunk by file order, and its answer. queries have pos, qrels file_pos."""
    from trawl.functions.text import not_blank
    from trawl.operators.select import first_by_position

    gold = first_by_position(qrels, "qid", "chunk_id", "file_pos")
    rows = queries.join(answers.where(not_blank(F.col("answer"))), "qid").join(gold, "qid").join(corpus.select("chunk_id", F.col("text").alias("context")), "chunk_id")
    return rows.select("pos", F.col("text").alias("question"), "context", F.trim("answer").alias("answer"))


def pad_batches(rows: DataFrame, ids: str, position: str, size: int, pad: int = 0) -> DataFrame:
    """Adds batch, input_ids padded to the batch's longest row, and attention_mask. Positions are 0, 1, 2 and so on."""
    from trawl.functions.text import attention, right_pad

    at = rows.withColumn("batch", F.floor(F.col(position) / size))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    at = at.withColumn("_n", longest)
    return at.withColumn("input_ids", right_pad(F.col(ids), F.col("_n"), pad)).withColumn("attention_mask", attention(F.col(ids), F.col("_n"))).drop("_n")
