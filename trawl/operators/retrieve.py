"""Keyword, weighted-term and dense retrieval, fusion, routing and reranking.

Every ranking is by round(score, 9) from the highest, then by id, so that it
doesn't depend on the order of additions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import lower_words
from trawl.operators import nearest
from trawl.operators.blockmax import TermIndex, bm25_impact, capped_index, common_terms, hits, search, term_index, unit_impact, with_norms
from trawl.sources.store import cut


def ranked(scores: DataFrame, k: int | None, *by: str, tie: str = "chunk_id") -> DataFrame:
    """Ranks from 1 within `by`, cut at k; Spark cuts before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), tie)
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def postings(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """id, term, tf."""
    rows = df.select(F.col(id_col), F.explode(terms).alias("term"))
    return rows.groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """term, df, cf."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_idf(stats: DataFrame, n_docs: int, epsilon: float = 0.25) -> DataFrame:
    """term, idf; what would be below 0 is epsilon times the mean of all."""
    raw = stats.select("term", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def all_scores(index: TermIndex, wanted: DataFrame, idf: DataFrame, pairs: DataFrame | None, k1: float, b: float) -> DataFrame:
    """qid, chunk_id, score of given pairs, or of all that share a term: as many rows as there are such pairs. Given pairs are written first, so that the index is shuffled only if they are too many to broadcast."""
    rows = index.rows.select("chunk_id", "dl", "terms", "counts")
    if pairs is not None:
        rows = rows.join(cut(pairs.select("qid", "chunk_id").distinct()), "chunk_id")
    post = rows.select(*rows.columns[:2], *rows.columns[4:], F.explode(F.arrays_zip("terms", "counts")).alias("p")).withColumn("term", F.col("p.terms")).withColumn("tf", F.col("p.counts"))
    hit = post.join(wanted, "term" if pairs is None else ["qid", "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl or 1.0)))
    return hit.join(idf, "term").groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"))


def bm25_search(queries: DataFrame, index: TermIndex, k: int, k1: float = 1.5, b: float = 0.75, terms=lower_words, within: DataFrame | None = None) -> DataFrame:
    """blockmax.search() for the keyword score."""
    wanted = queries.select("qid", F.explode(terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    weights = wanted.join(bm25_idf(index.stats, index.n), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    return search(index, weights, k, bm25_impact(index.avgdl, k1, b), float("-inf"), within=within)


def bm25(queries: DataFrame, corpus: DataFrame, k: int | None = 10, k1: float = 1.5, b: float = 0.75, terms=lower_words, index: TermIndex | None = None, pairs: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, score, rank. A query's repeated term counts each time.

    Statistics cover all terms of the corpus. Chunks without any of a query's
    terms aren't ranked. The k best come from blocks with upper bounds. within:
    (qid, grp), queries that look only at the chunks of one group, if the index
    has groups. pairs: (qid, chunk_id) that alone are scored, all of them; so
    are all pairs that share a term for k None.
    """
    index = index or term_index(corpus, terms)
    if k is not None and pairs is None:
        return ranked(hits(bm25_search(queries, index, k, k1, b, terms, within)), k, "qid")
    wanted = queries.select("qid", F.explode(terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    return ranked(all_scores(index, wanted, bm25_idf(index.stats, index.n), pairs, k1, b), k, "qid")


def vocabulary(stats: DataFrame, most: int) -> DataFrame:
    """The terms that a weighted index keeps: those that occur most, ties by code point."""
    return stats.orderBy(F.desc("cf"), "term").limit(most)


def rarity(n_docs: int) -> Column:
    """What a term counts more the fewer documents have it."""
    return F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1


def tfidf(post: DataFrame, stats: DataFrame, n_docs: int, id_col: str) -> DataFrame:
    """id, term, w: tf * (ln((1 + N) / (1 + df)) + 1), each id's to length 1. Terms without statistics are dropped."""
    w = post.join(stats.select("term", "df"), "term").select(id_col, "term", (F.col("tf") * rarity(n_docs)).alias("w"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("w"))


class Weighted(NamedTuple):
    """queries: qid, term, w, to length 1; index; stats of the terms that the index keeps."""

    queries: DataFrame
    index: TermIndex
    stats: DataFrame


def weigh(queries: DataFrame, index: TermIndex, terms, most: int | None = 200_000, query_key: str = "ref") -> Weighted:
    """Both sides of a weighted comparison; the index keeps the `most` commonest terms, all for None."""
    stats = index.stats if most is None else cut(vocabulary(index.stats, most))
    q = tfidf(postings(queries.withColumnRenamed(query_key, "qid"), "qid", terms(F.col("text"))), stats, index.n, "qid")
    return Weighted(cut(q), index, stats)


def factors(sides: Weighted) -> DataFrame:
    """term, cf, factor of the terms that the index keeps."""
    return sides.stats.select("term", "cf", rarity(sides.index.n).alias("factor"))


def measured(sides: Weighted) -> TermIndex:
    """The index with the lengths of the chunks' vectors, stored; it serves several searches."""
    return with_norms(sides.index, factors(sides))


def cosine_topk(sides: Weighted, k: int, query_key: str = "ref", least: float = 0.0, within: DataFrame | None = None, index: TermIndex | None = None) -> DataFrame:
    """query key, chunk_id, score of the k best chunks by cosine, above 0 and from `least` on; within as in search(), its key named alike. index: of measured(), made if not given."""
    inside = None if within is None else within.withColumnRenamed(query_key, "qid")
    weights = sides.queries.join(factors(sides), "term").select("qid", "term", (F.col("w") * F.col("factor")).alias("w"))
    found = hits(search(index or measured(sides), weights, k, unit_impact, least, inside))
    return ranked(found, k, "qid").select(F.col("qid").alias(query_key), "chunk_id", "score")


def capped_topk(queries: DataFrame, corpus: DataFrame, terms, k: int, most: int = 200_000, query_key: str = "ref", least: float = 0.0) -> DataFrame:
    """cosine_topk() over the `most` commonest terms without storing an index: chunks are read three times, and what is written of them are the terms of the queries."""
    stats, n = common_terms(corpus, terms, most)
    q = cut(tfidf(postings(queries.withColumnRenamed(query_key, "qid"), "qid", terms(F.col("text"))), stats, n, "qid"))
    factor = stats.select("term", rarity(n).alias("factor"))
    sides = Weighted(q, capped_index(corpus, terms, stats, factor, q, n), stats)
    return cosine_topk(sides, k, query_key, least, index=sides.index)


def rare_terms(sides: Weighted, least: float) -> DataFrame:
    """qid, term: of each query all but its commonest terms, as many as together can't give a cosine of `least`, since a chunk's vector has length 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("df"), "term")
    rows = sides.queries.join(sides.stats.select("term", "df"), "term").withColumn("upto", F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where(F.sqrt("upto") >= least - 1e-9).select("qid", "term")


def cosine_pairs(sides: Weighted, least: float, query_key: str = "ref") -> DataFrame:
    """query key, chunk_id, score of all pairs with a cosine of `least` or more (above 0).

    A prefix filter: pairs that share a rare term of the query are candidates,
    and no others can have that cosine; candidates are scored with all terms.
    """
    prefix = cut(rare_terms(sides, least))
    rows = sides.index.rows
    rare = rows.select("chunk_id", F.explode("terms").alias("term")).join(prefix.select("term").distinct(), "term", "left_semi")
    pairs = cut(rare.join(prefix, "term").select("qid", "chunk_id").distinct())
    met = rows.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    post = met.select("chunk_id", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("chunk_id", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    d = tfidf(post, sides.stats, sides.index.n, "chunk_id")
    # norms need all of a chunk's terms, the join only those of the queries
    mine = d.join(sides.queries.select("term").distinct(), "term", "left_semi").join(pairs, "chunk_id").join(sides.queries.withColumnRenamed("w", "qw"), ["qid", "term"])
    scores = mine.groupBy("qid", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return scores.where(F.round("score", 9) >= least).select(F.col("qid").alias(query_key), "chunk_id", "score")


def dense(queries: DataFrame, corpus: DataFrame | None, k: int, vector_col: str = "embedding", same: bool = False, index: nearest.VectorIndex | None = None) -> DataFrame:
    """qid, chunk_id, score, rank: exact inner products over blocks with upper bounds, of a stored index or of a corpus as it is read.

    With same=False a vector isn't found for the query of its own id.
    """
    index = index or nearest.vector_index(corpus, vector_col, stored=False)
    return ranked(nearest.hits(nearest.search(queries, index, k, vector_col, same)), k, "qid")


def fuse(*runs: DataFrame, k: int | None = None, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (60 + rank) over the lists that have a chunk."""
    rows = [r.select("qid", "chunk_id", (F.lit(1.0) / (rrf_k + F.col("rank"))).alias("s")) for r in runs]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return ranked(both.groupBy("qid", "chunk_id").agg(F.sum("s").alias("score")), k, "qid")


def truncate(run: DataFrame, depth: int) -> DataFrame:
    return run.where(F.col("rank") <= depth)


def rerank(run: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """The first `depth` of each list by another scorer's (qid, chunk_id, score), which replaces theirs."""
    top = truncate(run, depth).select("qid", "chunk_id")
    return ranked(top.join(scores.select("qid", "chunk_id", "score"), ["qid", "chunk_id"]), None, "qid")


def depth_sweep(run: DataFrame, scores: DataFrame, depths: tuple[int, ...] = (50, 100, 200), name: str = "rerank") -> DataFrame:
    """rerank() at several depths in one table, the system named after the depth. The scores are joined once."""
    joined = truncate(run, max(depths)).select("qid", "chunk_id", F.col("rank").alias("was")).join(scores.select("qid", "chunk_id", "score"), ["qid", "chunk_id"])
    at = joined.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).where("was <= depth")
    return ranked(at.withColumn("system", F.concat(F.lit(f"{name}@"), F.col("depth").cast("string"))).drop("was", "depth"), None, "system", "qid")


def routed(all_scores: DataFrame, routes: DataFrame, filings: DataFrame, k: int) -> DataFrame:
    """A list per query: of the routed filing's chunks alone if the query has a route (qid, filing), else of all. filings: chunk_id, filing."""
    s = all_scores.select("qid", "chunk_id", "score").join(filings.select("chunk_id", "filing"), "chunk_id").join(routes.select("qid", F.col("filing").alias("route")), "qid", "left")
    return ranked(s.where(F.col("route").isNull() | (F.col("route") == F.col("filing"))).select("qid", "chunk_id", "score"), k, "qid")


def contexts(run: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """qid, context: the first k texts in order, a blank line between them."""
    top = truncate(run, k).select("qid", "chunk_id", "rank").join(corpus.select("chunk_id", "text"), "chunk_id")
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return top.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("context"))


def lexical_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, terms) -> DataFrame:
    """A stand-in for a neural scorer: the share of a query's distinct terms that a chunk has."""
    q = queries.select("qid", F.array_distinct(terms(F.col("text"))).alias("q"))
    c = corpus.select("chunk_id", F.array_distinct(terms(F.col("text"))).alias("c"))
    both = pairs.select("qid", "chunk_id").join(q, "qid").join(c, "chunk_id")
    return both.select("qid", "chunk_id", F.when(F.size("q") > 0, F.size(F.array_intersect("q", "c")) / F.size("q")).otherwise(0.0).alias("score"))
