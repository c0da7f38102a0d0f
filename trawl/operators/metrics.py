"""Retrieval metrics per query and system, and text-generation metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.stem import stems
from trawl.functions.text import ngrams, tokens, words
from trawl.sources.store import cut

CUTS = (5, 10, 20, 100)


def ideal_dcg(qrels: DataFrame, cuts: tuple[tuple[int, bool], ...] = ((10, False), (20, False), (10, True))) -> DataFrame:
    """qid, n_gold and the best possible gain for (depth, exponential)."""
    place = Window.partitionBy("qid").orderBy(F.desc("grade"), "chunk_id")
    rows = qrels.withColumn("place", F.row_number().over(place))
    return rows.groupBy("qid").agg(F.count("*").alias("n_gold"), *[F.sum(F.when(F.col("place") <= k, _gain(e) / F.log2(F.col("place") + 1))).alias(_name("idcg", k, e)) for k, e in cuts])


def _gain(exponential: bool):
    return (F.pow(F.lit(2.0), F.col("grade")) - 1) if exponential else F.col("grade").cast("double")


def _name(stem: str, k: int, exponential: bool) -> str:
    return f"{stem}{'_exp' if exponential else ''}_{k}"


def per_query(runs: DataFrame, qrels: DataFrame, queries: DataFrame, recall: tuple[int, ...] = CUTS, cuts: tuple[tuple[int, bool], ...] = ((10, False), (20, False), (10, True)), n_gold: DataFrame | None = None) -> DataFrame:
    """system, qid, mrr_10, ndcg_10, ndcg_20, ndcg_exp_10, recall_5 and so on, rounded to 9 digits, a row for every query and system.

    A query that a run misses, or that has no gold, has 0 everywhere. Runs are
    joined to gold before anything is summed: only hits are grouped. With n_gold
    (qid, n_gold), qrels need only have the gold that runs have and each query's
    best grades.
    """
    hits = runs.join(qrels.select("qid", "chunk_id", "grade"), ["qid", "chunk_id"])
    found = hits.groupBy("system", "qid").agg(
        F.min(F.when((F.col("grade") >= 1) & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        *[F.sum(F.when(F.col("rank") <= k, _gain(e) / F.log2(F.col("rank") + 1))).alias(_name("dcg", k, e)) for k, e in cuts],
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in recall],
    )
    every = queries.select("qid").distinct().join(runs.select("system").distinct())  # systems are a handful
    ideal = ideal_dcg(qrels, cuts) if n_gold is None else ideal_dcg(qrels, cuts).drop("n_gold").join(n_gold, "qid")
    rows = every.join(found, ["system", "qid"], "left").join(ideal, "qid", "left")
    share = lambda a, b: F.round(F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0)), 9)
    return rows.select("system", "qid", F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 9).alias("mrr_10"), *[share(_name("dcg", k, e), _name("idcg", k, e)).alias(_name("ndcg", k, e)) for k, e in cuts], *[share(f"hits_{k}", "n_gold").alias(f"recall_{k}") for k in recall])


def ndcg_of_lists(run: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg by another way than per_query(): each query's list of at most k grades is discounted as an array. For checking one against the other."""
    gain = lambda grades: F.aggregate(F.transform(grades, lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    top = run.where(F.col("rank") <= k).join(qrels.select("qid", "chunk_id", "grade"), ["qid", "chunk_id"], "left")
    listed = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("grade", F.lit(0)).cast("double").alias("g")))), lambda x: x["g"]).alias("found"))
    best = qrels.withColumn("_p", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade")))).where(F.col("_p") <= k)
    best = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.col("grade").cast("double")), asc=False).alias("best"))
    rows = queries.select("qid").distinct().join(listed, "qid", "left").join(best, "qid", "left")
    return rows.select("qid", F.round(F.coalesce(gain(F.col("found")) / gain(F.col("best")), F.lit(0.0)), 9).alias("ndcg"))


def routed_means(per: DataFrame, routes: DataFrame) -> DataFrame:
    """Means of each system over the queries that have a route alone: what routing changes where it acts."""
    return means(per.join(routes.select("qid").distinct(), "qid", "left_semi"), "system")


def means(per: DataFrame, *by: str) -> DataFrame:
    """Mean of each metric, by system or more."""
    names = [c for c in per.columns if c.split("_")[0] in ("mrr", "ndcg", "recall")]
    return per.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def rouge_n(pairs: DataFrame, n: int, keys: list[str], prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """keys, rouge_n: the F measure of shared n-grams (with multiplicity) of lower-case letter and digit runs, without stemming. Keys tell the pairs apart."""
    grams = lambda c: ngrams(tokens(F.col(c)), n)
    counted = lambda c, name: pairs.select(*keys, F.explode(grams(c)).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias(name))
    hits = counted(prediction, "p").join(counted(gold, "r"), [*keys, "g"]).groupBy(*keys).agg(F.sum(F.least("p", "r")).alias("hits"))
    many = lambda c: F.greatest(F.size(tokens(F.col(c))) - (n - 1), F.lit(0))
    rows = pairs.select(*keys, (many(prediction) + many(gold)).alias("total")).join(hits, keys, "left")
    return rows.select(*keys, F.round(F.when(F.col("hits") > 0, 2.0 * F.col("hits") / F.col("total")).otherwise(0.0), 9).alias(f"rouge_{n}"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by the bits of one number for each word of b."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def stemmed(pairs: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """pairs with the given texts as their lower-case runs of letters and digits, stemmed, a blank between them. Keys tell the pairs apart. Each different word is stemmed once. What grows with the pairs is joined by shuffles and never broadcast."""
    sides = None
    for c in columns:
        rows = pairs.select(*keys, F.lit(c).alias("_c"), F.posexplode(tokens(F.col(c))).alias("_p", "word"))
        sides = rows if sides is None else sides.unionByName(rows)
    sides = cut(sides)
    known = cut(stems(sides.select("word").distinct()))
    texts = sides.join(known.hint("merge"), "word").groupBy(*keys, "_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "stem"))), lambda x: x["stem"]), " ").alias("_t"))
    # a text without words has no row
    made = texts.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("_t"))).alias(c) for c in columns])
    rest = [c for c in pairs.columns if c not in columns]
    return pairs.select(*rest).join(made.hint("merge"), keys, "left").select(*rest, *[F.when(F.col(c).isNotNull(), F.col(c)).otherwise("").alias(c) for c in columns])


#: How the 13a tokenizer parts a text: what it replaces, with what; the second list after a blank was put on either side.
PLAIN_13A = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
PARTS_13A = [(r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]


def tokens_13a(text: Column) -> Column:
    """Tokens of the 13a tokenizer of machine translation's campaigns; case stays."""
    for found, put in PLAIN_13A:
        text = F.replace(text, F.lit(found), F.lit(put))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, put in PARTS_13A:
        text = F.regexp_replace(text, pattern, put.replace("\\", "$"))
    return words(text)


def bleu(pairs: DataFrame, keys: list[str], prediction: str = "prediction", gold: str = "gold", order: int = 4) -> DataFrame:
    """keys, bleu: sentence BLEU from 0 to 1 with one reference, over 13a tokens.

    N-grams and how often each side has them are tables that are joined, hits
    being clipped to the reference's count. An order without a hit counts as
    1 / 2**k of one, k being how many such orders there were so far; orders that
    the prediction is too short for don't count. No hit at all is 0. Keys tell
    the pairs apart.
    """
    rows = cut(pairs.select(*keys, tokens_13a(F.col(prediction)).alias("p"), tokens_13a(F.col(gold)).alias("g")))

    def counted(side: str, name: str) -> DataFrame:
        named = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))
        grams = F.concat(*[F.transform(ngrams(F.col(side), n), named(n)) for n in range(1, order + 1)])
        return rows.select(*keys, F.explode(grams).alias("x")).select(*keys, "x.n", "x.g").groupBy(*keys, "n", "g").agg(F.count("*").alias(name))

    hits = counted("p", "a").join(counted("g", "b").hint("merge"), [*keys, "n", "g"]).groupBy(*keys).agg(*[F.sum(F.when(F.col("n") == n, F.least("a", "b")).otherwise(0)).alias(f"h{n}") for n in range(1, order + 1)])
    one = rows.select(*keys, F.size("p").alias("_p"), F.size("g").alias("_g")).join(hits.hint("merge"), keys, "left").na.fill(0, [f"h{n}" for n in range(1, order + 1)])
    logs, used, missed = F.lit(0.0), F.lit(0), F.lit(0)
    for n in range(1, order + 1):
        there = F.greatest(F.col("_p") - (n - 1), F.lit(0))
        hit = F.col(f"h{n}")
        missed = missed + F.when((there > 0) & (hit == 0), 1).otherwise(0)
        logs = logs + F.when(there > 0, F.when(hit > 0, F.log(F.greatest(hit, F.lit(1)) / there)).otherwise(-F.log(F.pow(F.lit(2.0), missed) * there))).otherwise(0.0)
        used = used + F.when(there > 0, 1).otherwise(0)
    brevity = F.when(F.col("_p") < F.col("_g"), F.exp(1 - F.col("_g") / F.col("_p"))).otherwise(1.0)
    any_hit = sum((F.col(f"h{n}") for n in range(2, order + 1)), F.col("h1")) > 0
    return one.select(*keys, F.round(F.when(any_hit, brevity * F.exp(logs / used)).otherwise(0.0), 9).alias("bleu"))


def sequence_scores(pairs: DataFrame, key: str, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """key, rouge_l of each pair, by the longest common subsequence; order-dependent, so in Arrow batches."""
    rows = pairs.select(key, tokens(F.col(prediction)).alias("p"), tokens(F.col(gold)).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps, gs = b.column(1).to_pylist(), b.column(2).to_pylist()
            rouge = [2 * n / (len(p) + len(g)) if p and g and (n := lcs(p, g)) else 0.0 for p, g in zip(ps, gs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(rouge, 9))], [key, "rouge_l"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, rouge_l double")


def gains(table: DataFrame, key: str, metric: str, base: str) -> DataFrame:
    """key, gain of each row: its metric over that of the base row, which counts as 1e-9 at least."""
    of = table.where(F.col(key) == base).select(F.greatest(F.col(metric), F.lit(1e-9)).alias("_base"))
    return table.crossJoin(F.broadcast(of.limit(1))).select(key, F.round(F.col(metric) / F.col("_base"), 6).alias("gain"))
