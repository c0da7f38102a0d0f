"""Filters, semi and anti joins, quantifiers and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import not_blank


def with_gold(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def with_gold_and_answer(queries: DataFrame, qrels: DataFrame, answers: DataFrame) -> DataFrame:
    return with_gold(queries, qrels).join(answers.where(not_blank(F.col("answer"))).select("qid").distinct(), "qid", "left_semi")


def not_gold(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"], "left_anti")


def without_ambiguous(queries: DataFrame, resolved: DataFrame) -> DataFrame:
    return queries.join(resolved.where("ambiguous").select("qid"), "qid", "left_anti")


def assign_sides(qrels: DataFrame, sides: DataFrame) -> DataFrame:
    """qid and the side that all its gold is on: "train", "test" or "spanning". qrels have filing; sides are (filing, side)."""
    at = qrels.select("qid", "filing").distinct().join(sides, "filing")
    return at.groupBy("qid").agg(F.bool_and(F.col("side") == "train").alias("a"), F.bool_and(F.col("side") == "test").alias("b")).select("qid", F.when(F.col("a"), "train").when(F.col("b"), "test").otherwise("spanning").alias("side"))


def drift(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Filings that one of two lists lacks: (filing, change), "missing" from now or "extra" in it."""
    a, b = frozen.select("filing").distinct(), now.select("filing").distinct()
    gone = a.join(b, "filing", "left_anti").select("filing", F.lit("missing").alias("change"))
    return gone.unionByName(b.join(a, "filing", "left_anti").select("filing", F.lit("extra").alias("change")))


def neighbours(gold: DataFrame, reach: int = 1) -> DataFrame:
    """qid, filing, chunk_idx of gold chunks and those up to `reach` beside them: an equi-join's keys instead of a range."""
    return gold.select("qid", "filing", F.explode(F.sequence(F.col("chunk_idx") - reach, F.col("chunk_idx") + reach)).alias("chunk_idx")).distinct()


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def per_query_counts(qrels: DataFrame) -> DataFrame:
    """One row: mean and median number of relevant chunks of a query, and how many queries have any."""
    n = qrels.groupBy("qid").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_chunks"), F.expr("percentile(n, 0.5)").alias("median_chunks"), F.count("*").alias("n_queries"))


def percentage(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")) * 100, 6)


def ladder(df: DataFrame, value: str, steps: tuple[float, ...] = (0.9, 0.7, 0.5, 0.3)) -> DataFrame:
    """How many rows reach each step, and how many don't reach the last."""
    counts = [F.count_if(F.col(value) >= s).alias(f"at_least_{int(100 * s)}") for s in steps]
    return df.agg(*counts, F.count_if(F.col(value) < steps[-1]).alias("below"), F.count("*").alias("n"))


def first_by_position(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, position).alias(value))


def hold_out_last(df: DataFrame, position: str, n: int) -> DataFrame:
    """Adds side: "test" for the n rows with the highest positions, else "train". The boundary is found by a top-n, nothing is sorted as a whole."""
    last = df.orderBy(F.desc(position)).limit(n).agg(F.min(position).alias("_from"))
    return df.join(F.broadcast(last)).withColumn("side", F.when(F.col(position) >= F.col("_from"), "test").otherwise("train")).drop("_from")


def first_n(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.orderBy(position).limit(n)
