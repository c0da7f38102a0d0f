"""A corpus from raw documents to packed sequences, stage by stage.

Each stage works on all that the one before it kept. STAGES holds (name,
function); a function takes (spark, docs, sf_dir) and returns a table with the
columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from trawl.llm.common import cut, small_batches, table
from trawl.llm.mixing import mixed_rows
from trawl.llm.packing import pack_documents
from trawl.llm.quality import good_rows
from trawl.llm.queries import vocabulary
from trawl.llm.simhash import without_near_duplicates
from trawl.llm.toxicity import without_toxic


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. Rows that repeat are judged alike; an empty table stays empty; a null source is a source; further columns stay, whatever their names."""
    return good_rows(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. The model is fitted on the labelled ones of the stage's input; without any nothing goes. Null and empty texts have no window and score as texts without savings; rows that repeat share their fate; further columns stay, whatever their names."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id. Null and empty texts are copies of each other; rows without an id stay; rows that repeat the smallest id all stay; further columns stay, whatever their names."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes them: not at all, once or twice. Rows that repeat an id are taken alike; a null source is a source; null and empty texts have no words and no weight; further columns stay, whatever their names."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens. Rows that repeat have a place each; a null or empty text is one piece of the end id."""
    # fewer known words than by default: executors still hold what the stages before this one left
    return pack_documents(docs, vocabulary(), 2048, known=40_000_000)


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that lowers the rows of Arrow batches before it plans."""

    @wraps(function)
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return function(spark, docs, sf_dir)

    return apply


STAGES = [("quality_rules", stage(quality_rules)), ("toxicity", stage(toxicity)), ("simhash_near_dedup", stage(near_dedup)), ("mixing", stage(mixing)), ("best_fit_packing", stage(packing))]

#: SQL can't express compression distances, SimHash or packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = cut(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
