"""Splits by filing: seeded and frozen, or by a hash that SQL can repeat."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.select import assign_sides, drift
from trawl.sources.io import require_empty


def seeded(spark: SparkSession, filings: list[str], seed: int = 42, test_frac: float = 0.2) -> DataFrame:
    """filing, side: a seeded shuffle of the sorted names, the first part is the test side; at least one."""
    names = sorted(set(filings))
    random.Random(seed).shuffle(names)
    n = max(1, int(test_frac * len(names)))
    rows = [(f, "test" if k < n else "train") for k, f in enumerate(names)]
    return spark.createDataFrame(rows, "filing string, side string")


def hash_side(filing: Column, test_percent: int = 20) -> Column:
    """A side from the md5 of a name: grows with the corpus without moving any filing."""
    mark = F.conv(F.substring(F.md5(filing.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(mark % 100 < test_percent, "test").otherwise("train")


def by_hash(filings: DataFrame, test_percent: int = 20) -> DataFrame:
    return filings.select("filing").distinct().select("filing", hash_side(F.col("filing"), test_percent).alias("side"))


def frozen_or_new(frozen: DataFrame | None, spark: SparkSession, filings: DataFrame, seed: int = 42, test_frac: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(the split, its drift): a split that exists is never drawn again."""
    if frozen is None:
        # names of filings, a few hundred; larger corpora take by_hash()
        frozen = seeded(spark, [r["filing"] for r in filings.select("filing").distinct().collect()], seed, test_frac)
    return frozen, drift(frozen, filings)


def side_tables(qrels: DataFrame, queries: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """qrels and queries with their side, grades as they were. A question whose gold spans sides is an error."""
    at = assign_sides(qrels, sides)
    require_empty(at.where("side = 'spanning'"), "gold on both sides")
    return qrels.join(at, "qid"), queries.join(at, "qid")
