"""Operator 8: mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and bucket of a hash of the id. Running sums over a
source's buckets show in which bucket its budget ends; only that bucket's rows
are summed again, by the next bits of the hash, and so on. What comes out is
one threshold per source: rows whose hash is below it are taken once more than
the others. Nothing is sorted but a source's buckets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut, text_or_empty, words_of

#: Bits of the hash that each histogram looks at, and how many there are.
BITS, LEVELS = 10, 4
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for (source, source_size).

    A source whose part by weight is above `most` times its size is held at
    that, and the excess goes to the others by weight: with u = most * size /
    weight, sources in order of u are held until one is above the level of what
    is left. Sources in order of their code points, null last, have the weights
    in turn.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).alias("w"))
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("u", F.col("cap") / F.col("w"))
    by_u = Window.orderBy("u", F.col("source").isNull(), "source")
    upto, whole = by_u.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    held = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - held) / weight)
    # the first source that its level doesn't hold sets the level of all after it
    rows = rows.withColumn("place", F.row_number().over(by_u))
    first = F.min(F.when(F.col("u") > F.col("level"), F.struct("place", "level"))).over(whole)
    rows = rows.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(F.col("w") * F.col("first.level"))
    return rows.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, passes, below: how often each row of a source is taken, and below which hash once more.

    rows: source, size, hash (long, taken as BITS * LEVELS bits). The last
    bucket in which the budget ends is taken if that comes nearer to it.
    """
    need = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.select("source", passes.alias("passes"), F.when(F.col("source_size") > 0, need).otherwise(F.lit(0.0)).alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        now = state.select(F.col("source").alias("_s"), "passes", "left", "prefix")
        # a bounded table for each source: at most 2 ** BITS buckets
        inside = rows.join(now, _same(F.col("source"), F.col("_s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", "passes", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("n"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(order))
        # the first bucket with which the sum passes the budget; after the last one nothing is left to find
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", F.col("upto").alias("u"), "n")))
        end = F.max(F.struct(F.col("bucket"), F.col("upto").alias("u"), F.col("n")))
        state = sums.groupBy("source", "passes", "left").agg(over.alias("o"), end.alias("e"))
        at, before = F.coalesce("o.bucket", F.col("e.bucket")), F.coalesce(F.col("o.u") - F.col("o.n"), F.col("e.u") - F.col("e.n"))
        left = F.col("left") - before
        if level < LEVELS - 1:
            state = cut(state.select("source", "passes", left.alias("left"), at.alias("prefix")))
        else:
            part = F.coalesce("o.n", "e.n")
            state = cut(state.select("source", "passes", (at + F.when(part - left < left, 1).otherwise(0)).alias("below")))
    return state


def _hash(id_col: str) -> Column:
    """BITS * LEVELS bits of a hash that SQL engines have in common; a null id has one too."""
    text = F.concat_ws("-", F.col(id_col).cast("string"), F.lit("mix"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _words(text_col: str) -> Column:
    return F.size(words_of(text_or_empty(text_col))).cast("long")


def plan(rows: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """_s (a source), source_size, target, passes, below, for rows (source, size, hash) that can be read several times."""
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    edge = thresholds(rows, goals).withColumnRenamed("source", "_s")
    found = goals.join(edge, _same(F.col("source"), F.col("_s")), "left")
    return cut(found.select(F.col("source").alias("_s"), "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("below", F.lit(0)).alias("below")))


def _times(hash_col: str, most: float) -> Column:
    return F.least(F.col("passes") + F.when(F.col(hash_col) < F.col("below"), 1).otherwise(0), F.lit(int(most))).cast("int")


def sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(text_col).alias("size")).withColumn("hash", _hash("doc_id")))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times of each row.

    size: words of the text, 0 for null. times: how often the row is in the
    mix, from 0 to `most`; taken: size times that. The hash is of the id, so
    reruns agree and copies of a text are apart; rows that repeat an id are
    taken alike, and so are rows without one. Rows of a null source are a
    source. An empty source has target 0.
    """
    rows = sizes(df, id_col, source_col, text_col)
    out = rows.join(plan(rows, share, most, weights), _same(F.col("source"), F.col("_s"))).withColumn("times", _times("hash", most))
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("times") * F.col("size")).cast("long").alias("taken"), "times")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of a table as often as the mix takes them; its columns stay. Texts aren't shuffled as long as the sources' plan is small enough to broadcast."""
    per_source = plan(sizes(df, id_col, source_col, text_col), share, most, weights)
    rows = df.select(F.struct("*").alias("_row"), F.col(source_col).cast("string").alias("_source"), _hash(id_col).alias("_hash"))
    rows = rows.join(per_source, _same(F.col("_source"), F.col("_s"))).withColumn("_times", _times("_hash", most)).where("_times > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_row.*")
