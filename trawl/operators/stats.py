"""Bootstrap intervals of means and paired differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.sources.order import numbered
from trawl.sources.store import cut

#: How many resamples, and the generator's seed.
N_BOOT, SEED = 1000, 42
#: Numbers of the generator's stream that a task looks through at a time, and values in a block.
STRETCH, BLOCK = 1 << 20, 1 << 15


def stream(seed: int, begin: int, count: int) -> np.ndarray:
    """Numbers begin to begin + count of the stream of 32-bit numbers that NumPy's default generator draws from: the low half of each 64-bit number, then the high one. The generator jumps to them."""
    bits = np.random.PCG64(seed)
    bits.advance(begin // 2)
    raw = bits.random_raw(count // 2 + 2).astype("<u8").view("<u4")
    return raw[begin % 2 : begin % 2 + count].astype(np.uint64)


def accepted(raw: np.ndarray, n: int) -> np.ndarray:
    """The numbers below n that a stretch of the stream gives: a product's upper half, unless its lower half is among those that would make some numbers likelier."""
    product = raw * np.uint64(n)
    return (product >> np.uint64(32)).astype(np.int64)[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((2**32 - n) % n)]


def _starts(spark, size: int, n: int, seed: int, rows: int) -> DataFrame:
    """b, rows, begin, skip: for each block of resamples where in the stream it begins, and how many accepted numbers of there come before.

    Some numbers of the stream are refused, so tasks first count the accepted
    ones in stretches of it: one number for each stretch comes back.
    """
    want = size * n
    if (2**32 - size) % size == 0:
        return spark.createDataFrame([(b, min(rows, n - b), b * size, 0) for b in range(0, n, rows)], "b long, rows long, begin long, skip long")
    many = -(-want // STRETCH) + 1
    while True:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(accepted(stream(seed, i * STRETCH, STRETCH), size)) for i in ids], pa.int64())], ["id", "n"])

        counts = [r["n"] for r in spark.range(many).mapInArrow(count, "id long, n long").orderBy("id").collect()]
        upto = np.concatenate([[0], np.cumsum(counts)])
        if upto[-1] >= want:
            break
        # as many again: only for tiny odds
        many *= 2
    at = np.arange(0, n, rows)
    k = np.searchsorted(upto, at * size, side="right") - 1
    return spark.createDataFrame([(int(b), min(rows, n - int(b)), int(s) * STRETCH, int(b * size - upto[s])) for b, s in zip(at, k, strict=True)], "b long, rows long, begin long, skip long")


def resample_counts(spark, size: int, n: int = N_BOOT, seed: int = SEED, rows: int | None = None) -> DataFrame:
    """b, block, counts: how often each place of a block of places is drawn in resample b, all from one matrix of n by size draws, each task drawing its own `rows` of it, about STRETCH numbers unless given."""
    block = BLOCK
    rows = rows or min(n, max(1, STRETCH // size))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, skip, left = r["begin"], r["skip"], np.zeros(0, np.int64)
                for b in range(r["b"], r["b"] + r["rows"]):
                    counts, missing = np.zeros(size, np.int64), size
                    while missing:
                        if not len(left):
                            left = np.zeros(STRETCH, np.int64) if size == 1 else accepted(stream(seed, at, STRETCH), size)
                            at += STRETCH
                            left, skip = left[skip:], max(skip - len(left), 0)
                        take = min(missing, len(left))
                        counts += np.bincount(left[:take], minlength=size)
                        left, missing = left[take:], missing - take
                    lists = [counts[x : x + block] for x in range(0, size, block)]
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(lists), pa.int64()), pa.array(range(len(lists)), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["b", "block", "counts"])

    starts = _starts(spark, size, n, seed, rows)
    return starts.repartition(-(-n // rows), "b").mapInArrow(draw, "b long, block long, counts array<long>")


def bootstrap(per: DataFrame, metric: str, n: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """system, mean, lo, hi: percentile intervals from one matrix of resamples that all systems with as many queries share, the one that NumPy's generator gives.

    Queries are numbered in order within a system and values kept in blocks of
    places; tasks draw rows of the matrix, and sums of counts times values are
    added over blocks. No task holds a system's values or the matrix.
    """
    spark = per.sparkSession
    # ranges are found by looking at the rows first
    rows = numbered(cut(per.select("system", "qid", F.col(metric).cast("double").alias("v"))), "system", "qid")
    sizes = cut(rows.groupBy("system").agg(F.count("*").alias("size"), F.min("pos").alias("first"), F.avg("v").alias("mean")))
    place = F.col("pos") - F.col("first")
    values = rows.join(sizes, "system").select("system", "size", F.floor(place / BLOCK).alias("block"), F.struct(place.alias("p"), "v").alias("x"))
    # a row holds a block's values
    values = cut(values.groupBy("system", "size", "block").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("v")))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(batch.column(2)[i].values.to_numpy() @ batch.column(3)[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64())], ["system", "b", "s"])

    out = None
    # a pass for each number of queries that systems have; mostly it is one
    for (size,) in sizes.select("size").distinct().collect():
        draws = resample_counts(spark, size, n, seed)
        both = draws.join(values.where(F.col("size") == size), "block").select("system", "b", "counts", "v")
        means = both.mapInArrow(part, "system string, b long, s double").groupBy("system", "b").agg((F.sum("s") / size).alias("m"))
        ends = means.groupBy("system").agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))
        out = ends if out is None else out.unionByName(ends)
    if out is None:
        return spark.createDataFrame([], "system string, mean double, lo double, hi double")
    return sizes.join(out, "system").select("system", "mean", "lo", "hi")


def resampled_means(v: np.ndarray, n: int = N_BOOT, seed: int = SEED) -> np.ndarray:
    """Means of n resamples of one vector where it is; the same rows for every vector of one length. NaN without values."""
    draw = np.random.default_rng(seed)
    return np.array([v[draw.integers(0, len(v), size=len(v))].mean() for _ in range(n)]) if len(v) else np.full(n, np.nan)


def deltas(per: DataFrame, metric: str, pairs: list[tuple[str, str]], n: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """a, b, delta, lo, hi, significant: paired differences a - b over the queries that both have; significant if 0 is outside."""
    spark = per.sparkSession
    wanted = spark.createDataFrame(pairs, "a string, b string")
    x = per.select(F.col("system").alias("a"), "qid", F.col(metric).cast("double").alias("x"))
    y = per.select(F.col("system").alias("b"), "qid", F.col(metric).cast("double").alias("y"))
    diff = x.join(F.broadcast(wanted), "a").join(y, ["b", "qid"]).select(F.concat_ws("\t", "a", "b").alias("system"), "qid", (F.col("x") - F.col("y")).alias("d"))
    out = bootstrap(diff, "d", n, seed)
    ends = F.split("system", "\t")
    return out.select(ends[0].alias("a"), ends[1].alias("b"), F.col("mean").alias("delta"), "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


def hashed_bootstrap(per: DataFrame, metric: str, n: int = 200) -> DataFrame:
    """The same interval with resamples that SQL can repeat: draw j of resample b takes the query whose place is a number mixed from b and j.

    A query's weight is how often it is drawn, so a resample is a weighted
    mean; nothing is gathered in one task.
    """
    per = cut(per.select("system", "qid", F.col(metric)))
    q = numbered(per.select("qid").distinct(), "qid", name="place")
    size = q.count()
    draws = per.sparkSession.range(n).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(size - 1, 0)))).alias("j"))
    mixed = ((F.col("b") * 1_000_003 + F.col("j") * 7_919 + 17) * 48_271) % 2_147_483_647
    weights = draws.select("b", (mixed % max(size, 1)).alias("place")).groupBy("b", "place").agg(F.count("*").alias("w"))
    means = weights.join(q, "place").join(per.select("system", "qid", F.col(metric).alias("v")), "qid").groupBy("system", "b").agg((F.sum(F.col("w") * F.col("v")) / size).alias("m"))
    return means.groupBy("system").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.expr("percentile(m, 0.025)"), 6).alias("lo"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("hi"))
