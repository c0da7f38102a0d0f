"""Helpers that several operators share: cutting lineage, joins on hot keys, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.sources.store import cut

#: Words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
SPACE = "\\x20\\x09-\\x0D"

#: A key counts as hot when it holds more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 1000

#: Below this many rows a key is never hot.
HOT_LEAST = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most_rows: int = 1000) -> None:
    """Lowers how many rows an Arrow batch has, since rows of a corpus are whole texts. Registered queries and stages call it; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most_rows:
        spark.conf.set(key, str(most_rows))


def parts(batch: pa.RecordBatch, texts: pa.Array, most_bytes: int = 1 << 21, most_rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch and the texts of its rows in slices of about most_bytes of text, so that only a slice at a time becomes Python objects. A null text is empty; a text that is longer than that has a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        begun = int(ends[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, begun + most_bytes, side="right"))), at + most_rows)
        yield batch.slice(at, end - at), [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def text_field(rows: pa.StructArray, name: str) -> pa.Array:
    """A column of rows that came as structs, as text."""
    found = pc.struct_field(rows, [rows.type.get_field_index(name)])
    return found if pa.types.is_string(found.type) else found.cast(pa.string())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, empty for none."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right on key, where right has a key once and in `rows` how many rows of left have it.

    Keys with more than total / HOT_SHARE rows number below HOT_SHARE, so they
    are broadcast; rows of such a key never meet in one task. Others are
    shuffled as usual. A null key joins with a null key.
    """
    hot = (F.col(rows) > max(HOT_LEAST, total // HOT_SHARE)).alias("_hot")
    top = right.where(hot).drop(rows)
    rest = right.where(~hot).drop(rows)
    mine = top.select(F.col(key).alias("_k"))
    some = left[key].eqNullSafe(mine["_k"])
    cold = left.join(F.broadcast(mine), some, "left_anti")
    out_cols = [*left.columns, *[c for c in rest.columns if c != key]]

    def meet(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        b = b.withColumnRenamed(key, "_k")
        return a.join(b, a[key].eqNullSafe(b["_k"]), kind).select(*out_cols)

    return meet(left, F.broadcast(top), "inner").unionByName(meet(cold, rest, how))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b), ids being long.

    Large-star and small-star steps alternate until nothing changes; each
    needs a minimum per node, which is summed up before it is shuffled, and a
    join of the edges to it, whose hot nodes AQE splits. Each round is written
    to the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        far = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(far.distinct())
        near = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(near, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.unionByName(near.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
