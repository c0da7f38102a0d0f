"""Moments and exact percentiles of the inner products of all pairs, without a row for each pair.

Vectors are cut into blocks, and every two blocks meet under a key of their
own, so that products are matrices of a bounded size. A first pass adds up
moments and a histogram. Ranks of percentiles lie in known bins; those are cut
finer, pass by pass, until what is in them is few, and only that is looked at
value by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.sources.order import numbered
from trawl.sources.store import cut

#: Vectors of a block, bins of a histogram, values that are looked at one by one, and how often bins are cut finer at most.
BLOCK, BINS, FEW, LEVELS = 512, 4096, 100_000, 4


class Bin(NamedTuple):
    """Values from lo to below hi, up to hi itself in the last bin of all; before: how many are below lo."""

    lo: float
    hi: float
    last: bool
    before: int
    n: int


def meetings(vectors: DataFrame, id_col: str, vector_col: str, block: int = BLOCK) -> tuple[DataFrame, float]:
    """Rows (same, x, y) of two blocks' vectors one after the other, every two blocks once and each with itself, and the greatest squared length. Null vectors are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    placed = numbered(rows, F.xxhash64("id"), "id").withColumn("b", F.floor(F.col("pos") / block))
    # a block is a bounded array, each pair of blocks a key
    blocks = cut(placed.groupBy("b").agg(F.flatten(F.array_sort(F.collect_list("v"))).alias("v"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")))
    size = blocks.agg(F.count("*").alias("n"), F.max("most").alias("most")).first()
    partner = F.explode(F.sequence(F.lit(0), F.lit(max(size["n"] - 1, 0)))).alias("o")
    sent = blocks.select("b", "v", partner).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.struct("b", "v").alias("x"))
    both = sent.groupBy("i", "j").agg(F.array_sort(F.collect_list("x")).alias("m"))
    met = both.select((F.col("i") == F.col("j")).alias("same"), F.element_at("m", 1)["v"].alias("x"), F.element_at("m", -1)["v"].alias("y"))
    return met, float(size["most"] or 0.0)


def _products(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for i in range(batch.num_rows):
        x, y = (batch.column(c)[i].values.to_numpy().reshape(-1, dim) for c in (1, 2))
        s = x @ y.T
        yield s[np.triu_indices(len(x), 1)] if batch.column(0)[i].as_py() else s.reshape(-1)


def _histogram(bins: list[Bin], dim: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(bins), count), np.int64)
        n, total, squares = 0, 0.0, 0.0
        for batch in batches:
            for s in _products(batch, dim):
                n, total, squares = n + len(s), total + float(s.sum()), squares + float(s @ s)
                for k, b in enumerate(bins):
                    mine = s[(s >= b.lo) & ((s < b.hi) | (b.last & (s <= b.hi)))]
                    counts[k] += np.bincount(np.searchsorted(_edges(b, count), mine, side="right") - 1, minlength=count)[:count]
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *k.tolist()], pa.int32()), pa.array([0, *at.tolist()], pa.int32()), pa.array([n, *counts[k, at].tolist()], pa.int64()), pa.array([total] + [0.0] * len(k)), pa.array([squares] + [0.0] * len(k))], ["k", "bin", "n", "s", "q"])

    return run


def _edges(b: Bin, count: int) -> np.ndarray:
    """Where the parts of a bin begin."""
    return b.lo + (b.hi - b.lo) * (np.arange(count) / count)


def _parts(b: Bin, counts: dict[int, int], ranks: list[int], count: int) -> list[Bin]:
    """The parts of a bin that hold ranks, of all values in order."""
    edges, out, before = _edges(b, count), [], b.before
    for at in sorted(counts):
        n = counts[at]
        if any(before <= r < before + n for r in ranks):
            hi = float(edges[at + 1]) if at + 1 < count else b.hi
            out.append(Bin(float(edges[at]), hi, b.last and at + 1 == count, before, n))
        before += n
    return out


def pair_geometry(vectors: DataFrame, id_col: str, vector_col: str = "embedding", tails: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """One row: n_pairs, mean_cos, std_cos and two percentiles, p5 and p95, of the inner products of all pairs of vectors, which are cosines if they have length 1. Percentiles are exact, between neighbours in proportion; all null but the number for less than two vectors."""
    spark = vectors.sparkSession
    met, most = meetings(vectors, id_col, vector_col)
    met = cut(met)
    dims = met.select(F.size("x").alias("n")).first()
    ddl = "n_pairs long, mean_cos double, std_cos double, p5 double, p95 double"
    first = vectors.where(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("d")).first()
    if dims is None or first is None:
        return spark.createDataFrame([(0, None, None, None, None)], ddl)
    dim, edge = first["d"], most * (1 + 1e-9) + 1e-300
    bins, ranks, moments = [Bin(-edge, edge, True, 0, 0)], [], None
    for _ in range(LEVELS):
        found = met.mapInArrow(_histogram(bins, dim, BINS), "k int, bin int, n long, s double, q double").groupBy("k", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
        if moments is None:
            moments = next((r["n"], r["s"], r["q"]) for r in found if r["k"] == -1)
            if not moments[0]:
                return spark.createDataFrame([(0, None, None, None, None)], ddl)
            ranks = sorted({int(f(p * (moments[0] - 1))) for p in tails for f in (np.floor, np.ceil)})
        by: dict[int, dict[int, int]] = {}
        for r in found:
            if r["k"] >= 0:
                by.setdefault(r["k"], {})[r["bin"]] = r["n"]
        bins = [part for k, b in enumerate(bins) for part in _parts(b, by.get(k, {}), ranks, BINS)]
        if sum(b.n for b in bins) <= FEW:
            break

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _products(batch, dim):
                for k, b in enumerate(bins):
                    v, n = np.unique(s[(s >= b.lo) & ((s < b.hi) | (b.last & (s <= b.hi)))], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(v), pa.array(n.astype(np.int64))], ["k", "v", "n"])

    held = met.mapInArrow(single, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).orderBy("k", "v").collect()
    at = {}
    for k, b in enumerate(bins):
        upto = b.before
        for r in held:
            if r["k"] == k:
                at |= {rank: r["v"] for rank in ranks if upto <= rank < upto + r["n"]}
                upto += r["n"]

    def percentile(p: float) -> float:
        place = p * (moments[0] - 1)
        lo, hi = int(np.floor(place)), int(np.ceil(place))
        return at[lo] if lo == hi else (hi - place) * at[lo] + (place - lo) * at[hi]

    mean = moments[1] / moments[0]
    std = max(moments[2] / moments[0] - mean * mean, 0.0) ** 0.5
    return spark.createDataFrame([(moments[0], round(mean, 6), round(std, 6), *(round(percentile(p), 6) for p in tails))], ddl)
