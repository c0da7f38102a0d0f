"""Exact dense top-k by blocks of vectors with a centre and a radius.

No vector of a block has a larger inner product with a query than the centre
has, plus the query's length times the radius. A query skips blocks whose bound
is below its k-th score so far; it begins with the k-th score among a sample of
the corpus, which is never above the final one, and passes it on from block to
block. What is scored is one matrix product for the queries that need a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from trawl.operators.blockmax import NEAR, Best
from trawl.sources.store import cut

#: Vectors of a block, of the sample that cells and first thresholds come from, and most cells.
BLOCK_ROWS, SAMPLE, MOST_CELLS = 512, 8192, 1024
#: Numbers in the query vectors that are searched for at a time; beyond that blocks are read once for each part.
QUERY_NUMBERS = 1 << 22


class VectorIndex(NamedTuple):
    """blocks: ids, flat, center, radius; a sample of the corpus: ids and vectors."""

    blocks: DataFrame
    ids: list
    sample: np.ndarray
    id_type: DataType


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cells(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k centres of a sample by Lloyd's rounds; a centre without vectors stays."""
    centers = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        at = nearest_cell(sample, centers)
        sums, n = np.zeros_like(centers), np.bincount(at, minlength=k)
        np.add.at(sums, at, sample)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest_cell(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * v @ centers.T, axis=1)


def _assigned(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest_cell(v, centers).astype(np.int32)) if len(v) else pa.array([], pa.int32())], ["chunk_id", "v", "cell"])

    return run


def _packed(rows: int):
    """Neighbouring vectors of one cell as blocks."""

    def block(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        center = v.mean(axis=0)
        radius = float(np.sqrt(((v - center) ** 2).sum(axis=1)).max())
        # sums in another order must not come out above the bound
        radius += 1e-9 * (1 + radius + float(np.abs(center).sum()))
        flat = pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), flat, pa.ListArray.from_arrays(pa.array([0, len(center)], pa.int32()), pa.array(center)), pa.array([radius])], ["ids", "flat", "center", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False)
            v = _matrix(b.column(1))
            edges = np.flatnonzero(np.diff(cell)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)], strict=True):
                for at in range(lo, hi, rows):
                    end = min(at + rows, hi)
                    yield block(b.column(0).slice(at, end - at), v[at:end])

    return run


def vector_index(corpus: DataFrame, vector_col: str = "embedding", rows: int = BLOCK_ROWS, sample: int = SAMPLE, stored: bool = True) -> VectorIndex:
    """Blocks of a corpus (chunk_id, a vector; null vectors are left out).

    stored: vectors are grouped by the nearest of up to MOST_CELLS centres of a
    sample and written, for searches that come again; a cell of any size lies in
    several tasks. Otherwise blocks are made where the vectors are, as they come.
    """
    all_rows = corpus.select("chunk_id", F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    picked = all_rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toArrow().combine_chunks()
    ids = picked.column(0).to_pylist()
    known = _matrix(picked.column(1).chunk(0)) if ids else np.zeros((0, 1))
    kind = corpus.schema["chunk_id"].dataType
    ddl = f"ids array<{kind.simpleString()}>, flat array<double>, center array<double>, radius double"
    if not stored:
        blocks = all_rows.withColumn("cell", F.lit(0)).mapInArrow(_packed(rows), ddl)
    else:
        n = all_rows.count()
        centers = cells(known, max(1, min(n // rows, len(ids) // 8, MOST_CELLS))) if ids else np.zeros((1, 1))
        named = all_rows.mapInArrow(_assigned(centers), f"chunk_id {kind.simpleString()}, v array<double>, cell int")
        ordered = named.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell")
        blocks = cut(ordered.mapInArrow(_packed(rows), ddl))
    return VectorIndex(blocks, ids, known, kind)


def _first_floors(ids: list, queries: np.ndarray, index: VectorIndex, k: int, same: bool) -> np.ndarray:
    """The k-th score of each query among the sample."""
    if len(index.ids) < k + 1:
        return np.full(len(queries), -np.inf)
    out = np.empty(len(queries))
    own = {c: i for i, c in enumerate(index.ids)}
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ index.sample.T
        if not same:
            for i, q in enumerate(ids[at : at + 512]):
                if q in own:
                    s[i, own[q]] = -np.inf
        out[at : at + 512] = np.partition(s, -k, axis=1)[:, -k]
    return out - NEAR


def _searching(ids: list, q: np.ndarray, floors: np.ndarray, k: int, same: bool, kinds: tuple[pa.DataType, pa.DataType]):
    norms = np.sqrt((q * q).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, f) for f in floors.tolist()]
        floor = floors.copy()
        there, scored = 0, np.zeros(len(ids), np.int64)
        for b in batches:
            bounds = q @ _matrix(b.column(2)).T + norms[:, None] * b.column(3).to_numpy()
            there += b.num_rows
            # blocks that some query likes most come first, so that thresholds rise early
            for i in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
                need = np.flatnonzero(bounds[:, i] >= floor - NEAR)
                if not len(need):
                    continue
                scored[need] += 1
                names = np.array(b.column(0)[i].as_py(), object)
                v = b.column(1).slice(i, 1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
                s = q[need] @ v.T
                near = s >= floor[need, None] - NEAR
                for r in np.flatnonzero(near.any(axis=1)).tolist():
                    some = near[r] if same else near[r] & (names != ids[need[r]])
                    best[need[r]].add(s[r][some], names[some])
                    floor[need[r]] = best[need[r]].floor
        for i, name in enumerate(ids):
            n = len(best[i].ids)
            told = lambda v, n=n: pa.array([None] * n + [int(v)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * (n + 1), kinds[0]), pa.array([*best[i].ids.tolist(), None], kinds[1]), pa.array([*best[i].scores.tolist(), None], pa.float64()), told(there), told(scored[i])], ["qid", "chunk_id", "score", "blocks", "blocks_scored"])

    return run


def search(queries: DataFrame, index: VectorIndex, k: int, vector_col: str = "embedding", same: bool = False) -> DataFrame:
    """qid, chunk_id, score of each task's best for each query, and rows with a null chunk_id that say how many blocks a task held and scored. Queries with a null vector have none."""
    spark = queries.sparkSession
    rows = cut(queries.select("qid", F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL"))
    types = rows.schema["qid"].dataType, index.id_type
    kinds = tuple(map(to_arrow_type, types))
    ddl = f"qid {types[0].simpleString()}, chunk_id {types[1].simpleString()}, score double, blocks long, blocks_scored long"
    many = max(1, -(-(rows.agg(F.sum(F.size("v"))).first()[0] or 0) // QUERY_NUMBERS))
    out = None
    for part in range(many):
        asked = rows.where(F.pmod(F.xxhash64("qid"), F.lit(many)) == part).toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        ids, q = asked.column(0).to_pylist(), _matrix(asked.column(1).chunk(0))
        found = index.blocks.mapInArrow(_searching(ids, q, _first_floors(ids, q, index, k, same), k, same, kinds), ddl)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], ddl) if out is None else out


def hits(found: DataFrame) -> DataFrame:
    return found.where(F.col("chunk_id").isNotNull()).select("qid", "chunk_id", "score")


def reads(found: DataFrame) -> DataFrame:
    """qid, blocks, blocks_scored."""
    return found.where(F.col("chunk_id").isNull()).groupBy("qid").agg(F.sum("blocks").alias("blocks"), F.sum("blocks_scored").alias("blocks_scored"))
