"""Where models plug in: texts to vectors, pairs of texts to scores.

A model is a function of a list; it is made once in each task, from a maker
that Spark can send. Each different text, or pair of texts, goes to it once, in
batches of the size that it wants, and what it says is joined back by a digest
of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import as_query
from trawl.sources.store import cut

#: Texts and pairs that a model is given at a time.
BATCH, PAIRS = 128, 64

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], np.ndarray]


def _digest(*texts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of `size` rows, across the borders of batches; the last is smaller."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        while rows >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, size).combine_chunks().to_batches()[0]
            held, rows = whole.slice(size).to_batches(), rows - size
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(df: DataFrame, maker: Callable[[], Encoder], text_col: str = "text", name: str = "embedding", batch: int = BATCH, normalised: bool = True, queries: bool = False) -> DataFrame:
    """df with a vector of floats for each text, null for a null text; to length 1 if normalised, a vector of zeros staying so. queries: the instruction that goes before queries is put before the text."""
    text = F.col(text_col).cast("string")
    told = as_query(text) if queries else text
    keyed = df.withColumn("_k", _digest(told))
    texts = keyed.where(F.col(text_col).isNotNull()).select("_k", told.alias("_t")).dropDuplicates(["_k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in _slices(batches, batch):
            model = model or maker()
            v = np.asarray(model(b.column(1).to_pylist()), np.float32)
            if normalised:
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(norm > 0, norm, 1)
            flat = pa.array(v.reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), flat)], ["_k", name])

    vectors = cut(texts.mapInArrow(run, f"_k string, `{name}` array<float>"))
    return keyed.join(vectors, "_k", "left").drop("_k")


def score_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, maker: Callable[[], Scorer], batch: int = PAIRS) -> DataFrame:
    """qid, chunk_id, score of given pairs by a model that reads both texts; a pair without either text has none."""
    q, c = queries.select("qid", F.col("text").alias("_q")), corpus.select("chunk_id", F.col("text").alias("_c"))
    both = pairs.select("qid", "chunk_id").distinct().join(q, "qid").join(c, "chunk_id").where("_q IS NOT NULL AND _c IS NOT NULL").withColumn("_k", _digest(F.col("_q"), F.col("_c")))
    both = cut(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in _slices(batches, batch):
            model = model or maker()
            scores = np.asarray(model(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))), np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], ["_k", "score"])

    scores = both.select("_k", "_q", "_c").dropDuplicates(["_k"]).mapInArrow(run, "_k string, score double")
    return both.select("_k", "qid", "chunk_id").join(scores, "_k").select("qid", "chunk_id", "score")


def hashed_words(dim: int = 64) -> Callable[[], Encoder]:
    """A stand-in for a neural encoder: each lower-case word adds 1 or -1 at a place that its hash names."""

    def maker() -> Encoder:
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out

        return model

    return maker
