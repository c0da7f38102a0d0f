"""Operator 13: ranked lexical search by a tree of maxima over document ranges.

One pass over the texts keeps how often each document has the terms that the
items ask for; another over those short rows gives the statistics. Then tasks
search: of each group of documents, in order of length so that neighbours are
alike, every term has its greatest share of a score in each range of LEAF
documents, and in ranges of FAN ranges, up to one range. An item's bound for a
range is the sum of its terms' weights times those shares. Ranges are opened
from the greatest bound, and documents of the smallest ranges are scored, until
no bound is above or equal to the k-th score: a range whose bound equals it may
hold a document of the same score and a lesser id. The k-th score passes on
from one group to the next. What each task finds is ranked once more.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trawl.llm.common import cut, parts

#: Fixed values of the score: shares are of BILLION, a document's length counts 75 of 100.
BILLION, SLOPE = 1_000_000_000, 75
#: Documents of the smallest ranges, and ranges of a larger one.
LEAF, FAN = 16, 8
#: Documents and postings that are searched at a time, and cells of the lowest level of maxima.
GROUP_DOCS, GROUP_POSTINGS, CELLS = 1 << 14, 1 << 22, 1 << 23
#: Characters of the items that are looked for at a time; beyond that the documents are read once for each block of items.
BLOCK_CHARS = 2_000_000

#: Bytes of UTF-8 to what they are in terms: A-Z lower-cased, letters, digits and all beyond ASCII as they are, all else a blank.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return text.translate(_TABLE).split()


class Item(NamedTuple):
    """An item of a block: its number, its id, its terms with how often it has them."""

    number: int
    item_id: object
    terms: np.ndarray
    times: np.ndarray


def _counted(vocabulary: dict[bytes, int], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in parts(b, b.column(1)):
                ids, n, ends, terms, counts = part.column(0), [], [0], [], []
                for t in texts:
                    words = terms_of(t.encode())
                    n.append(len(words))
                    found = Counter(map(vocabulary.get, words))
                    found.pop(None, None)
                    terms += found.keys()
                    counts += found.values()
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
                out = pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pc.greater(out.column(1), 0))

    return run


class Group(NamedTuple):
    """Documents in order of length with their postings, and the maxima over ranges, the smallest ranges first."""

    ids: list
    starts: np.ndarray
    terms: np.ndarray
    shares: np.ndarray
    levels: list[np.ndarray]


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document; whole numbers of any size where 64 bits don't do."""
    if len(n) and SLOPE * int(n.max()) * docs >= 2**63:
        return np.array([100 - SLOPE + SLOPE * int(x) * docs // total for x in n], np.int64)
    return 100 - SLOPE + SLOPE * n * docs // max(total, 1)


def group(ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, width: int, docs: int, total: int) -> Group:
    """width: how many terms there are; sizes: of each document's terms."""
    order = np.argsort(n, kind="stable")
    begun = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begun[order] - np.concatenate([[0], np.cumsum(sizes[order])[:-1]]), sizes[order]) + np.arange(len(terms))
    terms, counts, sizes = terms[at], counts[at].astype(np.int64), sizes[order]
    place = np.repeat(np.arange(len(order)), sizes)
    shares = BILLION * counts // (1000 * counts + 8 * lengths(n[order], docs, total)[place])
    leaves = -(-len(order) // LEAF)
    low = np.zeros((width, leaves), np.int32)
    key = terms.astype(np.int64) * leaves + place // LEAF
    by = np.argsort(key, kind="stable")
    if len(key):
        sorted_ = key[by]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        low.reshape(-1)[sorted_[first]] = np.maximum.reduceat(shares[by], first)
    levels = [low]
    while levels[-1].shape[1] > 1:
        last = levels[-1]
        more = -last.shape[1] % FAN
        levels.append(np.pad(last, ((0, 0), (0, more))).reshape(width, -1, FAN).max(axis=2))
    return Group([ids[i] for i in order], np.concatenate([[0], np.cumsum(sizes)]), terms, shares, levels)


def _rank(found: tuple) -> tuple:
    score, doc = found
    return -score, doc is not None, doc if doc is not None else 0


def search(g: Group, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list[tuple], k: int) -> tuple[list[tuple], int]:
    """best: up to k (score, id) so far, the best first; returned with those of the group, and how many of the smallest ranges were opened. dense: zeros, one for each term, and zeros again at the end."""
    dense[terms] = weights
    heap: list[tuple[int, int, int]] = []
    opened = 0

    def floor() -> int:
        return best[-1][0] if len(best) == k else 1

    def push(level: int, lo: int, hi: int) -> None:
        bounds = weights @ g.levels[level][terms, lo:hi].astype(np.int64)
        least = floor()
        for i, bound in enumerate(bounds.tolist()):
            if bound >= least:
                heapq.heappush(heap, (-bound, level, lo + i))

    top = len(g.levels) - 1
    push(top, 0, 1)
    while heap:
        bound, level, node = heapq.heappop(heap)
        if -bound < floor():
            break
        if level:
            push(level - 1, node * FAN, min((node + 1) * FAN, g.levels[level - 1].shape[1]))
            continue
        opened += 1
        d0, d1 = node * LEAF, min((node + 1) * LEAF, len(g.ids))
        a, b = g.starts[d0], g.starts[d1]
        sums = np.concatenate([[0], np.cumsum(dense[g.terms[a:b]] * g.shares[a:b])])
        scores = sums[g.starts[d0 + 1 : d1 + 1] - a] - sums[g.starts[d0:d1] - a]
        least = floor()
        new = [(s, g.ids[d0 + i]) for i, s in enumerate(scores.tolist()) if s >= least]
        if new:
            best = sorted(best + new, key=_rank)[:k]
    dense[terms] = 0
    return best, opened


def _searched(items: list[Item], weights: np.ndarray, docs: int, total: int, k: int, kind: pa.DataType):
    width = len(weights)
    asked = [(i, i.terms[weights[i.terms] > 0]) for i in items]
    asked = [(i, t, (i.times * weights[i.terms])[weights[i.terms] > 0]) for i, t in asked]
    most = max(LEAF, min(GROUP_DOCS, CELLS // max(width, 1) * LEAF))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        held, rows, posts = [], 0, 0
        dense = np.zeros(width, np.int64)

        def done() -> None:
            nonlocal held, rows, posts
            cols = list(zip(*held, strict=True))
            g = group([i for c in cols[0] for i in c], *(np.concatenate(c) for c in cols[1:]), width, docs, total)
            for item, t, w in asked:
                if len(t):
                    best[item.number], _ = search(g, t, w, dense, best.get(item.number, []), k)
            held, rows, posts = [], 0, 0

        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            at = 0
            while at < batch.num_rows:
                # as many documents as the group has room for, one at least
                begun = ends[at - 1] if at else 0
                room = int(np.searchsorted(ends, begun + GROUP_POSTINGS - posts, side="right"))
                end = min(max(room, at + (not rows)), at + most - rows, batch.num_rows)
                if end > at:
                    b = batch.slice(at, end - at)
                    flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3)]
                    held.append((b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), size[at:end], *flat))
                    rows, posts, at = rows + end - at, posts + int(ends[end - 1] - begun), end
                if at < batch.num_rows:
                    done()
        if rows:
            done()
        out = [(number, doc, score) for number, found in best.items() for score, doc in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.int64())], ["number", "doc_id", "score"])

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """number, doc_id, score of the items in rows (number, item_id, text), ranked within tasks."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    kind, name = to_arrow_type(id_type), id_type.simpleString()
    counts = [Counter(terms_of((r["text"] or "").encode())) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    items = [Item(r["number"], r["item_id"], np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for r, c in zip(rows, counts, strict=True)]
    stored = cut(docs.mapInArrow(_counted(vocabulary, kind), f"doc_id {name}, n long, terms array<int>, counts array<int>"))
    size = stored.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    # one row for each term of the block at most
    for term, df in stored.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():
        weights[term] = weight(size["docs"], df)
    return stored.mapInArrow(_searched(items, weights, size["docs"], size["total"] or 0, k, kind), f"number long, doc_id {name}, score long") if len(vocabulary) else spark.createDataFrame([], f"number long, doc_id {name}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, if they score above 0.

    Terms are runs of letters and digits of ASCII, A-Z lower-cased, and of all
    characters beyond it; a null text has none. Equal scores come by ascending
    id, a null id first. Rows that repeat a document's id are documents of
    their own, and so are items; an item without a term that some but not all
    documents have gets no rows. Other columns play no part. Items are read in
    blocks of about block_chars characters, whose terms every task holds.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mine = cut(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")))
    chars = mine.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = None
    for i in range(blocks):
        rows = mine.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == i).collect()
        part = _block(texts, rows, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    top = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return top.join(mine.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
