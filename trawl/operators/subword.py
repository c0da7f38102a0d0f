"""Sub-word tokens of a given vocabulary of merges: lengths, windows and clipping by them.

A text is cut into pieces by a pattern, in Spark; a piece's bytes are merged by
rank, the lowest first. Pieces repeat, so each batch merges its different
pieces once and keeps what it learned for the next. Tokens come back as ids and
as the character that each one ends before, from which windows are slices of
the text as it is written.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from trawl.operators.chunk import window_starts
from trawl.sources.store import slices

#: Fixed value: how byte-level vocabularies of this kind part a text; together the pieces are the text.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose tokens a task keeps.
KEPT = 200_000
#: Pieces that are encoded at a time.
PIECES = 1 << 18

Ranks = dict[bytes, int]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Ranks:
    """Tokens and ranks of a vocabulary file: a token in base64, a blank and its rank on a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: Ranks) -> list[bytes]:
    """A piece's tokens: again and again the neighbours of lowest rank become one, the first of equal ones."""
    if piece in ranks:
        return [piece]
    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    gone = [False] * n
    while heap:
        _, i, upto = heapq.heappop(heap)
        # either neighbour may have grown since
        if gone[i] or nxt[i] >= n or end[nxt[i]] != upto:
            continue
        j = nxt[i]
        gone[j], end[i], nxt[i] = True, upto, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = nxt[i]
    return out


def tokens_of(piece: str, ranks: Ranks) -> tuple[list[int], list[int]]:
    """Ids, and before which of the piece's characters each token ends; a character belongs to the token with its first byte."""
    raw = piece.encode()
    found = merged(raw, ranks)
    begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [ranks[t] for t in found], begun[np.cumsum([len(t) for t in found]) - 1].tolist()


def _encoding(ranks: Ranks):
    known: dict[str, tuple[list[int], list[int]]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, whole.num_columns - 1, PIECES)):
            lists = b.column(b.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            found = []
            for p in coded.dictionary.to_pylist():
                if p not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[p] = tokens_of(p, ranks)
                found.append(known[p])
            at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.array([len(f[0]) for f in found], np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            ids, ends = (np.array([x for f in found for x in f[k]], np.int64) for k in (0, 1))
            chars = np.array([f[1][-1] for f in found], np.int64)
            # every piece of every row: where its tokens stand among the different pieces' tokens
            many = n[at]
            pick = np.repeat(first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            upto = np.cumsum(chars[at]) - chars[at] if len(at) else chars
            base = np.concatenate([[0], np.cumsum(np.bincount(row, chars[at], b.num_rows).astype(np.int64))])[:-1]
            starts = np.repeat(upto - base[row], many)
            ends_of_rows = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, many, b.num_rows).astype(np.int64))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends_of_rows, pa.array(x.astype(np.int32))) for x in (ids[pick], ends[pick] + starts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], schema=pa.schema([*(b.schema.field(i) for i in range(b.num_columns - 1)), pa.field("_ids", lists[0].type), pa.field("_ends", lists[1].type)]))

    return run


def encoded(df: DataFrame, ranks: Ranks, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """df with _ids, the tokens of a text, and _ends, before which character each one ends; a null text has none. A vocabulary has all single bytes."""
    rows = df.withColumn("_pieces", F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
    ints = ArrayType(IntegerType())
    schema = StructType([*df.schema.fields, StructField("_ids", ints), StructField("_ends", ints)])
    return rows.mapInArrow(_encoding(ranks), schema)


def n_tokens() -> Column:
    return F.size("_ids")


def subword_lengths(df: DataFrame, ranks: Ranks, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """df with n_tokens in place of the text."""
    rest = [c for c in df.columns if c != text_col]
    return encoded(df, ranks, text_col, pattern).select(*rest, n_tokens().alias("n_tokens"))


def _slice(text: str, first: Column, last: Column) -> Column:
    """The characters of tokens first to last, counted from 1."""
    begin = F.when(first > 1, F.try_element_at("_ends", (first - 1).cast("int"))).otherwise(0)
    return F.substring(F.col(text), begin + 1, F.element_at("_ends", last.cast("int")) - begin)


def subword_windows(df: DataFrame, ranks: Ranks, text_col: str = "text", size: int = 448, overlap: int = 112, pattern: str = PATTERN) -> DataFrame:
    """A row per window of tokens: the other columns, chunk_idx from 0, text, n_tokens. A text that fits one window stays as it is; one without tokens has none."""
    rest = [c for c in df.columns if c != text_col]
    rows = encoded(df, ranks, text_col, pattern).withColumn("_n", n_tokens())
    rows = rows.select(*rest, text_col, "_ends", "_n", F.posexplode(window_starts(F.col("_n"), size, overlap)).alias("chunk_idx", "_at"))
    last = F.least(F.col("_at") + size, F.col("_n"))
    piece = F.when(F.col("_n") <= size, F.col(text_col)).otherwise(_slice(text_col, F.col("_at") + 1, last))
    return rows.select(*rest, "chunk_idx", piece.alias("text"), (last - F.col("_at")).alias("n_tokens"))


def clip_subwords(df: DataFrame, ranks: Ranks, text_col: str = "text", limit: int = 460, pattern: str = PATTERN) -> DataFrame:
    """df with its texts cut after `limit` tokens; a text that is short enough stays as it is."""
    rows = encoded(df, ranks, text_col, pattern)
    cut_ = F.when(n_tokens() <= limit, F.col(text_col)).otherwise(_slice(text_col, F.lit(1), F.lit(limit)))
    return rows.withColumn(text_col, cut_).select(*df.columns)


def tokens_per_word(df: DataFrame, ranks: Ranks, n_words: Column, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """One row: the ratio of all sub-word tokens to all words, null without words."""
    rows = encoded(df, ranks, text_col, pattern).select(n_tokens().alias("t"), n_words.alias("w"))
    return rows.agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0))).alias("tokens_per_word"))
