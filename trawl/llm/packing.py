"""Operator 1: best-fit packing by exact-complement hashing.

Only the histogram of piece lengths decides which lengths share a sequence; it
has at most as many rows as a sequence has tokens, so the driver plans with it
whatever the input. The plan takes lengths from the longest down and looks up
what fills the gap exactly: one length, two or three, as long as each is still
available, and takes that combination as often as the counts allow. What no
combination fills goes into the open sequence with the least room, or a new
one. Pieces are then ranked within their length and the plan's slots are dealt
out by rank; ranks are found within salts of bounded size, so a length that
holds a third of all pieces is spread.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut, parts
from trawl.llm.tokens import by_words

#: Pieces that are ranked in one window at most, on average.
SALT_ROWS = 50_000
#: Bytes that a known word takes, about: its text, its ids and their places; longer ones than 64 characters aren't kept.
ENTRY = 190
#: Bytes of known words in a worker's generation, by default.
KNOWN = 80_000_000
#: A control character, which stands between words that are encoded together.
MARK = "\x01"


class Available:
    """Counts of lengths, and the set of lengths that are left as bits of one number, forwards and backwards; so whether some pair has a sum is one shift."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.count = size, [0] * (size + 1)
        self.bits = self.back = 0
        for k, n in counts.items():
            self.count[k] = n
            if n:
                self.bits |= 1 << k
                self.back |= 1 << (size - k)

    def take(self, k: int, n: int) -> None:
        self.count[k] -= n
        if not self.count[k]:
            self.bits &= ~(1 << k)
            self.back &= ~(1 << (self.size - k))

    def pair(self, total: int, top: int) -> tuple[int, int] | None:
        """Two lengths up to top with that sum, the longest one first."""
        both = self.bits & (self.back >> (self.size - total)) & ((2 << min(top, total - 1)) - 1)
        if total % 2 == 0 and self.count[total // 2] < 2:
            both &= ~(1 << (total // 2))
        a = both.bit_length() - 1
        return (a, total - a) if a > 0 and 2 * a >= total else None

    def fill(self, gap: int, top: int) -> tuple[int, ...] | None:
        """One, two or three lengths up to top that sum to gap; of several the one with the longest first, then the longest second."""
        if gap <= top and self.count[gap]:
            return (gap,)
        if got := self.pair(gap, top):
            return got
        a = min(top, gap - 2)
        while 3 * a >= gap:
            if self.count[a]:
                self.count[a] -= 1
                got = self.pair(gap - a, a if self.count[a] else a - 1)
                self.count[a] += 1
                if got and (got[0] != got[1] or self.count[got[0]] >= 2 + (a == got[0])):
                    return (a, *got)
            a -= 1
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many of them), for a histogram of lengths from 1 to size."""
    left = Available(counts, size)
    out: list[tuple[tuple[int, ...], int]] = []
    rest: list[tuple[int, int]] = []
    for x in range(size, 0, -1):
        while n := left.count[x]:
            left.count[x] -= 1
            got = () if x == size else left.fill(size - x, x if n > 1 else x - 1)
            left.count[x] += 1
            if got is None:
                rest.append((x, n))
                left.take(x, n)
                break
            uses = Counter((x, *got))
            n = min(left.count[k] // u for k, u in uses.items())
            for k, u in uses.items():
                left.take(k, u * n)
            out.append(((x, *got), n))
    # best fit of the rest: sequences by the room that is left, each with how many there are
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    open_ = 0  # rooms that have sequences, as bits
    for x, n in rest:
        while n:
            fit = open_ >> x
            if not fit:
                per = size // x
                for many, times in ((per, n // per), (n % per, 1)):
                    if many and times:
                        room[size - many * x].append(((x,) * many, times))
                        open_ |= 1 << (size - many * x)
                break
            best = x + (fit & -fit).bit_length() - 1
            kind, m = room[best].pop()
            used = min(n, m)
            if m > used:
                room[best].append((kind, m - used))
            if not room[best]:
                open_ &= ~(1 << best)
            room[best - x].append(((*kind, x), used))
            open_ |= 1 << (best - x)
            n -= used
    return out + [p for v in room for p in v]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each run of ranks within a length: length and first rank as one number, in order, then the first rank's sequence and the place in it."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            rows.append((x, taken.get(x, 0), first, at))
            taken[x] = taken.get(x, 0) + n
            at += x
        first += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (a[:, 0] << 44) + a[:, 1], a[:, 2] - a[:, 1], a[:, 3]


class WordIds:
    """A tokenizer's ids for texts, as bytes of little-endian numbers. Where white space always parts tokens, words are looked up one by one, and two generations of known words, of most bytes each, bound the memory; other vocabularies encode whole texts."""

    def __init__(self, spec: str, most: int = KNOWN):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_str(spec), most
        self.apart = by_words(json.loads(spec))
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of words one by one. They go to the library many at a time, between them a mark that is one token and no part of a word; words that hold the mark go alone."""
        if self.mark is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        number = self.mark
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            if any(MARK in w for w in part):
                out += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                continue
            ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == number), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for e in ends:
                out.append(raw[4 * at : 4 * e])
                at = e + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {"": b""}, 0
        known, old = self.young, self.old
        missing = set().union(*split).difference(known)
        long_ = [w for w in missing if len(w) > 64]
        self.size += ENTRY * len(missing)
        new = []
        for w in missing:
            if (x := old.get(w)) is None:
                new.append(w)
            else:
                known[w] = x
        known |= zip(new, self.ids(new), strict=True)
        out = [b"".join([known[w] for w in words]) for words in split]
        for w in long_:
            known.pop(w, None)
        return out


@lru_cache(1)
def word_ids(spec: str, most: int) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(spec, most)


def pieces(df: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, known: int = KNOWN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and the end id after them; documents longer than size are cut every size ids."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(spec, known)
        for whole in batches:
            for b, texts in parts(whole, whole.column(1)):
                who, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(words.encode(texts)):
                    ids += end
                    for p, x in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[x : x + 4 * size]
                        who.append(k)
                        piece.append(p)
                        start.append(x // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut_pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...): sequences hold at most size tokens, gapless from 0.

    The pieces are read several times, so they should come from a table.
    Repeated rows each get a place of their own; a null doc_id is ranked before
    others; an empty table gives none.
    """
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at, base, place = slots(plan(counts, size))
    salts = spark.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in counts.items()] or [(0, 1)], "length long, _salts long")  # at most size rows
    salted = cut_pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *(c for c in ("ids_crc32",) if c in cut_pieces.columns)), F.col("_salts"))).drop("_salts")
    key = Window.partitionBy("length", "_salt")
    ranked = salted.withColumn("_rank", F.row_number().over(key.orderBy("doc_id", "piece", "start")) - 1)
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = ranked.join(sums, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    out = [c for c in cut_pieces.columns]
    ranked = ranked.select(*out, "_rank")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(len(out)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(at, (b.column(out.index("length")).to_numpy(zero_copy_only=False) << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[: len(out)], pa.array(base[k] + rank), pa.array(place[k])], [*out, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.mapInArrow(deal, f"{kinds}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Packs all documents into sequences of at most size tokens; see pieces() and pack(). A null or empty text is one piece of the end id alone."""
    return pack(cut(pieces(df, tokenizer, size, id_col, text_col, known=known)), size)
