"""Operator 4: SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two bits; their bit counts are a
point, and the Manhattan distance of two points is at most the Hamming distance
of their fingerprints. With the segments dealt into 4 + spare groups, points
within distance 4 differ in at most 4 groups, so they agree in at least `spare`
whole groups: each choice of that many groups is a grid, and its cells hold the
points that agree there. `spare` follows the number of fingerprints, so that
cells stay small. Of what shares a cell, pairs whose points are within Manhattan
distance 4 are verified bit by bit. Cells with too many rows are cut into blocks that meet two by two. Every
task returns a forest over what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import components, cut, join_hot, parts

#: Most rows of a cell that meet in one block.
BLOCK = 4096
#: Runs up to this length are compared by shifting the whole batch.
SHORT = 48


def fingerprints(texts: list[str], width: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text, unsigned: bit by bit, whether over half of its shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    digest, at, sizes, hashes = xxhash.xxh64_digest, [], [], []
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) <= width:
            hashes.append(digest(b" ".join(words), seed))
            n = 1
        else:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            n = len(words) - width + 1
            starts = [0, *ends[: n - 1].tolist()]
            hashes += [digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        at.append(k)
        sizes.append(n)
    if not at:
        return out
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for k, a, n in zip(at, first, sizes, strict=False):
        ones = np.unpackbits(raw[a : a + n], axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


def fingerprint_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in parts(whole, whole.column(1), most_rows=250):
                fp = fingerprints(texts, width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


EVEN = 0x5555555555555555


def points(fp: np.ndarray) -> np.ndarray:
    """Bit counts of all segments of fingerprints, each written with as many ones in its two bits; so the Manhattan distance of two points is how many bits differ."""
    even = np.uint64(EVEN)
    u = fp.view(np.uint64)
    high, low = (u >> np.uint64(1)) & even, u & even
    return ((high & low) << np.uint64(1)) | high | low


def spare_groups(n: int, most_bits: int = 4, load: int = 1024) -> int:
    """How many groups a grid should have for n fingerprints so that cells hold about `load` of them: a segment's count has 1.5 bits of information."""
    spare = 2
    while spare < 8 and n > load * 2 ** (1.5 * 32 * spare / (most_bits + spare)):
        spare += 1
    return spare


def grid_cells(fp: Column, most_bits: int = 4, spare: int = 2) -> Column:
    """An array of the cells of a fingerprint's point, (grid, cell), one for each grid."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    counts = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low).bitwiseOR(high)
    groups = most_bits + spare
    masks = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grids = [signed(sum(masks[g] for g in chosen)) for chosen in combinations(range(groups), spare)]
    return F.array(*[F.struct(F.lit(k).alias("grid"), counts.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(grids)])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that edges a-b reach from each of n rows."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    return label


def forest(fp: np.ndarray, most_bits: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked in one set of fingerprints: each row is compared with those not yet reached only."""
    left, point = fp.copy(), points(fp)
    child, parent = [], []
    while len(left):
        queue, left, point = [(left[0], point[0])], left[1:], point[1:]
        while queue and len(left):
            x, p = queue.pop()
            near = np.bitwise_count(point ^ p) <= most_bits
            near[near] = np.bitwise_count(left[near] ^ x) <= most_bits
            if near.any():
                new = left[near]
                child.append(new)
                parent.append(np.full(len(new), x))
                queue += zip(new, point[near], strict=True)
                left, point = left[~near], point[~near]
    none = np.zeros(0, fp.dtype)
    return np.concatenate([none, *child]), np.concatenate([none, *parent])


def _linked(run: np.ndarray, fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges between rows of the same run; runs lie together."""
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    length = np.diff(np.append(start, len(run)))
    short = np.repeat(length <= SHORT, length)
    a, b, point = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], points(fp)
    for d in range(1, int(min(SHORT, length.max(initial=0)))):
        i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
        if not len(i):
            break
        i = i[np.bitwise_count(point[i] ^ point[i + d]) <= most_bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most_bits]
        a.append(i)
        b.append(i + d)
    label = _labels(len(fp), np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(label != np.arange(len(fp)))
    out = [(fp[child], fp[label[child]])]
    out += [forest(fp[s : s + n], most_bits) for s, n in zip(start, length, strict=True) if n > SHORT]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def link_edges(fps: DataFrame, most_bits: int = 4, spare: int = 2) -> DataFrame:
    """(a, b): edges that join all of the distinct fingerprints `fp` within most_bits of each other."""
    cells = fps.select("fp", F.explode(grid_cells(F.col("fp"), most_bits, spare)).alias("c")).select("fp", F.xxhash64("c.grid", "c.cell").alias("cell"))
    # a clash of two cells' hashes only adds rows that are then verified
    large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("cell").alias("_c"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cells = cells.join(large, F.col("cell") == F.col("_c"), "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j) * F.col("blocks") + F.greatest(mine, j))
    cells = cells.select("fp", "cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)).alias("block"))
    dealt = cells.select(F.xxhash64("cell", "block").alias("run"), "fp").repartition("run").sortWithinPartitions("run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(r: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(r, f, most_bits)
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            r = np.concatenate([r, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([f, b.column(1).to_numpy(zero_copy_only=False)])
            cut_at = int(np.searchsorted(r, r[-1])) if len(r) else 0
            if cut_at >= 1 << 17:
                yield out(r[:cut_at], f[:cut_at])
                r, f = r[cut_at:], f[cut_at:]
        if len(r):
            yield out(r, f)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most_bits: int = 4, spare: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, kept of each row.

    component_id: the smallest doc_id that links reach. Equal fingerprints are
    one point, so copies are never paired. Texts that are null, empty or
    without words have fingerprint 0, which links like any other. Null ids are
    members, never names: a component of null ids alone has component_id null,
    and its rows are not kept. Rows that repeat an id share its fate only if
    their texts are near. Each row of the smallest id is kept.
    """
    docs = cut(fingerprint_rows(df, id_col, text_col, width))
    total = docs.count()
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comps = components(link_edges(fps.select("fp"), most_bits, spare or spare_groups(fps.count(), most_bits)))
    member = comps.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "least")
    roots = cut(member.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("rows")))
    linked = roots.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    named = join_hot(member.select("fp", "root"), roots, "root", "rows", linked).select(F.col("fp").alias("_f"), "name")
    names = fps.join(named, F.col("fp") == F.col("_f"), "left").select("fp", "n", F.coalesce("name", "least").alias("component_id"))
    out = join_hot(docs, cut(names), "fp", "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of a table without those that near_duplicates() drops; its columns stay. Rows without an id stay."""
    gone = near_duplicates(df, id_col, text_col, **how).where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    return rows.join(cut(gone), F.col("_id") == F.col("id"), "left_anti").select("_row.*")
