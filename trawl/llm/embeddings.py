"""Operator 2: embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves, each half with a codebook of its own; a vector
lives in the cell of its two nearest centroids. A vector that is within the
radius of x lies on the far side of the plane between x's centroid and its own,
so half by half that plane's distance bounds how near the cell can come. Cells
are visited from the nearest on until the bound passes the radius: by then the
recall is 1, whatever the codebooks, which are fitted on a bounded sample. What
shares a cell is verified by cosines in double precision. Equal vectors are
one. Large cells are cut into blocks of members and of visitors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import components, cut, join_hot

#: Vectors that the codebooks are fitted on, at most; members and visitors of a block.
SAMPLE, MEMBERS, VISITORS = 8192, 2048, 8192
#: Comparisons that take as long as sending a vector to a cell, about.
SHIP = 300


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by k-means from evenly spread rows."""
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = squares(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and for each centroid the square of a distance that no point of its cell falls below."""
    d = squares(x, c)
    home = d.argmin(axis=1)
    apart = np.sqrt(squares(c, c))[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(apart > 0, (d - d.min(axis=1)[:, None]) / (2 * apart), 0.0)
    low[np.arange(len(x)), home] = 0
    return home, low * low


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own) for all cells whose bound is within the radius: the sorted sequences of both halves are merged up to it."""
    h = x.shape[1] // 2
    (i, a), (j, b) = bounds(x[:, :h], books[0]), bounds(x[:, h:], books[1])
    oa, ob = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
    sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
    limit = radius2 * (1 + 1e-9) + 1e-12
    rows, cells = [], []
    for s in range(sa.shape[1]):
        open_ = np.flatnonzero(sa[:, s] <= limit)
        if not len(open_):
            break
        for t in range(sb.shape[1]):
            open_ = open_[sa[open_, s] + sb[open_, t] <= limit]
            if not len(open_):
                break
            rows.append(open_)
            cells.append(oa[open_, s] * len(books[1]) + ob[open_, t])
    row, cell = np.concatenate(rows), np.concatenate(cells)
    return row, cell, cell == (i * len(books[1]) + j)[row]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def block_links(x: np.ndarray, node: np.ndarray, many: np.ndarray, member: np.ndarray, visitor: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block: how many links are counted for it here, and the least row that links reach in the block.

    Two vectors of one cell visit each other, so a visitor at home counts for
    itself; of two cells only the vectors of one visit the other, so those links
    count on both sides.
    """
    m, v = np.flatnonzero(member), np.flatnonzero(visitor)
    n, label = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        was = label.copy()
        for k in range(0, len(v), 512):
            q = v[k : k + 512]
            near = x[q] @ x[m].T >= least
            near &= node[q][:, None] != node[m]
            if not near.any():
                continue
            if (was == np.arange(len(x))).all():
                n[q] += near @ many[m]
                n[m] += (many[q] * ~own[q]) @ near
            label[q] = np.minimum(label[q], np.where(near, label[m], len(x)).min(axis=1))
            label[m] = np.minimum(label[m], np.where(near, label[q][:, None], len(x)).min(axis=0))
        label = label[label]
        if (label == was).all():
            return n, label


def halved(row: np.ndarray, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which visits to keep: those at home and those to cells of higher number. The bound works both ways, so of two near vectors in different cells the one in the lower cell visits the other."""
    home = np.zeros(int(row.max(initial=-1)) + 1, cell.dtype)
    home[row[own]] = cell[own]
    return cell >= home[row]


def chosen(x: np.ndarray, radius2: float, largest: int) -> int:
    """Centroids of a half that cost least for a label of `largest` vectors: by the visits of a sample and the vectors that it meets in the cells it visits. A visit costs as much as SHIP comparisons."""
    best, h = (math.inf, 2), x.shape[1] // 2
    for k in (2, 4, 8, 16, 32, 64):
        books = codebook(x[:, :h], k), codebook(x[:, h:], k)
        load = np.zeros(len(books[0]) * len(books[1]))
        np.add.at(load, bounds(x[:, :h], books[0])[0] * len(books[1]) + bounds(x[:, h:], books[1])[0], 1 / len(x))
        some = x[:: -(-len(x) // 1024)]
        row, cell, own = visits(some, books, radius2)
        kept = cell[halved(row, cell, own)]
        best = min(best, (len(kept) / len(some) * SHIP + load[kept].sum() / len(some) * largest, k))
    return best[1]


def _linked(reps: DataFrame, width: int, least: float, k: int | None, largest: int) -> DataFrame:
    """(a, b, n): a's links found in a block, and a row of the block that it hangs together with."""
    sample = reps.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()
    x = unit(np.array([r["embedding"] for r in sample], np.float64))
    h = width // 2
    radius2 = 2 - 2 * least
    k = k or chosen(x, radius2, largest)
    books = (codebook(x[:, :h], k), codebook(x[:, h:], k))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                row, cell, own = visits(unit(matrix(b.column(3), width)), books, radius2)
                row, cell, own = (c[halved(row, cell, own)] for c in (row, cell, own))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(cell), pa.array(own), *(b.column(c).take(take) for c in (1, 2, 3))], ["label", "cell", "own", "node", "many", "embedding"])

    label, kind = (reps.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    out = reps.select("label", "node", "many", "embedding").mapInArrow(visit, f"label {label}, cell long, own boolean, node long, many long, embedding {kind}")
    out = out.select(F.xxhash64("label", "cell").alias("key"), "own", "node", "many", "embedding")
    out = cut(out)
    load = out.groupBy("key").agg(F.count_if("own").alias("m"), F.count("*").alias("v")).where(f"m > {MEMBERS} or v > {VISITORS}")
    load = load.select(F.col("key").alias("_k"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("nb"), F.ceil(F.col("v") / VISITORS).cast("int").alias("nq"))
    some = out.groupBy("key").agg(F.count_if("own").alias("m")).where("m > 0").select(F.col("key").alias("_h"))
    out = out.join(some, F.col("key") == F.col("_h"), "left_semi").join(load, F.col("key") == F.col("_k"), "left")
    nb, nq = F.greatest(F.coalesce("nb", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("nq", F.lit(1)), F.lit(1))
    mine, my = F.pmod(F.xxhash64("node"), nb).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), nq).cast("int")
    as_visitor = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: F.struct(b.alias("b"), my.alias("q"), (F.col("own") & (b == mine)).alias("member"), F.lit(True).alias("visitor")))
    as_member = F.transform(F.filter(F.sequence(F.lit(0), nq - 1), lambda q: F.col("own") & (q != my)), lambda q: F.struct(mine.alias("b"), q.alias("q"), F.lit(True).alias("member"), F.lit(False).alias("visitor")))
    out = out.select("key", "node", "many", "embedding", "own", F.explode(F.concat(as_visitor, as_member)).alias("p"))
    out = out.select(F.xxhash64("key", "p.b", "p.q").alias("run"), "node", "many", "embedding", "p.member", "p.visitor", "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            run = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            node, many = t.column(1).to_numpy(), t.column(2).to_numpy()
            x = unit(np.concatenate([matrix(c, width) for c in t.column(3).chunks]))
            member, visitor, own = (t.column(c).to_numpy() for c in (4, 5, 6))
            parts: list[tuple[np.ndarray, ...]] = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s > 1:
                    w = slice(s, e)
                    n, label = block_links(x[w], node[w], many[w], member[w], visitor[w], own[w], least)
                    k = np.flatnonzero((n > 0) | (label != np.arange(e - s)))
                    if len(k):
                        parts.append((node[w][k], node[w][label[k]], n[k]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["a", "b", "n"])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            if size + b.num_rows > 4096 and held:
                t = pa.Table.from_batches(held)
                run = t.column(0).to_numpy()
                last = int(np.searchsorted(run, run[-1]))
                if last:
                    yield from found(t.slice(0, last))
                    held = t.slice(last).to_batches()
                    size = t.num_rows - last
            held.append(b)
            size += b.num_rows
        if held:
            yield from found(pa.Table.from_batches(held))

    return out.repartition("run").sortWithinPartitions("run").mapInArrow(verify, "a long, b long, n long")


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite numbers, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _linked_numbers(reps: DataFrame, least: float) -> DataFrame:
    """(a, b, n) like _linked() for vectors of one component: their cosine is 1 or -1, so a label and a sign are one group."""
    sign = F.signum(F.get("embedding", F.lit(0))) if least > -1 else F.lit(0.0)
    mine = reps.select(F.xxhash64("label", sign).alias("group"), "node", "many")
    groups = cut(mine.groupBy("group").agg(F.min("node").alias("b"), F.sum("many").alias("whole"), F.count("*").alias("rows")).where("rows > 1"))
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_hot(mine, groups, "group", "rows", total).select(F.col("node").alias("a"), "b", (F.col("whole") - F.col("many")).alias("n"))


def near_vectors(df: DataFrame, least: float = 0.98, k: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    k: centroids of each codebook; by default they follow from the visits of a
    sample and the largest label. Cosines are in double precision; components
    keep their type, single or else double.
    Rows link if their labels are equal and not null and their cosine is at
    least `least`. Vectors without a direction link with nothing, and neither do
    vectors of different lengths. Equal vectors of a label are one vector that
    counts as often as it occurs. Rows that repeat an id are vectors of their
    own. A null id is never a component's name; a component of null ids alone
    has component_id null, and its rows are not kept.
    """
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & sound(F.col("embedding"))
    key = F.concat_ws("-", F.hex(F.xxhash64("label", "embedding")), F.hex(F.hash("label", "embedding")))
    rows = rows.withColumn("key", F.when(good, key))
    grouped = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    node = F.coalesce("least", F.xxhash64("key").bitwiseOR(F.lit(-(1 << 63))))
    reps = cut(grouped.withColumn("node", node))
    found = None
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    for r in reps.groupBy(F.size("embedding").alias("w")).count().collect():  # lengths of vectors, as a rule one
        if r["count"] > 1 and (r["w"] > 1 or least <= 1):
            some = reps.where(F.size("embedding") == r["w"])
            one = _linked(some, r["w"], least, k, largest) if r["w"] > 1 else _linked_numbers(some, least)
            found = one if found is None else found.unionByName(one)
    names = reps.select("key", "node", "least", "many")
    if found is not None:
        found = cut(found)
        links = found.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("links"))
        comps = components(found.select("a", "b"))
        member = reps.select("node", "least").join(comps.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
        name = cut(member.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("rows")))
        total = name.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        named = join_hot(member, name, "root", "rows", total).select(F.col("node").alias("_m"), "name")
        names = names.join(links, F.col("node") == F.col("_a"), "left").join(named, F.col("node") == F.col("_m"), "left")
    else:
        names = names.withColumn("links", F.lit(0)).withColumn("name", F.lit(None).cast("long"))
    names = cut(names.select("key", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), F.coalesce("name", "least").alias("component_id")))
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = join_hot(rows.where("key is not null").select("vec_id", "key"), names, "key", "many", reps.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0])
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
