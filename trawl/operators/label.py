"""From evidence passages to graded labels: alignment, filing resolution, union coverage, invariants."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import coverage, named, tokens, word_set
from trawl.operators.retrieve import ranked
from trawl.sources.store import cut


def align(scores: DataFrame, least: float = 0.30) -> DataFrame:
    """The best chunk of each reference, if its score is at least `least`: (ref, chunk_id, score)."""
    return ranked(scores, 1, "ref").where(F.round("score", 9) >= least).select("ref", "chunk_id", "score")


def graded_by_coverage(scores: DataFrame, refs: DataFrame, corpus: DataFrame, top: int = 20, low: float = 0.50, high: float = 0.80) -> DataFrame:
    """ref, chunk_id, coverage, grade: of the top chunks those that have enough of the evidence's words, 2 from `high` on and 1 from `low` on. Blank evidence has no labels.

    The top chunks are written first: then their number is known when they are
    joined, and words are those of the top chunks alone, not of the whole corpus.
    """
    near = cut(ranked(scores, top, "ref").select("ref", "chunk_id"))
    cand = corpus.select("chunk_id", F.col("text").alias("_c")).join(near, "chunk_id").join(refs.select("ref", F.col("text").alias("_e")), "ref")
    share = cand.select("ref", "chunk_id", word_set(F.col("_e")).alias("e"), word_set(F.col("_c")).alias("c")).select("ref", "chunk_id", coverage(F.col("e"), F.col("c")).alias("coverage")).where(F.col("coverage") >= low)
    return share.withColumn("grade", F.when(F.col("coverage") >= high, 2).otherwise(1))


def best_grades(labels: DataFrame) -> DataFrame:
    """qid, chunk_id and the highest grade that any reference gives."""
    return labels.groupBy("qid", "chunk_id").agg(F.max("grade").alias("grade"))


def resolve(scores: DataFrame, owners: DataFrame, filings: DataFrame, top: int = 200, margin: float = 1.25) -> DataFrame:
    """qid, filing, total, ambiguous: the filing with the largest sum of scores over all references of a question.

    scores: (ref, chunk_id, score) above 0; owners: (ref, qid); filings:
    (chunk_id, filing). Ambiguous: the runner-up is within the margin.
    """
    near = ranked(scores, top, "ref").join(owners, "ref").join(filings.select("chunk_id", "filing"), "chunk_id")
    sums = near.groupBy("qid", "filing").agg(F.sum("score").alias("total"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("total", 9)), "filing")
    best = sums.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("total", 1, 0.0).over(order)).where("place = 1")
    return best.select("qid", "filing", "total", ((F.col("second") > 0) & (F.round(F.col("total") / F.col("second"), 9) < margin)).alias("ambiguous"))


def override(resolved: DataFrame, queries: DataFrame, filings: DataFrame) -> DataFrame:
    """A query that names exactly one known filing goes there, and isn't ambiguous; only queries that were resolved at all."""
    mentions = queries.select("qid", F.explode(named(F.col("text"))).alias("filing")).join(filings.select("filing").distinct(), "filing", "left_semi")
    only = mentions.groupBy("qid").agg(F.count("*").alias("n"), F.first("filing").alias("told")).where("n = 1")
    out = resolved.join(only, "qid", "left")
    return out.select("qid", F.coalesce("told", "filing").alias("filing"), (F.col("ambiguous") & F.col("told").isNull()).alias("ambiguous"))


def pick(evidence: Counter, candidates: list[tuple], target: float, told: list | None = None) -> tuple[list[tuple], int]:
    """Greedy union: again and again the candidate that adds most of what is missing, earlier ones first among equals. Candidates: (key, Counter).

    What a candidate adds only shrinks as more is covered, so old gains are
    bounds: the candidate with the greatest bound is counted anew, and taken if
    its gain is still that; the others aren't looked at. told: gets how many
    gains were counted.
    """
    total, left, covered, out = evidence.total(), evidence.copy(), 0, []
    gain = lambda c: sum(min(n, c[t]) for t, n in left.items())
    queue = [(-gain(c), k) for k, (_, c) in enumerate(candidates)] if target * total > 0 else []
    heapq.heapify(queue)
    counted = len(queue)
    fresh = set(range(len(queue)))
    while queue and covered < target * total:
        bound, k = heapq.heappop(queue)
        if not bound:
            break
        key, c = candidates[k]
        if k not in fresh:
            now = gain(c)
            counted += 1
            if now != -bound:
                fresh.add(k)
                heapq.heappush(queue, (-now, k))
                continue
        out.append((key, -bound))
        left = left - c
        covered -= bound
        fresh.clear()
    if told is not None:
        told.append(counted)
    return out, covered


def union_coverage(scores: DataFrame, refs: DataFrame, corpus: DataFrame, resolved: DataFrame, top: int = 40, target: float = 0.80, high: float = 0.50) -> DataFrame:
    """qid, ref, chunk_id, gain, total, step, grade: chunks of the resolved filing that together cover a reference.

    scores: (ref, chunk_id, score) above 0 of the best `top` chunks at least in
    each reference's resolved filing; those without a score follow in order of
    id. refs: (ref, qid, text); corpus: (chunk_id, filing, text); ambiguous
    questions are left out. A group is one reference with at most `top`
    candidates, so its size is bounded.
    """
    clear = resolved.where(~F.col("ambiguous")).select("qid", "filing")
    mine = refs.select("ref", "qid").join(clear, "qid")
    inside = corpus.select("chunk_id", "filing")
    scored = ranked(scores.join(inside, "chunk_id").join(mine, ["ref", "filing"]).select("ref", "qid", "chunk_id", "score"), top, "ref")
    first = inside.withColumn("_n", F.row_number().over(Window.partitionBy("filing").orderBy("chunk_id"))).where(F.col("_n") <= top).drop("_n")
    short = mine.join(scored.groupBy("ref").agg(F.count("*").alias("_s")), "ref", "left").where(F.coalesce("_s", F.lit(0)) < top)
    more = short.join(first, "filing").join(scored.select("ref", "chunk_id"), ["ref", "chunk_id"], "left_anti").select("ref", "qid", "chunk_id", F.lit(0.0).alias("score"))
    near = ranked(scored.drop("rank").unionByName(more), top, "ref").join(corpus.select("chunk_id", tokens(F.col("text")).alias("c")), "chunk_id")
    asked = refs.select("ref", tokens(F.col("text")).alias("e"))
    # of a chunk only the words that the evidence has
    near = near.join(asked, "ref").select("ref", "qid", "rank", "chunk_id", F.filter("c", lambda t: F.array_contains("e", t)).alias("c"))
    groups = near.groupBy("ref", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "c"))).alias("cand")).join(asked, "ref")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["qid", "ref", "chunk_id", "gain", "total", "step"]
        for b in batches:
            out = []
            for r in b.to_pylist():
                e = Counter(r["e"])
                picked, _ = pick(e, [(c["chunk_id"], Counter(c["c"])) for c in r["cand"]], target)
                out += [(r["qid"], r["ref"], key, gain, e.total(), k + 1) for k, (key, gain) in enumerate(picked)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((b.schema.field("qid").type, b.schema.field("ref").type, pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)

    kind = lambda c: groups.schema[c].dataType.simpleString()
    picked = groups.select("ref", "qid", "cand", "e").mapInArrow(cover, f"qid {kind('qid')}, ref {kind('ref')}, chunk_id string, gain long, total long, step long")
    first = Window.partitionBy("ref").orderBy(F.desc("gain"), "step")
    largest = F.row_number().over(first) == 1
    return picked.withColumn("grade", F.when(largest | (F.col("gain") / F.col("total") >= high), 2).otherwise(1))


def outside_filing(labels: DataFrame, corpus: DataFrame, resolved: DataFrame) -> DataFrame:
    """Labels that aren't in their question's filing: must be empty."""
    at = labels.join(corpus.select("chunk_id", "filing"), "chunk_id").join(resolved.select("qid", F.col("filing").alias("own")), "qid", "left")
    return at.where(~F.col("filing").eqNullSafe(F.col("own"))).select("qid", "chunk_id", "filing", "own")
