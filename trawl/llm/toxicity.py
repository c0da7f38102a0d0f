"""Operator 5: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text. Windows of several words that overlap are compressed with the ordinary
dictionary alone and with both; how many bytes the toxic one saves is a window's
distance. Savings above a calibrated threshold, summed and taken by window, make
a text's score.

Toxic texts are mostly ordinary words, so a dictionary of their whole windows
learns ordinary words again and the distance is noise. The toxic dictionary is
therefore trained on the stretches of toxic windows that ordinary training text
doesn't account for: those covered by runs of bytes that set toxic texts apart
(a likelihood-ratio test with a bounded share of false discoveries). The
ordinary dictionary stands behind the toxic one in both compressions, and
zstandard parses with its optimal parser, so that what is ordinary costs the
same in both. Thresholds and weights are calibrated on texts whose half of the
training rows took no part in the dictionaries that they are compressed with.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import parts, text_field

#: Goes before each window and is in both dictionaries, because zstandard stores inputs as they are unless it saves some bytes at least.
CARRIER = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Words of a window, words from one window's start to the next one's, and bytes of a run.
WORDS, STEP, RUN = 6, 3, 6
#: Bytes of the dictionaries, and segments that the trainer picks.
ORDINARY, TOXIC, SEGMENT = 1 << 16, 1 << 14, 32
#: Windows that the ordinary dictionary is trained on, and texts of each half that calibrate, at most.
SAMPLES, CALIBRATE = 60_000, 1000
WORD = re.compile(r"\w+")


def plain(text: str) -> bytes:
    """The words of a text in lower case, a blank around each."""
    return f" {' '.join(WORD.findall(text.lower()))} ".encode("utf-8", "surrogatepass")


def runs(text: bytes) -> np.ndarray:
    """Each RUN bytes in a row of a text, as a number."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - RUN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(RUN if n > 0 else 0):
        out = (out << np.uint64(8)) | raw[k : k + n]
    return out


def edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin and end, blanks included; every word is in one."""
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    n = len(blanks) - 1
    if len(text) <= 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(0, max(1, n - WORDS + STEP), STEP)
    return blanks[first], blanks[np.minimum(first + WORDS, n)] + 1


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


@dataclass(frozen=True)
class Model:
    """What scoring needs: the dictionaries' contents, the savings that a window must pass, and the weights of features(), the constant first."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: float = 0.0
    weights: tuple[float, ...] = ()
    prior: float = 0.0
    level: int = 19


class Savings:
    """Bytes that the toxic dictionary saves in each window of a text."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes):
            how = zstandard.ZstdCompressionParameters.from_level(model.level, source_size=128, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

        behind = CARRIER + model.ordinary + CARRIER
        self.alone, self.both = compressor(behind), compressor(model.toxic + behind)
        #: Runs of the toxic dictionary that the ordinary one lacks. A window without any can't be saved bytes worth counting, so it isn't compressed.
        self.own = np.setdiff1d(runs(model.toxic), runs(behind))

    def of(self, text: bytes) -> np.ndarray:
        first, last = edges(text)
        out = np.zeros(len(first))
        hits = np.flatnonzero(among(runs(text), self.own))
        if len(hits):
            for k in np.flatnonzero(np.searchsorted(hits, last - RUN + 1) > np.searchsorted(hits, first)):
                window = CARRIER + text[first[k] : last[k]]
                out[k] = len(self.alone(window)) - len(self.both(window))
        return out


@lru_cache(1)
def savings(model: Model) -> Savings:
    return Savings(model)


def features(saved: np.ndarray, threshold: float) -> list[float]:
    """Of savings above the threshold: their mean over all windows, and the mean of the three largest, as roots."""
    over = np.maximum(saved - threshold, 0)
    top = np.sort(over)[-3:].sum() / 3
    return [math.sqrt(over.mean()) if len(over) else 0.0, math.sqrt(top)]


def probability(model: Model, saved: np.ndarray) -> float:
    if not model.weights:
        return model.prior
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], features(saved, model.threshold), strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def distinct_rows(rows: list[tuple[str, int]]) -> list[tuple[bytes, int]]:
    """Texts as plain() has them, without near copies: one for each least hash of five words in a row, so that a group of copies doesn't look like a habit of a class."""
    seen, out = set(), []
    for text, label in rows:
        b = plain(text)
        w = b.split()
        key = (min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0), label)
        if w and key not in seen:
            seen.add(key)
            out.append((b, label))
    return out


def chance(a: int, b: int, n1: int, n0: int) -> float:
    """How likely it is by chance that a of n1 toxic and b of n0 ordinary texts have a run, or more toxic ones (likelihood-ratio test, one-sided)."""
    if a * n0 <= b * n1:
        return 1.0
    share = (a + b) / (n1 + n0)
    part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
    g = part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share))
    return 0.5 * math.erfc(math.sqrt(max(g, 0.0)))


def apart(texts: list[tuple[bytes, int]], false_share: float = 0.01) -> np.ndarray:
    """Runs that set toxic texts apart. Of these a share of false_share is expected to be chance (Benjamini and Hochberg's step-up over all runs of toxic texts), whatever the number of texts."""
    n = Counter(y for _, y in texts)
    held = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(runs(b)) for b, y in texts if y == v)]), return_counts=True) for v in (0, 1)]
    known, toxic = held[1]
    at = np.minimum(np.searchsorted(held[0][0], known), max(0, len(held[0][0]) - 1))
    ordinary = np.where(held[0][0][at] == known, held[0][1][at], 0) if len(held[0][0]) else np.zeros(len(known), np.int64)
    pairs, which = np.unique(np.stack([toxic, ordinary]), axis=1, return_inverse=True)
    p = np.array([chance(int(a), int(b), n[1], n[0]) if a >= 2 else 1.0 for a, b in pairs.T])[which.reshape(-1)] if len(known) else np.zeros(0)
    steps = np.sort(p)
    ok = np.flatnonzero(steps * len(p) <= false_share * np.arange(1, len(p) + 1))
    return known[p <= steps[ok[-1]]] if len(ok) and steps[ok[-1]] < 1 else known[:0]


def stretches(text: bytes, special: np.ndarray) -> set[bytes]:
    """The stretches of a text that special runs cover."""
    hit = np.flatnonzero(among(runs(text), special))
    level = np.zeros(len(text) + 1, np.int32)
    np.add.at(level, hit, 1)
    np.add.at(level, hit + RUN, -1)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(level) > 0).astype(np.int8), [0]])))
    return {text[a:b] for a, b in zip(turn[::2], turn[1::2], strict=True)}


def trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary's content. The trainer refuses few or short samples; those are a dictionary as they are, the most frequent last, where they cost least."""
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples * (1 + 20_000 // len(samples)), **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(x for x, _ in reversed(Counter(samples).most_common()))[-size:]


def dictionaries(texts: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) contents from labelled texts. Each toxic text gives a stretch once, so that long texts don't outweigh others."""
    special = apart(texts)
    toxic = [x for b, y in texts if y for x in sorted(stretches(b, special))]
    every = [(b, *w) for b, y in texts if not y for w in zip(*edges(b), strict=True)]
    few = random.Random(1).sample(every, min(len(every), SAMPLES))
    return trained(ORDINARY, [b[s:e] for b, s, e in few]), trained(TOXIC, toxic, k=SEGMENT, d=6)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights (the constant first, others not below 0) of a logistic regression by Newton's method, and its loss."""
    x = np.column_stack([np.ones(len(x)), x])
    w, free = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    penalty = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(x.shape[1]):
        w[:] = 0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            slope = x.T @ (weight * (p - y)) + penalty * w
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            move = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            w[free] -= np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-6:
                break
        below = (w < 0) & free & (np.arange(len(w)) > 0)
        if not below.any():
            break
        free &= ~below
    z = np.clip(x @ w, -50, 50)
    return w, float((weight * (np.logaddexp(0, z) - y * z)).sum())


def fit(rows: list[tuple[str, int]], totals: tuple[int, int] = (0, 0)) -> Model:
    """A model from labelled texts (text, 0 or 1).

    totals: how many texts each label has, if rows are a sample by label. With
    one class, or none, the score is that class's share for every text.
    """
    texts = distinct_rows(sorted(rows))
    n = Counter(y for _, y in texts)
    if not n[1] or not n[0]:
        return Model(prior=float(n[1] > 0))
    # each class weighs as in all labels, not as in the sample
    weigh = [t / sum(totals) * len(texts) / n[y] if min(totals) > 0 else 1.0 for y, t in enumerate(totals)]
    prior = n[1] * weigh[1] / (n[0] * weigh[0] + n[1] * weigh[1])
    by_class = [[t for t in texts if t[1] == y] for y in (0, 1)]
    halves = [[t for c in by_class for t in c[h::2]] for h in (0, 1)]
    saved: list[tuple[np.ndarray, int]] = []
    for mine, other in (halves, halves[::-1]):
        far = Savings(Model(*dictionaries(mine)))
        saved += [(far.of(b), y) for b, y in other[:: max(1, -(-len(other) // CALIBRATE))]]
    y = np.array([y for _, y in saved], float)
    weight = np.where(y > 0, weigh[1], weigh[0])
    found = []
    for threshold in (0.0, 1.0, 2.0, 3.0):
        w, loss = logistic(np.array([features(s, threshold) for s, _ in saved]), y, weight)
        found.append((loss, threshold, tuple(w.tolist())))
    _, threshold, weights = min(found)
    return Model(*dictionaries(texts), threshold, weights, prior)


def held_out(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = (4000, 2000), most_chars: int = 24_000_000) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """Labelled texts outside the held-out fold: at most most[label] of a label, those with the least hash of their id, as long as they have at most most_chars characters together. Texts of over a fortieth of that come after all others, so that one long text crowds out none. Those bounds are what reaches the driver, with the numbers of all such labels."""
    mine = labels.select(F.col("doc_id").alias("_l"), F.col("toxic").cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_l").isNotNull() & ~held_out(F.col("_l")))
    picked = [mine.where(F.col("_y") == y).orderBy(F.xxhash64("_l"), "_l").limit(k) for y, k in enumerate(most)]
    few = picked[0].unionByName(picked[1])
    texts = df.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    got = texts.join(F.broadcast(few), F.col("_i") == F.col("_l"))
    # at most sum(most) rows, dealt by their hash: whole texts until the bound
    upto = F.sum(F.length("_t")).over(Window.partitionBy("_y").orderBy(F.length("_t") > most_chars // 40, F.xxhash64("_l"), "_l").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = got.withColumn("_upto", upto).where(F.col("_upto") <= most_chars // 2)
    n = mine.agg(F.count_if(F.col("_y") == 0).alias("n0"), F.count_if(F.col("_y") == 1).alias("n1")).first()
    return [(r["_t"], r["_y"]) for r in got.select("_t", "_y").collect()], (n["n0"], n["n1"])


def scored(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Each row of a table as a struct _row, with its score (0 to 1) and flagged, how many windows pass the threshold, beside it. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in parts(whole, text_field(whole.column(0), text_col)):
                out, many = [], []
                for t in texts:
                    s = savings(model).of(plain(t)) if model.weights else np.zeros(0)
                    out.append(probability(model, s))
                    many.append(int((s > model.threshold).sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(many, pa.int64())], ["_row", "score", "flagged"])

    schema = T.StructType([T.StructField("_row", df.schema, False), T.StructField("score", T.DoubleType()), T.StructField("flagged", T.LongType())])
    return df.select(F.struct("*").alias("_row")).mapInArrow(run, schema)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged of each row.

    Only the text makes a score. Null and empty texts have no window and score
    like other texts without savings. A null id is not held out; rows that
    repeat are scored alike; an empty table gives none. Without labels every
    score is 0. Other columns are not read.
    """
    model = fit(*training_rows(df, labels, id_col, text_col))
    rows = scored(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)
    who = F.col("_row.doc_id")
    return rows.select(who.alias("doc_id"), held_out(who).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"), "flagged")


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.3) -> DataFrame:
    """The rows of a table that toxicity() doesn't predict to be toxic; its columns stay, whatever their names."""
    return scored(df, fit(*training_rows(df, labels, id_col, text_col)), text_col).where(F.col("score") < cut_at).select("_row.*")
