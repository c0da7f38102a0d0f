"""Operator 12: language identification as inference of a mixture.

Each language has frequencies of letter trigrams, hashed to BUCKETS, counted
over a sample of labelled texts. A document's units are its words: runs of
letters, each letter with its neighbours being one trigram. Under a language a
word's likelihood is that of its trigrams, to the power of 1/3, as each letter
is in three of them. Expectation-maximisation finds the languages' shares among
a document's words. Which languages it has is chosen by penalised likelihood:
one language costs nothing, each further one half the logarithm of the number
of words. No set of several can win where the likelihood of all languages
together doesn't pay for two, so most documents need one estimation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trawl.llm.common import cut, parts

BUCKETS = 1 << 16
#: What is added to each bucket's count, and the power of a word's likelihood.
PRIOR, POWER = 0.1, 1 / 3
#: Labelled texts of a language that its frequencies come from, and how many languages a model may have.
SAMPLE, MOST_LANGUAGES = 3000, 256
#: Characters that are looked at together; a word across the edge of two such stretches of a long text counts as two.
STRETCH = 1 << 20
ROUNDS, SETTLED = 40, 1e-4
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Units(NamedTuple):
    """Words of documents in order: which document, where the word's letters begin, a hash of its trigrams; and each letter's bucket."""

    doc: np.ndarray
    starts: np.ndarray
    key: np.ndarray
    buckets: np.ndarray


def _units(points: np.ndarray, doc: np.ndarray, inner: slice) -> Units:
    """points: code points, one that is no letter or a neighbour's on either side; doc: of each point in inner."""
    known = letters()[points]
    kept = np.where(known, points, 0).astype(np.uint64)
    at = np.flatnonzero(known[inner]) + inner.start
    h = kept[at - 1] * np.uint64(0x9E3779B97F4A7C15) + kept[at] * np.uint64(0xC2B2AE3D27D4EB4F) + kept[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    mine = doc[at - inner.start]
    if not len(at):
        return Units(mine, first, h, h.astype(np.int64))
    return Units(mine[first], first, np.add.reduceat(h, first), (h >> np.uint64(48)).astype(np.int64))


def stretches(texts: list[str]) -> Iterator[Units]:
    """The words of whole texts, together if they have up to STRETCH characters, else each by itself and STRETCH characters at a time."""
    if sum(map(len, texts)) <= STRETCH:
        low = [t.lower() for t in texts]
        sizes = np.array([len(t) + 1 for t in low], np.int64)
        points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield _units(points, np.repeat(np.arange(len(texts)), sizes), slice(1, len(points)) if len(texts) else slice(1, 1))
        return
    for i, t in enumerate(texts):
        for a in range(0, len(t), STRETCH):
            # one letter more on either side, in lower case, is the neighbour of the stretch's first and last
            before, mine, behind = t[max(a - 1, 0) : a].lower()[-1:] or "\n", t[a : a + STRETCH].lower(), t[a + STRETCH : a + STRETCH + 1].lower()[:1] or "\n"
            points = np.frombuffer((before + mine + behind).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield _units(points, np.full(len(points) - 2, i), slice(1, len(points) - 1))


class Model(NamedTuple):
    """languages in order of code points; logs: the logarithm of each bucket's frequency, to the power of 1/3, a column for each."""

    languages: list[str]
    logs: np.ndarray


def model_of(languages: list[str], counts: np.ndarray) -> Model:
    """counts: a row for each language."""
    p = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * counts.shape[1])
    return Model(languages, np.ascontiguousarray((np.log(p) * POWER).T.astype(np.float32)))


class Words(NamedTuple):
    """Different words of each document, documents in order: how often, and logarithms of likelihoods."""

    doc: np.ndarray
    times: np.ndarray
    logs: np.ndarray


def _merged(doc: np.ndarray, key: np.ndarray, times: np.ndarray, logs: np.ndarray) -> tuple:
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else order
    return doc[first], key[first], np.add.reduceat(times[order], first) if len(doc) else times, logs[order[first]]


def words_of_texts(texts: list[str], model: Model) -> Words:
    """Words with the same trigrams are one, so a long text takes as much memory as it has different words."""
    have = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, len(model.languages)), np.float32))
    for u in stretches(texts):
        if len(u.doc):
            logs = np.add.reduceat(model.logs[u.buckets], u.starts, axis=0)
            new = _merged(u.doc, u.key, np.ones(len(u.doc)), logs)
            have = _merged(*(np.concatenate(x) for x in zip(have, new, strict=True))) if len(have[0]) else new
    return Words(have[0], have[2], have[3])


def estimate(doc: np.ndarray, times: np.ndarray, like: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of languages for each document by expectation-maximisation from given ones, and the logarithm of the likelihood, for words (doc, times, like). Documents that have settled are left out of later rounds."""
    shares, value = shares.copy(), np.zeros(len(shares))
    for turn in range(ROUNDS):
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        if not len(starts):
            break
        ids, sizes = doc[starts], np.diff(np.append(starts, len(doc)))
        part = like * np.repeat(shares[ids], sizes, axis=0)
        sums = np.maximum(part.sum(axis=1), 1e-300)
        value[ids] = np.add.reduceat(times * np.log(sums), starts)
        new = np.add.reduceat(part * (times / sums)[:, None], starts, axis=0)
        new /= new.sum(axis=1, keepdims=True)
        moving = np.abs(new - shares[ids]).max(axis=1) > SETTLED
        shares[ids] = new
        if not moving.all():
            kept = np.repeat(moving, sizes)
            doc, times, like = doc[kept], times[kept], like[kept]
    return shares, value


def mixtures(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shares of languages for each of n documents, 0 for those not chosen, and how sure the first one is; zeros without a word."""
    width = words.logs.shape[1]
    logs = words.logs.astype(np.float64)
    best = logs.max(axis=1, keepdims=True) if len(logs) else logs
    like = np.exp(logs - best)
    count = np.bincount(words.doc, words.times, n)
    single = np.stack([np.bincount(words.doc, words.times * (logs[:, j] - best[:, 0]), n) for j in range(width)], axis=1)
    shares = np.zeros((n, width))
    there = count > 0
    top = single.argmax(axis=1)
    shares[there, top[there]] = 1
    won = single.max(axis=1)
    odds = np.exp(single - won[:, None])
    sure = np.where(there, 1 / odds.sum(axis=1), 0.0)
    if width == 1 or not there.any():
        return shares, sure
    price = 0.5 * np.log(np.maximum(count, 1))
    whole, value = estimate(words.doc, words.times, like, np.full((n, width), 1 / width))
    order = np.argsort(-whole, axis=1, kind="stable")
    for k in range(2, width + 1):
        # more languages than these can't pay
        able = there & (value - (k - 1) * price > won)
        if not able.any():
            break
        mask = np.zeros((n, width), bool)
        np.put_along_axis(mask, order[:, :k], True, axis=1)
        kept = able[words.doc]
        start = np.where(mask, np.maximum(whole, 1e-6), 0)
        part, now = estimate(words.doc[kept], words.times[kept], like[kept], start / start.sum(axis=1, keepdims=True))
        gain = able & (now - (k - 1) * price > won)
        won = np.where(gain, now - (k - 1) * price, won)
        shares[gain], sure = part[gain], np.where(gain, part.max(axis=1), sure)
    return shares, sure


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; not for a null id."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", by: Column | None = None, sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Frequencies of each language's trigrams over its first `sample` texts in order of a hash of `by` (the text, unless given); all rows of one hash count.

    Rows with a null text or language play no part. A model holds BUCKETS
    numbers for each language; more than most_languages are an error.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col) if by is None else by).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # a row for each language
    ends = cut(rows.select("lang", "h").distinct().withColumn("_n", first).where(F.col("_n") <= sample).groupBy("lang").agg(F.max("h").alias("end")))
    place = {v: i for i, v in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for part, texts in parts(b, b.column(1), STRETCH):
                of = np.array([place[v] for v in part.column(0).to_pylist()], np.int64)
                for u in stretches(texts):
                    if len(u.doc):
                        at = np.repeat(of[u.doc], np.diff(np.append(u.starts, len(u.buckets)))) * BUCKETS + u.buckets
                        total += np.bincount(at, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], ["lang", "bucket", "n"])

    chosen = rows.join(F.broadcast(ends), "lang").where("h <= end").select("lang", "text")
    sums = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    return model_of(languages, counts)


def languages_of(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns of more, lang_pred, score, languages: the language with the greatest share of each whole text, and all that the text has, by falling share.

    score: of a text in one language, how likely it is beside the others; of a
    text in several, the first one's share. Equal shares go by code points. A
    null text, one without a letter, and every text where nothing was learned
    is `und` with score 0 and no languages.
    """
    extra = more or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(n) for n, c in extra.items()))
    kinds = {n: rows.schema[n].dataType for n in ("doc_id", *extra)}
    id_type, names = to_arrow_type(kinds["doc_id"]), [*kinds, "lang_pred", "score", "languages"]
    pair = pa.struct([("lang", pa.string()), ("share", pa.float64())])
    # a slice has as many texts as leave the likelihoods of its words small
    most = STRETCH * 8 // max(8, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in parts(b, b.column(1), most):
                if model.languages:
                    shares, sure = mixtures(words_of_texts(texts, model), len(texts))
                else:
                    shares, sure = np.zeros((len(texts), 0)), np.zeros(len(texts))
                order = np.argsort(-shares, axis=1, kind="stable")
                found = [[{"lang": model.languages[j], "share": round(float(s[j]), 6)} for j in o if s[j] > 0] for s, o in zip(shares, order, strict=True)]
                first = [f[0]["lang"] if f else UNKNOWN for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), *(part.column(i) for i in range(2, part.num_columns)), pa.array(first, pa.string()), pa.array(np.round(sure, 6)), pa.array(found, pa.list_(pair))], names)

    ddl = ", ".join(f"`{n}` {t.simpleString()}" for n, t in kinds.items())
    return rows.mapInArrow(run, f"{ddl}, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """languages_of() all rows with a model of those that aren't held out: doc_id, held_out, lang_pred, score, languages. A null id is neither held out nor learned from."""
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = train(known, text_col, lang_col, F.col(id_col).cast("string"))
    return languages_of(docs, model, id_col, text_col, {"held_out": held_out(F.col(id_col))})
