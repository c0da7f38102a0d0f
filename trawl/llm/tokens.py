"""Operator 3: token counts by finite-state tokenizer compilation.

A byte-pair tokenizer is compiled to two deterministic transducers. The first
walks over characters and marks where a word of the tokenizer ends. The second
walks over the bytes of those words; a transition carries how many tokens the
best-known tokenization grows by (less than zero where a longer token takes
the place of several), so that the sum over a text is its token count. Its
states are made when a text first needs them and kept for later texts; when
there are too many, all are dropped and made anew, so memory is bounded.

A batch of texts is one stream of labels cut into equal chunks. The end of a
word takes every state to the start state, so the map of a chunk that has one
is constant after it: all chunks run side by side, the part before their first
word end waits. A scan over chunks composes the maps, then the waiting heads
run side by side from the states that came out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import parts

START, UNKNOWN = 0, 1
NONE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Lower case of two capitals that Unicode added after Python's tables.
LATER = {0xA7CB: 0x264, 0xA7DC: 0x19B}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


@lru_cache(1)
def char_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            kinds[c] = LETTER
        elif k[0] == "N":
            kinds[c] = NUMBER
        elif k[0] == "Z":
            kinds[c] = NONE
    kinds[[9, 10, 11, 12, 13, 0x85]] = NONE
    return kinds


class WordTransducer:
    """The second transducer: labels 0 to 255 are bytes inside a word, 256 to 511 the same as the last byte of one."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, most_states: int = 1 << 17):
        self.most_states = most_states
        label = {s: b for b, s in enumerate(byte_symbols())}
        #: Nodes of the trie of all tokens: next node by (node, label), and the token that ends there, -1 for none.
        self.trie: dict[tuple[int, int], int] = {}
        self.token_at, self.more = [-1], [False]
        for token, i in vocab.items():
            body = token.removesuffix(suffix) if suffix and token.endswith(suffix) and token != suffix else token
            try:
                labels = [label[c] for c in body]
            except KeyError:
                continue
            if body != token:
                labels[-1] += 256
            node = 0
            for x in labels:
                self.more[node] = True
                if (node, x) not in self.trie:
                    self.trie[node, x] = len(self.token_at)
                    self.token_at.append(-1)
                    self.more.append(False)
                node = self.trie[node, x]
            self.token_at[node] = i
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            parts.setdefault(whole, (left, right, r))
        self.parts = parts
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.columns = np.full(512, -1, np.int64)
        self.labels: list[int] = []
        self.reset()

    def reset(self) -> None:
        # a state: (trie node since a place, last token before that place, tokens there less tokens now) for each place from which a token may still grow
        self.states: list[tuple] = [((0, -1, 0),), ()]
        self.number = {self.states[0]: START}
        self.fits.clear()
        self.to = np.full((1024, len(self.labels) + 32), -1, np.int32)
        self.gain = np.zeros(self.to.shape, np.int8)
        self._unknown()

    def _unknown(self) -> None:
        self.to[UNKNOWN, : len(self.labels)] = [START if x >= 256 else UNKNOWN for x in self.labels]

    def column(self, stream: np.ndarray) -> np.ndarray:
        """Columns of the tables for labels; new labels get one."""
        found = np.flatnonzero(np.bincount(stream, minlength=512))
        new = found[self.columns[found] < 0]
        if len(new):
            self.columns[new] = np.arange(len(new)) + len(self.labels)
            self.labels += new.tolist()
            if len(self.labels) > self.to.shape[1]:
                wide = ((0, 0), (0, len(self.labels) + 32 - self.to.shape[1]))
                self.to = np.pad(self.to, wide, constant_values=-1)
                self.gain = np.pad(self.gain, wide)
            self._unknown()
        return self.columns[stream]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at an edge of a token while it is built, each with the rank of the merge that ends it there."""
        kept = self.edges[side]
        if token not in kept:
            out, ended, t = [], 1 << 60, token
            while True:
                out.append((t, ended))
                if t not in self.parts:
                    break
                ended = self.parts[t][2]
                t = self.parts[t][side]
            kept[token] = out
        return kept[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b stay apart side by side: no merge across them comes before those that build them. Of equal merges the left one goes first."""
        if (known := self.fits.get((a, b))) is None:
            known = True
            for x, x_ends in self._edge(a, 1):
                for y, y_ends in self._edge(b, 0):
                    r = self.rank.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
            self.fits[a, b] = known
        return known

    def build(self, state: int, column: int) -> None:
        """Makes one transition."""
        label = self.labels[column]
        grown, last, at = [], -1, None
        for node, before, tokens in self.states[state]:
            n = self.trie.get((node, label))
            if n is None:
                continue
            t = self.token_at[n]
            if at is None and t >= 0 and (before < 0 or self.fit(before, t)):
                last, at = t, tokens + 1
            if self.more[n]:
                grown.append((n, before, tokens))
        if at is None:
            raise ValueError(f"the vocabulary has no token for byte {label % 256}")
        if label >= 256:
            target = START
        else:
            key = (*((n, b, k - at) for n, b, k in grown), (0, last, 0))
            target = self.number.get(key)
            if target is None:
                target = self.number[key] = len(self.states)
                self.states.append(key)
                if target >= len(self.to):
                    self.to = np.pad(self.to, ((0, len(self.to)), (0, 0)), constant_values=-1)
                    self.gain = np.pad(self.gain, ((0, len(self.gain)), (0, 0)))
                    self._unknown()
        self.to[state, column], self.gain[state, column] = target, at

    def step(self, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.to[s, c]
        if out.min(initial=0) < 0:
            for i in np.flatnonzero(out < 0):
                if self.to[s[i], c[i]] < 0:
                    self.build(int(s[i]), int(c[i]))
            out = self.to[s, c]
        return out, self.gain[s, c]

    def gains(self, stream: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Tokens emitted at each label of a stream that begins and ends at a word's edge."""
        if len(self.states) > self.most_states:
            self.reset()
        n = len(stream)
        if not n:
            return np.zeros(0, np.int8)
        wide = -(-n // chunk)
        col = self.column(stream)
        col = np.concatenate([col, np.full(wide * chunk - n, col[-1])]).reshape(wide, chunk)
        ends = np.zeros(wide * chunk, bool)
        ends[:n] = stream >= 256
        ends[n:] = True
        ends = ends.reshape(wide, chunk)
        head = np.where(ends.any(axis=1), ends.argmax(axis=1) + 1, chunk)  # labels up to the first word end
        out = np.zeros((wide, chunk), np.int8)
        by_step, made = np.ascontiguousarray(col.T), np.zeros((chunk, wide), np.int8)
        s = np.full(wide, UNKNOWN, np.int32)
        s[0] = START
        for k in range(chunk):
            s, made[k] = self.step(s, by_step[k])
        out[:] = made.T
        # the scan: a chunk begins in the state in which the one before it ends; heads without a word end pass it on
        waiting = np.arange(1, wide)
        while len(waiting):
            ready = waiting[s[waiting - 1] != UNKNOWN]
            now, length = s[ready - 1].copy(), head[ready]
            for k in range(int(length.max(initial=0))):
                live = np.flatnonzero(length > k)
                now[live], out[ready[live], k] = self.step(now[live], col[ready[live], k])
            open_ = s[ready] == UNKNOWN
            s[ready[open_]] = now[open_]
            waiting = np.setdiff1d(waiting, ready, assume_unique=True)
        return out.reshape(-1)[:n]


def by_words(spec: dict) -> bool:
    """Whether a tokenizer's JSON is a lower-casing BPE vocabulary with word ends, in which white space always parts tokens."""
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    return spec["model"]["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and split == pattern


class TokenCounter:
    """Counts the tokens of texts for a byte-level vocabulary with word ends, read from a tokenizer's JSON."""

    CONTRACTIONS = re.compile("'(?:s|t|re|ve|m|ll|d)")

    def __init__(self, spec: str, most_labels: int = 1 << 20):
        spec = json.loads(spec)
        if not by_words(spec):
            raise ValueError("only lower-casing BPE vocabularies with word ends can be compiled")
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.most_labels = most_labels
        self.words = WordTransducer(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])

    @staticmethod
    def lower(text: str) -> str:
        if text.isascii():
            return text.lower()
        # character by character: a sigma at a word's end stays as it is elsewhere
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(LATER)

    def stream(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first transducer: labels of the bytes that are in words, and for each character how many labels come up to and with it."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = char_classes()[code]
        follow = np.append(kind[1:], NONE)
        end = (kind != NONE) & ((kind != follow) | (kind == NUMBER))
        if "'" in text:
            for m in self.CONTRACTIONS.finditer(text):
                i, j = m.span()
                if i == 0 or kind[i - 1] != OTHER:
                    end[i : j - 1] = False
                    end[j - 1] = True
        size = np.where(kind == NONE, 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        upto = np.cumsum(size)
        used = code[kind != NONE]
        labels = np.frombuffer(used.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        labels[upto[end] - 1] += 256
        return labels, upto

    def count(self, texts: list[str]) -> list[int]:
        out, block, size = [], [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= self.most_labels:
                out += self._count(block)
                block, size = [], 0
        return out + self._count(block)

    def _count(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        extra, parts = np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            if "<|" in t:
                t, extra[i] = self.special.subn("\n", t)
            parts.append(self.lower(t))
        labels, upto = self.stream("\n".join(parts) + "\n")
        total = np.concatenate([[0], np.cumsum(self.words.gains(labels), dtype=np.int64)])
        last = np.cumsum([len(p) + 1 for p in parts]) - 1
        marks = total[upto[last]]
        return (np.diff(marks, prepend=0) + extra).tolist()


@lru_cache(2)
def counter(spec: str) -> TokenCounter:
    return TokenCounter(spec)


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row's whole text.

    tokenizer: path of the vocabulary's JSON; it is read once, on the driver.
    A null or empty text has 0 bytes and 0 tokens. A null id stays null, rows
    that repeat each get a row, an empty table gives none; other columns are
    not read, so clashing names do no harm. One pass, no shuffle.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(spec)
        for b, texts in (x for whole in batches for x in parts(whole, whole.column(1))):
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


