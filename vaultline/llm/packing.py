"""Sequence packing by patterns fitted with non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths (``capacity`` numbers, whatever the data) is planned on the
driver: patterns of up to three lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded, and what is left is packed best-fit decreasing, length
by length. The plan is a list of runs (length, ranks, sequences, offset) whose
number is bounded by the capacity; it is broadcast, and each piece finds its
place by its rank among the pieces of its length.

Ranks are counted in Spark per (length, salt) with offsets added, so a length
that a third of all pieces share is spread over tasks.

Tokenising: the tokenizer drops white space, so a text's ids are the ids of
its ASCII-white-space words in order. Each task keeps the ids of words it has
seen (bounded) and encodes new words in one call.

Defined results: null or empty text is one piece, the end id alone. Repeated
rows are packed one by one. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, id_or_null, map_arrow

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
# words as they stand, and their letters: together at most about 200 MB in a Python worker
_WORDS_KEPT, _BASES_KEPT = 400_000, 600_000
# UTF-8 of ASCII and Latin-1 letters with at most one mark behind them
_SIMPLE = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]?").fullmatch
_SEPARATOR = "<|startoftext|>"  # a special token: splits a text before anything else is applied


# byte-level BPE writes each byte as one visible character; these have no character of their own
_SHOWN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _byte_level(word: bytes) -> str:
    return word.decode().lower().encode().decode("latin-1").translate(_SHOWN)


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes, word by word."""

    def __init__(self, name: str = TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.sep = self.tok.token_to_id(_SEPARATOR)
        self.model = self.tok.model
        # letters go to the BPE model directly; only where that gives what the whole tokenizer gives
        self.direct = all([t.id for t in self.model.tokenize(_byte_level(w.lower().encode()))] == self._ids(w).tolist()
                          for w in ("the", "Ringing", "\u00c9tude", "na\u00efve", "stra\u00dfe"))
        self.marks = {m: self._ids(m.decode()).tobytes() for m in (b"", b".", b",")}  # by the mark behind a word
        self.seen: dict[bytes, bytes] = {}   # words as they stand
        self.bases: dict[bytes, bytes] = {}  # their letters in lower case

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, todo, plain, known, marks = {}, {}, [], self.bases, self.marks
        for w in words:
            if self.direct and _SIMPLE(w):
                # letters are one pre-token, in lower case, and a mark behind them is another
                mark = w[-1:]
                if mark in marks:
                    base = w[:-1].lower()
                else:
                    base, mark = w.lower(), b""
                if base in known:
                    out[w] = known[base] + marks[mark]
                elif base in todo:
                    todo[base].append((w, mark))
                else:
                    todo[base] = [(w, mark)]
            elif b"<|" in w:
                out[w] = self._ids(w.decode()).tobytes()
            else:
                plain.append(w)
        names = list(todo)
        for at in range(0, len(names), 5_000):
            part = names[at:at + 5_000]
            ids, ends, tokenize = [], [], self.model.tokenize
            for base in part:
                ids += [t.id for t in tokenize(_byte_level(base))]
                ends.append(4 * len(ids))
            raw, keep = np.array(ids, "<u4").tobytes(), len(known) < _BASES_KEPT
            for base, i, j in zip(part, [0, *ends], ends, strict=False):
                coded = raw[i:j]
                if keep:
                    known[base] = coded
                for w, mark in todo[base]:
                    out[w] = coded + marks[mark] if mark else coded
        for at in range(0, len(plain), 5_000):
            part = plain[at:at + 5_000]
            ids = self._ids(_SEPARATOR.join(w.decode() for w in part))
            cuts = np.flatnonzero(ids == self.sep)
            for w, x in zip(part, np.split(ids, cuts), strict=True):
                out[w] = x.tobytes() if not len(x) or x[0] != self.sep else x[1:].tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        docs = [t.encode().split() for t in texts]
        seen = self.seen
        new = self._new(list(set().union(*docs).difference(seen)))
        if new and len(seen) < _WORDS_KEPT:
            seen.update(new)
            new = {}
        if new:
            def get(w):
                return seen.get(w) or new.get(w) or b""
            return [b"".join(map(get, d)) for d in docs]
        return [b"".join(map(seen.__getitem__, d)) for d in docs]


@lru_cache(1)
def encoder(name: str) -> WordEncoder:
    """One per Python worker: the words a task has seen serve the worker's next tasks."""
    return WordEncoder(name)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch):
        texts = batch.column(2).to_pylist()
        for at in range(0, len(texts), 2000):
            rows = {c: [] for c in (KEY_D, KEY_H, "piece", "start", "length", "ids_crc32")}
            for j, ids in enumerate(encoder(tokenizer).encode(texts[at:at + 2000])):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s:s + 4 * capacity]
                    rows[KEY_D].append(batch.column(0)[at + j].as_py())
                    rows[KEY_H].append(batch.column(1)[at + j].as_py())
                    rows["piece"].append(k)
                    rows["start"].append(s // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
            yield rows
    return map_arrow(doc_texts(docs), run,
                     f"{KEY_D} long, {KEY_H} long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """All (i, j, k), i >= j >= k, of present lengths with sum ``capacity``; 0 pads."""
    present = np.flatnonzero(hist[:capacity])
    present = present[present > 0]
    if not len(present):
        return np.empty((0, 3), np.int64)
    i, j = (x.ravel() for x in np.meshgrid(present, np.concatenate(([0], present)), indexing="ij"))
    ok = (j <= i) & (i + j <= capacity)
    i, j = i[ok], j[ok]
    k = capacity - i - j
    ok = (k <= j) & ((k == 0) | (hist[k] > 0)) & ((j > 0) | (k == 0))
    return np.stack([i[ok], j[ok], k[ok]], 1)


def fit_repeats(hist: np.ndarray, pats: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared misfit
    to the histogram (multiplicative non-negative least squares)."""
    h = hist.astype(np.float64).copy()
    h[0] = 0
    n = len(hist)

    def use(x):
        got = sum(np.bincount(pats[:, c], x, n) for c in range(3))
        got[0] = 0
        return got

    def back(v):
        return v[pats[:, 0]] + v[pats[:, 1]] + v[pats[:, 2]]
    target = back(h)
    x = target / max(1.0, target.sum()) * h.sum() / 3
    for _ in range(rounds):
        x *= target / np.maximum(back(use(x)), 1e-12)
    return x


class Plan:
    """Runs: ranks [lo, lo + n) of a length go to sequences seq, seq + 1, ... at ``offset``."""

    def __init__(self, hist: np.ndarray, capacity: int = CAPACITY):
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.n_sequences = 0
        left = hist.astype(np.int64).copy()
        taken = np.zeros_like(left)

        def put(length, n, seq, offset):
            self.runs.append((length, int(taken[length]), n, seq, offset))
            taken[length] += n
            left[length] -= n

        def new(n):
            self.n_sequences += n
            return self.n_sequences - n

        if left[capacity]:
            put(capacity, int(left[capacity]), new(int(left[capacity])), 0)
        pats = patterns(left, capacity)
        if len(pats):
            ideal = np.cumsum(fit_repeats(left, pats))
            whole = np.diff(np.floor(ideal + 0.5), prepend=0).astype(np.int64)  # rounding keeps the running total
            for p in np.flatnonzero(whole):
                lens = [int(x) for x in pats[p] if x]
                n = int(min(whole[p], min(left[x] // lens.count(x) for x in lens)))
                if n > 0:
                    seq, offset = new(n), 0
                    for x in lens:
                        put(x, n, seq, offset)
                        offset += x
        # residuals: best-fit decreasing; open[s] lists runs of sequences with s tokens free
        free: dict[int, list[tuple[int, int]]] = {}
        for x in range(capacity - 1, 0, -1):
            while left[x]:
                space = min((s for s in free if s >= x), default=0)
                if not space:
                    per = capacity // x
                    n = -(-int(left[x]) // per)
                    free.setdefault(capacity, []).append((new(n), n))
                    space = capacity
                seq, n = free[space].pop()
                use = int(min(n, left[x]))
                if use < n:
                    free[space].append((seq + use, n - use))
                if not free[space]:
                    del free[space]
                put(x, use, seq, capacity - space)
                if space > x:
                    free.setdefault(space - x, []).append((seq, use))

    def arrays(self) -> tuple[np.ndarray, ...]:
        r = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return r[:, 0] << 40 | r[:, 1], r[:, 1], r[:, 3], r[:, 4]


def _ranked(p: DataFrame, salts: int) -> DataFrame:
    """``p`` with ``rank``: its place (from 0) among the pieces of its length."""
    salted = p.withColumn("salt", F.pmod(F.xxhash64(*KEYS, "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(*KEYS, "piece", "start", "ids_crc32")
    return (salted.withColumn("own", F.row_number().over(order) - 1).join(offsets, ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before"))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    p = Scratch(spark, "packing").save(pieces(docs, tokenizer, capacity, end_id), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in p.groupBy("length").count().collect():  # at most `capacity` rows
        hist[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(Plan(hist, capacity).arrays())

    def place(batch):
        key, lo, seq, offset = shared.value
        length, rank = (batch.column(i).to_numpy() for i in (4, 5))
        at = np.searchsorted(key, length << 40 | rank, "right") - 1
        return {**{c: batch.column(i) for i, c in enumerate([KEY_D, "piece", "start", "ids_crc32", "length"])},
                "sequence_id": seq[at] + rank - lo[at], "offset": offset[at]}
    ranked = _ranked(p, int(max(16, -(-hist.sum() // 2**20)))).select(
        KEY_D, "piece", "start", "ids_crc32", "length", F.col("rank").cast("long").alias("rank"))
    out = map_arrow(ranked, place, f"{KEY_D} long, piece int, start long, ids_crc32 long, length long, sequence_id long, offset long")
    return out.select(id_or_null(F.col(KEY_D)).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
