"""Language identification with word-first backoff.

A known word scores by its log frequency in each language. A word the model
has not seen falls back to its character n-grams: the longest n with any
known n-gram decides, then shorter ones. A document's score per language is
the sum over its words.

The model is fitted on a bounded sample of labelled rows (``max_docs`` per
language, chosen by a hash of the doc_id) and keeps the most frequent words
and n-grams of each language, an equal share of the bound for each, so its
size has a fixed bound and it can be broadcast. Word and n-gram counts are
Spark aggregates; only the bounded tables reach the driver.

A word is a letter with the letters and combining marks that follow it
(Unicode categories L and M); digits, numerals and symbols are no letters.

Defined results: null text, or text without a letter, is ``und`` with score
0. An empty table returns no rows. Only doc_id, lang and text are read,
whatever other columns there are. A null doc_id is neither learned from nor held out. With nothing to learn
from, every document is ``und``. Ties go to the smallest language name.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import cache
from itertools import compress, groupby, repeat
from unicodedata import category

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, small_batches

UNDETERMINED = "und"
MAX_DOCS = 4_000      # labelled documents per language that are learned from
MAX_LANGS = 4_000     # languages, the most frequent
MAX_WORDS = 240_000   # words in the model, dealt over the languages
MAX_GRAMS = 40_000    # n-grams in the model, for each n
MAX_CELLS = 16_000_000  # words (or n-grams of one n) times languages: 128 MB
GRAMS = (5, 4, 3, 2, 1)
_CACHE = 100_000
_FLUSH = 200_000
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")  # beyond the first plane


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 4 is 2; these are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _word(last: int) -> re.Pattern:
    """A letter, then letters and marks, as ranges of the Unicode categories
    up to code point ``last``."""
    ranges: dict[str, list[str]] = {"L": [], "M": []}
    for kind, run in groupby(range(last + 1), lambda c: category(chr(c))[0]):
        if kind in ranges:
            points = list(run)
            ranges[kind].append(f"\\U{points[0]:08x}-\\U{points[-1]:08x}")
    letters, marks = "".join(ranges["L"]), "".join(ranges["M"])
    return re.compile(f"[{letters}][{letters}{marks}]*")


def words_of(text: str) -> list[str]:
    """The words in order. Ranges beyond the first plane are tried one by one
    at every space, ten times the work, so only texts with letters there get them."""
    text, last = text.lower(), 0xFFFF
    for c in set(_ASTRAL.findall(text)):
        if category(c)[0] in "LM":
            last = sys.maxunicode
        else:  # separates words, like a space
            text = text.replace(c, " ")
    return _word(last).findall(text)


def grams_of(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


class Model:
    """Log frequencies: ``words`` and ``grams[n]`` map to rows of matrices."""

    def __init__(self, langs: list[str], words: dict, grams: dict):
        self.langs = langs
        self.words, self.wlog = self._logs(words)
        self.grams = {n: self._logs(grams.get(n, {})) for n in GRAMS}
        self.cache: dict[str, np.ndarray] = {}

    def _logs(self, counts: dict):
        k = len(self.langs)
        c = np.array(list(counts.values()), np.float64).reshape(len(counts), k)
        total = c.sum(0) + 0.5 * (len(c) + 1)
        return {g: i for i, g in enumerate(counts)}, np.log((c + 0.5) / total)

    def unseen(self, word: str) -> np.ndarray:
        """Backoff score of a word outside the vocabulary."""
        got = self.cache.get(word)
        if got is None:
            got = np.zeros(len(self.langs))
            for n in GRAMS:
                index, logs = self.grams[n]
                at = [i for i in map(index.get, grams_of(word, n)) if i is not None]
                if at:
                    got = logs[at].mean(0)
                    break
            if len(self.cache) < _CACHE:
                self.cache[word] = got
        return got

    def predict(self, text: str) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return UNDETERMINED, 0.0
        at = np.fromiter(map(self.words.get, counts, repeat(-1)), np.intp, len(counts))
        times, known, score = np.fromiter(counts.values(), np.float64, len(counts)), at >= 0, np.zeros(len(self.langs))
        n = int(times.sum())
        for w, c in zip(compress(counts, ~known), times[~known], strict=True):
            score += c * self.unseen(w)
        if known.any():
            score += times[known] @ self.wlog[at[known]]
        best = int(score.argmax())
        # posterior of at most 20 words: a long text must not saturate
        p = np.exp((score - score[best]) * (min(n, 20) / n))
        return self.langs[best], float(1 / p.sum())


def _least(counts: DataFrame, share: int) -> dict[str, int]:
    """Per language, the least count at which at most ``share`` grams are as
    frequent. It comes from the numbers of grams of each count, so no task
    holds a language and equal counts are treated alike."""
    sizes: dict[str, list] = {}
    for lang, n, grams in counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams")).collect():
        sizes.setdefault(lang, []).append((n, grams))
    least = {}
    for lang, rows in sizes.items():
        total, least[lang] = 0, 2**62
        for n, grams in sorted(rows, reverse=True):
            total += grams
            if total > share:
                break
            least[lang] = n
    return least


def _top(counts: DataFrame, langs: list[str], most: int) -> dict[str, list[float]]:
    """Each language's most frequent grams, ``most`` in all, with their count
    per language (driver, bounded)."""
    least = _least(counts, max(1, min(most, MAX_CELLS // len(langs)) // len(langs)))
    if not least:
        return {}
    needed = F.create_map(*[F.lit(x) for item in least.items() for x in item])[F.col("lang")]
    cols = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]
    rows = counts.groupBy("gram").agg(F.max(F.col("n") >= needed).alias("kept"), *cols).where("kept").orderBy("gram").collect()
    return {r["gram"]: list(r[2:]) for r in rows}


def _counted(df: DataFrame, grams) -> DataFrame:
    """(lang, gram, n) from rows of ``df`` by ``grams(batch) -> iterable of ((lang, gram), n)``,
    pre-aggregated in each task under a memory bound."""
    def out(c):
        return {"lang": [k[0] for k in c], "gram": [k[1] for k in c], "n": list(c.values())}

    def run(batch):
        c: Counter = Counter()
        for key, n in grams(batch):
            c[key] += n
            if len(c) >= _FLUSH:
                yield out(c)
                c.clear()
        yield out(c)
    return map_arrow(df, run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _doc_words(batch):
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for w, n in Counter(words_of(text)).items():
            yield (lang, w), n


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from rows with text and lang that are not held out."""
    from .common import Scratch

    spark = docs.sparkSession
    train = docs.select("doc_id", "lang", "text").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.where(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select("lang", "text")
    scratch = Scratch(spark, "langid")
    counts = scratch.save(_counted(sample, _doc_words), "words")
    words = _top(counts, langs, max_words)
    grams = {}
    for n in GRAMS:
        def of(batch, n=n):
            for lang, w, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for g in grams_of(w, n):
                    yield (lang, g), c
        grams[n] = _top(scratch.save(_counted(counts, of), f"grams{n}"), langs, max_grams)
    scratch.drop("words", *[f"grams{n}" for n in GRAMS])
    return Model(langs, words, grams)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(kept columns, lang_pred, score) of every row; reads only the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    src = docs.select(*keep, "text")

    def run(batch):
        m = shared.value
        got = [m.predict(t) if t is not None else (UNDETERMINED, 0.0) for t in batch.column(len(keep)).to_pylist()]
        return {**{c: batch.column(i) for i, c in enumerate(keep)},
                "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}
    return map_arrow(src, run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document."""
    return predict(docs.select("doc_id", "lang", "text"), fit(docs), "doc_id").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have no language (``und``); a null lang
    becomes the predicted one. Where there was nothing to learn from, only
    null and letterless texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        m = shared.value
        for batch in batches:
            text_at, lang_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            found = [UNDETERMINED if t is None else m.predict(t)[0] if m.langs else None if words_of(t) else UNDETERMINED
                     for t in batch.column(text_at).to_pylist()]
            field = batch.schema.field(lang_at)
            lang = pc.coalesce(batch.column(lang_at), pa.array(found, field.type))
            yield batch.set_column(lang_at, field, lang).filter(pa.array([x != UNDETERMINED for x in found], pa.bool_()))
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
