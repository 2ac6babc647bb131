"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

1. Every batch counts its words and its pairs of neighbouring words; Spark
   adds them up per language. Only the totals, words and pairs that reach
   the minimum are kept (stored): the leading words by which suffixes are
   routed. A phrase can be frequent only if all pairs in it are.
2. A second scan makes a pointer for every word: the window of up to
   ``MAX_WORDS`` words from there to the end of its piece, cut at the first
   pair that is not frequent (while the frequent pairs are at most
   ``MAX_PAIRS``, their hashes are broadcast; beyond that nothing is cut here
   and infrequent windows are only abandoned in step 3). Equal windows are
   merged in the batch and then across batches, so a passage that fills a
   third of the corpus is one row with a count.
3. Distinct windows are routed by ranges of (language, first word, second
   word, ...), which splits even one very common leading word over tasks. A
   task sorts pointers to its windows by the multikey three-way quicksort:
   a pivot word parts a set into less, equal and greater; the equal set shares
   one word more, and its weight is that phrase's count. Sets below the
   minimum are abandoned, except those that hold the range's first or last
   window: their phrases may go on in the neighbouring range. Partial counts
   of a phrase are added up afterwards.
4. Scores join each cut's two parts to the table of frequent phrases, which
   holds every part of a frequent phrase. Numbers are decimals of 38 digits.

Defined results: a null text has no words, a null language is ``und``.
Repeated rows each count. An empty table returns no rows. Only lang and text
are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, map_arrow

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
MAX_PAIRS = 2_000_000  # 16 MB of hashes
WINDOWS_PER_TASK = 500_000
_SALTS = 64
_CHUNK = 50_000
_BATCH_CHARS = 2_500_000  # a batch's rows are taken in parts of about this length (or one row)
# bytes: A-Z to a-z, blanks to a space, piece ends to a newline
_FOLD = bytes(0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b in (0x20, 0x09) else b + 32 if 0x41 <= b <= 0x5A else b
              for b in range(256))


class Words:
    """The words of a batch of (lang, text) rows, as codes in text order."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]
        buf = np.frombuffer((b"\n".join(raw) + b"\n").translate(_FOLD), np.uint8)
        rows = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)  # each row ends with a piece end
        del raw
        inside = (buf != 0x20) & (buf != 0x0A)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))  # the last byte is never inside
        starts, ends = edge[::2], edge[1::2]
        piece = np.searchsorted(np.flatnonzero(buf == 0x0A), starts)
        last = np.flatnonzero(np.diff(piece, append=-1) != 0)  # the last word of each piece
        self.n = len(starts)
        self.left = (np.repeat(last, np.diff(last, prepend=-1)) - np.arange(self.n) + 1).astype(np.int32)  # words to the piece's end
        langs = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        self.lang = codes[np.searchsorted(rows, starts, side="right")].astype(np.int64)
        self.bytes = buf[inside]
        self.at = np.concatenate(([0], np.cumsum(ends - starts)))
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.at), pa.py_buffer(self.bytes)]) \
            .dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary

    def hashes(self) -> np.ndarray:
        """XXH64 of each distinct word."""
        return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def grouped(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of ``length`` words at the word numbers ``at``: a word
        number of each distinct (lang, window), and how often it occurs."""
        key = self.lang[at] * (len(self.words) + 1) + self.code[at] + 1
        for k in range(1, int(length.max(initial=1))):
            ids = np.unique(key, return_inverse=True)[1]
            more = length > k
            nxt = np.zeros(len(at), np.int64)
            nxt[more] = self.code[at[more] + k] + 1
            key = ids * (len(self.words) + 1) + nxt
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        return first, times

    def texts(self, at: np.ndarray, length: np.ndarray) -> pa.Array:
        """Windows as text, words joined by a space."""
        size = self.at[at + length] - self.at[at] + length  # each word and one space
        ends = np.cumsum(size)
        begin = ends - size
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        for k in range(int(length.max(initial=0))):
            has = length > k
            w = at[has] + k
            n = self.at[w + 1] - self.at[w]
            to = begin[has] + self.at[w] - self.at[at[has]] + k
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + step] = self.bytes[np.repeat(self.at[w], n) + step]
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False  # the space after the last word
        offsets = np.concatenate(([0], np.cumsum(size - 1))).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(out[keep])])

    def rows(self, at: np.ndarray, length: np.ndarray, times: np.ndarray):
        """Output chunks (lang, phrase, m, f) of the given windows."""
        names = pa.array(self.langs, pa.string())
        for i in range(0, len(at), _CHUNK):
            a, m = at[i: i + _CHUNK], length[i: i + _CHUNK]
            yield {"lang": names.take(pa.array(self.lang[a])), "phrase": self.texts(a, m), "m": pa.array(m, pa.int32()),
                   "f": pa.array(times[i: i + _CHUNK], pa.int64())}


def parts_of(batch):
    """The batch's words, in parts of bounded length."""
    ends = pc.cumulative_sum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BATCH_CHARS, side="right")))
        yield Words(batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at))
        at = upto


COUNTS = "lang string, phrase string, m int, f long"


def _lead_counts(batch):
    """A batch's words (m = 1), pairs (2) and numbers of words per language (0)."""
    for b in parts_of(batch):
        per_lang = np.bincount(b.lang, minlength=len(b.langs))
        yield {"lang": b.langs, "phrase": [""] * len(b.langs), "m": [0] * len(b.langs), "f": per_lang.tolist()}
        for m in (1, 2):
            at = np.flatnonzero(b.left >= m)
            first, times = b.grouped(at, np.full(len(at), m, np.int32))
            yield from b.rows(at[first], np.full(len(first), m, np.int32), times)


def lead_counts(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, m, f): words and pairs that reach ``min_count``, and m = 0: all words of a language."""
    c = map_arrow(docs.select("lang", "text"), _lead_counts, COUNTS)
    c = c.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f"))
    return c.where((F.col("m") == 0) & (F.col("f") > 0) | (F.col("m") > 0) & (F.col("f") >= min_count))


def _mix(lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A 64-bit hash of (lang, word, word) from the three hashes, wrapping."""
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    h = (lang * m1) ^ (one + (lang >> np.uint64(29)))
    h = (h * m2) ^ (h >> np.uint64(31)) ^ two
    h = (h * m1) ^ (h >> np.uint64(27))
    return h


def _hash_of(texts) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts))


def pair_filter(leads: DataFrame, max_pairs: int = MAX_PAIRS):
    """The sorted hashes of all frequent pairs, broadcast; None if there are more than ``max_pairs``."""
    pairs, spark = leads.where("m = 2"), leads.sparkSession
    if pairs.count() > max_pairs:
        return None

    def run(batch):
        two = [p.split(" ") for p in batch.column(1).to_pylist()]
        h = _mix(_hash_of(batch.column(0).to_pylist()), _hash_of([x[0] for x in two]), _hash_of([x[1] for x in two]))
        return {"h": [h.astype("<u8").tobytes()]}
    found = [np.frombuffer(r["h"], "<u8") for r in map_arrow(pairs.select("lang", "phrase"), run, "h binary").toLocalIterator()]
    return spark.sparkContext.broadcast(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))


def windows(docs: DataFrame, frequent=None, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, m, f): distinct windows of three words or more, with their counts."""
    def reach(b):
        """How far the window from each word goes."""
        length = np.minimum(b.left, max_words)
        if frequent is None or not b.n:
            return length
        h, known = b.hashes()[b.code], frequent.value
        mixed = _mix(_hash_of(b.langs)[b.lang[:-1]], h[:-1], h[1:])
        spot = np.minimum(np.searchsorted(known, mixed), max(len(known) - 1, 0))
        good = np.concatenate(((known[spot] == mixed) if len(known) else np.zeros(b.n - 1, bool), [False]))
        stop = np.flatnonzero(~good)  # no window goes on after these words
        return np.minimum(length, stop[np.searchsorted(stop, np.arange(b.n))] - np.arange(b.n) + 1).astype(np.int32)

    def run(batch):
        for b in parts_of(batch):
            length = reach(b)
            at = np.flatnonzero(length >= 3)
            first, times = b.grouped(at, length[at])
            yield from b.rows(at[first], length[at[first]], times)
    w = map_arrow(docs.select("lang", "text"), run, COUNTS)
    return w.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f"))


def sorted_counts(codes: np.ndarray, weight: np.ndarray, least: int, ends: tuple[int, int] | None, depth: int = 0):
    """Multikey three-way quicksort of the rows of ``codes`` (0: no word).

    Yields (row, words, weight) for every prefix of more than ``depth`` words
    whose weight reaches ``least``, or that is a prefix of a row of ``ends``."""
    width = codes.shape[1]
    todo = [(np.arange(len(codes)), 0)]
    while todo:
        rows, d = todo.pop()
        if not len(rows) or weight[rows].sum() < least and not any((rows == e).any() for e in ends or ()):
            continue
        word = codes[rows, d]
        pivot = word[len(word) // 2]
        equal = rows[word == pivot]
        todo.append((rows[word < pivot], d))
        todo.append((rows[word > pivot], d))
        if pivot:
            total = int(weight[equal].sum())
            if total >= least or any((equal == e).any() for e in ends or ()):
                if d >= depth:
                    yield int(equal[0]), d + 1, total
                if d + 1 < width:
                    todo.append((equal, d + 1))


def phrase_counts(w: DataFrame, total: int, min_count: int, max_words: int, per_task: int = WINDOWS_PER_TASK) -> DataFrame:
    """(lang, phrase, m, f) of the phrases of three words or more that reach ``min_count``."""
    cols = [f"w{k}" for k in range(max_words)]
    parts = F.split("phrase", " ")
    split = w.select("lang", *[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(cols)], "f")
    dealt = split.repartitionByRange(max(1, -(-total // per_task)), "lang", *cols)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        n = table.num_rows
        both = pa.concat_arrays([table.column(c).combine_chunks().cast(pa.string()) for c in ["lang", *cols]]).dictionary_encode()
        rank = np.empty(len(both.dictionary) + 1, np.int32)
        rank[pc.sort_indices(both.dictionary.cast(pa.binary())).to_numpy()] = np.arange(1, len(both.dictionary) + 1)
        codes = rank[pc.fill_null(both.indices, len(both.dictionary)).to_numpy()] if rank.size > 1 else None
        codes = np.where(pc.is_null(both).to_numpy(zero_copy_only=False), 0, codes).reshape(max_words + 1, n).T.copy()
        order = np.lexsort(codes.T[::-1])
        weight = table.column("f").to_numpy()
        found = list(sorted_counts(codes, weight, min_count, (int(order[0]), int(order[-1])), depth=3))
        for i in range(0, len(found), _CHUNK):
            row, m, f = (np.array(x, np.int64) for x in zip(*found[i: i + _CHUNK], strict=True))
            picked = table.take(pa.array(row))
            words = [picked.column(c).combine_chunks().cast(pa.string()) for c in cols]
            words = [pc.if_else(pa.array(m - 1 > k), c, pa.scalar(None, pa.string())) for k, c in enumerate(words)]
            phrase = pc.binary_join_element_wise(*words, " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([picked.column("lang").combine_chunks().cast(pa.string()), phrase,
                                              pa.array(m - 1, pa.int32()), pa.array(f)], ["lang", "phrase", "m", "f"])
    out = dealt.mapInArrow(run, COUNTS)
    return out.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     max_pairs: int = MAX_PAIRS, per_task: int = WINDOWS_PER_TASK) -> DataFrame:
    """(lang, phrase, m, f) of all phrases of 1 to ``max_words`` words that occur
    ``min_count`` times or more, and of each language's number of words (m = 0)."""
    leads = scratch.save(lead_counts(docs, min_count), "leads")
    if max_words < 3:
        return leads.where(F.col("m") <= max_words)
    pairs = pair_filter(leads, max_pairs)
    w = scratch.save(windows(docs, pairs, max_words), "windows")
    longer = phrase_counts(w, w.count(), min_count, max_words, per_task)
    all_phrases = scratch.save(leads.unionByName(longer), "phrases")
    scratch.drop("leads", "windows")
    return all_phrases


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, m, a, l, r, n, score."""
    f = phrases.where("m > 0").select("lang", "phrase", "f")
    cut = phrases.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"),
                                        F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    cut = cut.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.join(phrases.where("m = 0").select("lang", F.col("f").alias("n")), "lang")
    # at most 1000 n, so the quotient fits 64 bits; the products are decimals of up to 38 digits
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "m", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "m", "a", "x.l", "x.r", "n", "x.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, inside): the highest count of a longer candidate that holds the phrase."""
    long = phrases.where("m > 2").select("lang", "m", F.col("f").alias("inside"), F.split("phrase", " ").alias("w"))
    sub = long.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    sub = sub.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    sub = sub.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "inside")
    return sub.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 percent: int = 100, max_pairs: int = MAX_PAIRS, per_task: int = WINDOWS_PER_TASK) -> DataFrame:
    """Each language's ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "phrases")
    phrases = frequent_phrases(docs, scratch, min_count, max_words, max_pairs, per_task)
    inside = scratch.save(contained(phrases), "contained")
    kept = scored(phrases).join(inside, ["lang", "phrase"], "left").where(
        F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# DuckDB form of collocations() with its defaults.
SQL = r"""
WITH piece AS (SELECT row_number() OVER () AS id, lang, p FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL)),
word AS (SELECT id, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
tok AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM word),
next AS (SELECT lang, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM tok WINDOW o AS (PARTITION BY id ORDER BY i)),
gram AS (SELECT lang, 1 AS m, a AS phrase, count(*) AS f FROM next GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM next WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c), count(*) FROM next WHERE c IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d), count(*) FROM next WHERE d IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, concat_ws(' ', a, b, c, d, e), count(*) FROM next WHERE e IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word GROUP BY lang),
freq AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM gram WHERE f >= 100),
cut AS (SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.w[:k], ' ') AS x, array_to_string(c.w[k + 1:], ' ') AS y
  FROM freq c, range(1, 5) t(k) WHERE c.m > k),
scored AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN freq x ON x.lang = cut.lang AND x.phrase = cut.x JOIN freq y ON y.lang = cut.lang AND y.phrase = cut.y JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(w[s:s + j - 1], ' ') AS phrase, max(f) AS f FROM (
  SELECT lang, w, j, f, unnest(range(1, len(w) - j + 2)) AS s FROM freq, range(2, 5) t(j) WHERE m > j) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, n, score
FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.phrase = best.phrase WHERE sub.f IS NULL OR 100 * sub.f < 100 * a
QUALIFY rank <= 2000
"""
