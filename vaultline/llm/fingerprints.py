"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its words, weighted by their number. For each of
``SAMPLES`` samples, every term draws r and c from Gamma(2, 1) and beta from
U(0, 1), all read off hashes of the word, so that they are the same in every
document. With t = floor(ln(weight) / r + beta), ln y = r (t - beta) and
ln a = ln c - ln y - r, the term of least a is the sample, together with t.
Two documents agree in a sample with a probability that equals the sum of the
lesser weights over the sum of the greater ones. A slot of a fingerprint is 24 bits
of a hash of (word, t); a likeness is the share of equal slots.

Documents are put in order by ranges (``repartitionByRange``), and cut into
blocks of ``2 ** BLOCK_BITS`` neighbours; a block's first row is also sent to the block
before it, so that the next document is a ``lead`` inside a block. All later
groupings (words of a document, samples of a document, the next fingerprint)
follow the block's one exchange. A word is known by its XXH64. Every (word,
sample) is a row for generated code only: the least a of a sample and its slot
are one 64-bit number, so the samples are plain minima in a hash aggregate.

Defined results: a null text is empty. A text without words has only zero
slots, and two such texts have a likeness of 1. A null doc_id orders last;
rows of one doc_id are ordered by their text's hash; equal rows follow each
other in any order. The next document of the last row is the first one, also
if there is only one. An empty table returns no rows. Only doc_id and text are
read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch

SAMPLES = 32
BLOCK_BITS = 8
_TAG = 24
_AT_ONCE = 4  # samples in one row of generated code; methods beyond 8000 bytes of code are not compiled
_GUEST = 2**62  # place of a block's extra row, behind its own


def ordered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, n_chars, part, at): rows by descending doc_id; ``at``
    counts from 0 in each part, parts follow each other."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("row")]
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    return scratch.save(d.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"),
                                 F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit(2**33 - 1)).alias("at")), "ordered")


def with_next(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows with their block and ``next``, the next document's text; a block's
    extra last row (at = _GUEST) has null there."""
    sizes = sorted(tuple(r) for r in rows.groupBy("part").agg(F.max("at")).collect())  # a row for each partition
    before = [(p, (sizes[k - 1][0] << (33 - bits)) + (sizes[k - 1][1] >> bits)) for k, (p, _) in enumerate(sizes)]
    before = rows.sparkSession.createDataFrame(before, "part long, last long")
    here = F.shiftleft("part", 33 - bits) + F.shiftright("at", bits)
    own = F.struct(here.alias("block"), F.col("at"))
    guest = F.struct(F.when(F.col("at") > 0, here - 1).otherwise(F.col("last")).alias("block"), F.lit(_GUEST).alias("at"))
    homes = F.when(F.col("at").bitwiseAND(F.lit((1 << bits) - 1)) == 0, F.array(own, guest)).otherwise(F.array(own))
    spread = rows.join(F.broadcast(before), "part").select("doc_id", "text", "n_chars", F.explode(homes).alias("home"))
    flat = spread.select("home.block", "home.at", "doc_id", "text", "n_chars")
    return flat.withColumn("next", F.lead("text").over(Window.partitionBy("block").orderBy("at")))


def kept_chars() -> Column:
    """Code points that the edit leaves."""
    return (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")


def edited_text() -> Column:
    """The text with its last half replaced by the next text's beginning."""
    return F.concat(F.substring(F.col("text"), F.lit(1), kept_chars()),
                    F.substring(F.col("next"), F.lit(1), F.floor(F.col("n_chars") / 2).cast("int")))


def _uniform(h: Column, at: int, bits: int) -> Column:
    """A number strictly between 0 and 1 from ``bits`` bits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))


def draws(word: Column, sample: Column) -> tuple[Column, Column, Column]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), and beta ~ U(0, 1) of a word (its hash) in a sample."""
    one, two = F.xxhash64(word, sample), F.xxhash64(sample, word)
    r = -F.ln(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    ln_c = F.ln(-F.ln(_uniform(two, 0, 32) * _uniform(two, 32, 32)))
    return r, ln_c, _uniform(one, 42, 21)


def ranked_sample(ln_weight: Column, word: Column, r: Column, ln_c: Column, beta: Column) -> Column:
    """ln a in the high bits (it lies between -96 and 32), 24 bits of a hash of
    (word, t) in the low ones; null if there is no weight."""
    t = F.floor(ln_weight / r + beta)
    ln_a = ln_c - r * (t - beta + F.lit(1.0))
    rank = F.shiftleft(F.floor((ln_a + F.lit(96.0)) * F.lit(float(1 << 31))).cast("long"), _TAG)
    return rank.bitwiseOR(F.xxhash64(word.bitwiseXOR(t)).bitwiseAND(F.lit((1 << _TAG) - 1)))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, a, b): slots of the texts in columns ``a`` and ``b``, which begin
    with the same ``kept`` code points. Rows of a key must be on one
    partitioning by a part of the keys."""
    split = lambda c: F.split(F.lower(c), r"[\x20\x09-\x0D]+")
    # all but the last word of what is kept are words of both texts and appear once, flagged for both
    words = texts.select(*keys, split("a").alias("a"), split(F.coalesce("b", F.lit(""))).alias("b"),
                         (F.size(split(F.substring(F.col("a"), F.lit(1), F.col("kept")))) - 1).alias("both"))
    words = words.select(*keys, F.size("a").alias("n"), "both", F.posexplode(
        F.concat("a", F.slice("b", F.col("both") + 1, F.size("b")))).alias("i", "word"))
    is_word = F.col("word") != ""  # a text without words still has its row
    in_a, in_b = F.col("i") < F.col("n"), (F.col("i") < F.col("both")) | (F.col("i") >= F.col("n"))
    words = words.select(*keys, F.xxhash64("word").alias("word"), (in_a & is_word).cast("long").alias("a"), (in_b & is_word).cast("long").alias("b"))
    counts = words.groupBy(*keys, "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.sortWithinPartitions(*keys)  # the minima of one document at a time stay in the processor's cache
    weighted = counts.select(*keys, "word", *[F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))).alias(c) for c in "ab"],
                             F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(_AT_ONCE))).alias("k"))
    drawn = weighted.select("*", *[c.alias(f"{n}{j}") for j in range(_AT_ONCE)
                                   for n, c in zip("rcu", draws(F.col("word"), F.col("k") + F.lit(j)), strict=True)])
    least = drawn.groupBy(*keys, "k").agg(*[
        F.min(ranked_sample(F.col(c), F.col("word"), F.col(f"r{j}"), F.col(f"c{j}"), F.col(f"u{j}"))).alias(f"{c}{j}")
        for c in "ab" for j in range(_AT_ONCE)])
    slots = [F.array(*[F.coalesce(F.col(f"{c}{j}").bitwiseAND(F.lit((1 << _TAG) - 1)), F.lit(0)).cast("int") for j in range(_AT_ONCE)]).alias(c)
             for c in "ab"]
    rows = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", *slots))).alias("s"))
    return rows.select(*keys, *[F.slice(F.flatten(F.col(f"s.{c}")), 1, samples).alias(c) for c in "ab"])


def likeness(one: Column, two: Column) -> Column:
    """Share of equal slots."""
    same = F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda x: x))
    return same / F.size(one)


def _text_of(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x)), _TAG // 4, "0")), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, bits: int = BLOCK_BITS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows, keys = ordered(docs, scratch), ["block", "at"]
    scratch.free()
    own = F.col("at") < _GUEST
    named = with_next(rows, bits).where(own).select(*keys, "doc_id", "n_chars", F.sha2(edited_text().cast("binary"), 256).alias("edited_sha256"))
    named = scratch.save(named, "edited")
    scratch.free()
    signed = signatures(with_next(rows, bits).select(*keys, F.col("text").alias("a"), edited_text().alias("b"), kept_chars().alias("kept")), keys, samples)
    signed = signed.withColumn("next", F.lead("a").over(Window.partitionBy("block").orderBy("at"))).where(own)
    signed = signed.select(*keys, _text_of(F.col("a")).alias("fingerprint"), _text_of(F.col("b")).alias("edited_fingerprint"),
                           likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"))
    signed = scratch.save(signed, "signed")
    scratch.drop("ordered")
    return named.join(signed, keys).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
