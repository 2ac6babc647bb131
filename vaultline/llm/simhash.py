"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the bit radius;
two fingerprints within the radius share at least one variant. Rows shuffle
on the variant. A variant's bucket holds at most as many distinct
fingerprints as the half-radius ball has points (65 for radius 2), whatever
the data, because equal fingerprints were merged before: no bucket is hot.
Colliding pairs are deduplicated and verified by their bit distance.

Defined results: null or wordless text has fingerprint zero and is linked
like any other. A null doc_id orders last; a component of null ids only has a
null component_id. Repeated rows each return. An empty table returns no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, id_or_null, map_arrow
from .components import connected

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_CHUNK = 200_000  # shingles hashed at a time: bounds memory for very long texts


def fingerprint(text: str, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the k-word shingles (repeats included)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    k = min(k, len(words))
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1:]
    ones = np.zeros(64, np.int64)
    h64 = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        s, e = starts[at: at + _CHUNK].tolist(), ends[at: at + _CHUNK].tolist()
        h = np.array([h64(buf[i:j], SEED) for i, j in zip(s, e, strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(document key, fp) of every row; fp is the signed 64-bit fingerprint."""
    def run(batch):
        return {KEY_D: batch.column(0), KEY_H: batch.column(1),
                "fp": [fingerprint(t, k) for t in batch.column(2).to_pylist()]}
    return map_arrow(doc_texts(docs), run, f"{KEY_D} long, {KEY_H} long, fp long")


def _ball(radius: int) -> list[int]:
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _variants(fps: DataFrame, radius: int) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(radius)])
    return fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to connect
    every two within ``max_bits``. For an even radius all members of a bucket
    are linked, so each is paired with the bucket's smallest; for an odd one
    all pairs of the (bounded) bucket are checked."""
    half = max_bits // 2
    if max_bits % 2 == 0:
        low = F.min("fp").over(Window.partitionBy("variant"))
        pairs = _variants(fps, half).select("fp", low.alias("a")).where("a < fp").select("a", F.col("fp").alias("b"))
    else:
        left = _variants(fps, half).withColumnRenamed("fp", "a")
        right = _variants(fps, max_bits - half).withColumnRenamed("fp", "b")
        pairs = left.join(right, "variant").where("a != b").select("a", "b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def simhash_groups(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   scratch: Scratch | None = None) -> DataFrame:
    """(document key, fp, root, low_d, low_h) per row: ``root`` names the
    component (its smallest fingerprint), (low_d, low_h) is its first document."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    f = scratch.save(fingerprints(docs, k), "fp")
    per_fp = scratch.save(f.groupBy("fp").agg(F.min(F.struct(KEY_D, KEY_H)).alias("low")), "distinct")
    nodes = connected(links(per_fp.select("fp"), max_bits), scratch).withColumnRenamed("node", "fp")
    rooted = per_fp.join(nodes, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    rooted = scratch.save(rooted, "rooted")
    low = scratch.save(rooted.groupBy("root").agg(F.min("low").alias("first")), "first")
    per_root = rooted.select("fp", "root").join(low, "root")
    return f.join(per_root, "fp").select(*KEYS, "fp", "root", F.col(f"first.{KEY_D}").alias("low_d"),
                                         F.col(f"first.{KEY_H}").alias("low_h"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    g = simhash_groups(docs, k, max_bits)
    return g.select(id_or_null(F.col(KEY_D)).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    id_or_null(F.col("low_d")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the first document of each group (smallest doc_id, then
    text hash), all columns kept; a document listed several times stays once."""
    from .common import keyed

    # simhash_groups keeps fingerprints of any radius; only winners' keys join the texts
    g = simhash_groups(docs, k, max_bits)
    winners = g.select(F.col("low_d").alias(KEY_D), F.col("low_h").alias(KEY_H)).distinct()
    return (keyed(docs).join(winners, KEYS, "left_semi").dropDuplicates(KEYS).drop(*KEYS))
