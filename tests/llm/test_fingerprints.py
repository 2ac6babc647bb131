"""Fingerprints: edits against plain Python, likeness against the generalised Jaccard similarity."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from vaultline.llm import fingerprints as fp

from .conftest import DOC_SCHEMA


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0


def edited(a: str, b: str) -> str:
    return a[:len(a) - len(a) // 2] + b[:len(a) // 2]


def test_edits_and_neighbours_of_real_documents(real_docs, real_rows):
    got = {r["doc_id"]: r for r in fp.fingerprints(real_docs.repartition(5), bits=3).collect()}
    rows = [(i, t or "") for i, t, _ in sorted(real_rows, key=lambda r: -r[0])]
    by_text: dict = {}
    off = []
    for k, (i, text) in enumerate(rows):
        nxt, r = rows[(k + 1) % len(rows)], got[i]
        e = edited(text, nxt[1])
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        same = sum(r["fingerprint"][j: j + 6] == got[nxt[0]]["fingerprint"][j: j + 6] for j in range(0, 192, 6)) / 32
        assert r["near_next"] == same and len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 192
        off.append(r["near_edited"] - jaccard(text, e))
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.4


def test_awkward_rows(odd_docs, odd_rows):
    got = fp.fingerprints(odd_docs, bits=2).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((r[0], len(r[1] or "")) for r in odd_rows)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = Counter((d, hashlib.sha256(edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (d, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, f"word{i} and more", None, None, None, None, None, None) for i in range(n)], DOC_SCHEMA)
    got = sorted(fp.fingerprints(df, bits=1).collect(), reverse=True)
    assert [r["doc_id"] for r in got] == list(reversed(range(n)))
    for k, r in enumerate(got):
        a, b = f"word{r['doc_id']} and more", f"word{got[(k + 1) % n]['doc_id']} and more"
        assert r["edited_sha256"] == hashlib.sha256(edited(a, b).encode()).hexdigest()
        assert r["near_next"] == 1 if n == 1 else True


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """Weighted pairs, many samples: the share of equal slots is near the similarity."""
    rnd = random.Random(2)
    pairs = []
    for i in range(8):
        a = [w for w in "abcdefghij" for _ in range(rnd.choice([0, 1, 3, 20, 200]))]
        b = [w for w in "abcdefghijkl" for _ in range(rnd.choice([0, 1, 2, 25, 150]))]
        pairs.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "pair long, a string, b string").withColumn("kept", F.lit(0)).repartition("pair")
    got = fp.signatures(df, ["pair"], 2000).select("pair", fp.likeness(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        want = jaccard(*pairs[r["pair"]][1:])
        assert abs(r["s"] - want) < 4 * math.sqrt(want * (1 - want) / 2000) + 0.002


def test_samples_by_hand(spark):
    """The slots of one text, term by term, in plain Python."""
    def signed(h):
        return h - (h >> 63 << 64)

    def xx(*parts):
        seed = 42
        for v, size in parts:
            seed = xxhash.xxh64_intdigest((v % 2**(8 * size)).to_bytes(size, "little"), seed)
        return seed
    text = "one two two three three three four"
    slots = []
    for k in range(fp.SAMPLES):
        best = None
        for word, n in Counter(text.split()).items():
            h = xxhash.xxh64_intdigest(word.encode(), 42)
            one, two = xx((h, 8), (k, 4)), xx((k, 4), (h, 8))
            u = lambda x, at, bits: ((x >> at) % 2**bits + 0.5) / 2**bits
            r = -math.log(u(one, 0, 21) * u(one, 21, 21))
            ln_c = math.log(-math.log(u(two, 0, 32) * u(two, 32, 32)))
            beta = u(one, 42, 21)
            t = math.floor(math.log(n) / r + beta)
            best = min(best or (9e9, 0), (ln_c - r * (t - beta + 1), xx((signed(h) ^ t, 8)) % 2**24))
        slots.append(f"{best[1]:06x}")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert fp.fingerprints(df).first()["fingerprint"] == "".join(slots)
