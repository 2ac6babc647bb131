"""Phrase mining against counting in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultline.llm import phrases
from vaultline.llm.common import Scratch

LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
        w = [x for x in re.split("[ \t]+", p) if x]
        if w:
            yield w


def brute(rows, least=100, width=5, top=2000) -> list[tuple]:
    """rows: (lang, text)"""
    f: dict = {}
    n: Counter = Counter()
    for lang, text in rows:
        for w in pieces(text):
            c = f.setdefault(lang or "und", Counter())
            n[lang or "und"] += len(w)
            c.update(tuple(w[i: i + m]) for m in range(1, width + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside: dict = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i: i + m]] = max(a, inside.get(p[i: i + m], 0))
        rows_ = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= 100 * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        rows_.sort()
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(rows_[:top])]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


@pytest.fixture(scope="module")
def chatter():
    rnd = random.Random(3)
    words = ["a", "b\x01", "b", "b\x01c", "Cc", "dé", "漢字", "e" * 50, "f\x00", "g-h", "'i"]
    rows = []
    for i in range(400):
        n = rnd.choice([0, 1, 2, 5, 40])
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", " . "]) for _ in range(n))
        rows.append((rnd.choice(["xx", "yy", None, "und"]), text if i % 50 else None))
    rows += [("xx", "the fixed passage of many words comes again. And again")] * 200
    return rows


@pytest.mark.parametrize("kw", [{}, {"per_task": 50}, {"max_pairs": 0, "per_task": 40}, {"max_words": 2}, {"max_words": 3, "top": 4}])
def test_against_plain_counting(spark, chatter, kw):
    df = spark.createDataFrame(chatter, "lang string, text string").repartition(5).withColumn("phrase", F.lit("clash")).withColumn("f", F.lit(1))
    got = mined(df, min_count=20, **kw)
    assert got == brute(chatter, 20, kw.get("max_words", 5), kw.get("top", 2000)) and got


def test_awkward_rows(odd_docs, odd_rows):
    assert mined(odd_docs, min_count=3) == brute([(r[2], r[1]) for r in odd_rows], 3)


def test_empty_and_small_batches(spark, no_docs, monkeypatch, chatter):
    assert mined(no_docs) == []
    df = spark.createDataFrame(chatter, "lang string, text string")
    monkeypatch.setattr(phrases, "_BATCH_CHARS", 100)
    monkeypatch.setattr(phrases, "_CHUNK", 3)
    batch = df.limit(50).toArrow().to_batches()[0]
    rows = [r for out in phrases._lead_counts(batch) for r in zip(*[list(map(str, out[c])) for c in ("lang", "phrase", "m", "f")], strict=True)]
    total = Counter()
    for lang, p, m, f in rows:
        total[lang, p, m] += int(f)
    want = Counter()
    for lang, text in chatter[:50]:
        for w in pieces(text):
            want[lang or "und", "", "0"] += len(w)
            want.update((lang or "und", " ".join(w[i: i + m]), str(m)) for m in (1, 2) for i in range(len(w) - m + 1))
    assert +total == want


def test_multikey_quicksort_counts_every_prefix():
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 5, (3000, 5))
    codes[np.arange(5) >= rng.integers(1, 6, 3000)[:, None]] = 0
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for row, w in zip(codes.tolist(), weight.tolist(), strict=True):
        for m in range(1, 6):
            if row[m - 1]:
                want[tuple(row[:m])] += w
    got = {tuple(codes[r, :m].tolist()): f for r, m, f in phrases.sorted_counts(codes, weight, 30, None)}
    assert got == {p: f for p, f in want.items() if f >= 30}


def test_ranges_split_a_common_lead(spark):
    """A leading pair in most windows, over many ranges: partial counts add up."""
    rows = [("xx", f"very common {'abcdefgh'[i % 8]} w{i % 300} {i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.frequent_phrases(df, Scratch(spark, "t"), min_count=50, per_task=20).where("m > 0").collect()
    f = Counter()
    for _, text in rows:
        w = text.split()
        f.update(" ".join(w[i: i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    assert {r["phrase"]: r["f"] for r in got} == {p: n for p, n in f.items() if n >= 50}


def test_products_beyond_64_bits(spark):
    big = 10**10
    table = spark.createDataFrame([("xx", "", 0, 10**13), ("xx", "a", 1, big), ("xx", "b", 1, big + 7), ("xx", "a b", 2, big - 3)],
                                  "lang string, phrase string, m int, f long")
    r = phrases.scored(table).collect()
    assert [x["score"] for x in r] == [1000 * (big - 3) * 10**13 // (big * (big + 7))]
