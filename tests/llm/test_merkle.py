"""Merkle manifest against plain recursion, awkward rows, and tampering."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from vaultline.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The root and, per node, the steps (before, after) on its way."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 2 * 2: p // 2 * 2 + 2]
            paths[k].append(("".join(run[:p % 2]), "".join(run[p % 2 + 1:])))
        nodes = [h(*nodes[i: i + 2]) for i in range(0, len(nodes), 2)]
        place = [p // 2 for p in place]
    return nodes[0] if nodes else "", paths


def brute(rows) -> Counter:
    """rows: (doc_id, text, lang, source, n_chars)"""
    groups: dict = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(*map(field, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        bad = h(*map(field, (doc_id, source, lang, n + 1, text))) if hit else leaf
        groups.setdefault(lang, []).append((doc_id, leaf, bad))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in order:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[lang] = tree([x[1] for x in groups[lang]])
    root, tops = tree([subs[x][0] for x in order])
    out = Counter()
    for lang, top in zip(order, tops, strict=True):
        for (doc_id, leaf, bad), own in zip(groups[lang], subs[lang][1], strict=True):
            acc = bad
            for a, b in own + top:
                acc = h(a, acc, b)
            out[doc_id, leaf, subs[lang][0], root, h(*(a + b for a, b in own + top)), acc, acc == root] += 1
    return out


def report(df, **kw) -> Counter:
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in cols) for r in merkle.manifest_report(df, **kw).collect())


@pytest.mark.parametrize("digits", [2, 8])
def test_awkward_rows(odd_docs, odd_rows, digits):
    got = report(odd_docs, digits=digits)
    assert got == brute([(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows])


@pytest.mark.parametrize("n", [0, 1, 3, 8, 17])
def test_sizes_over_block_bounds(spark, n):
    rows = [(i * 3, f"text {i}", "xx", None, i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert report(df, digits=2) == brute(rows)


def test_many_languages_and_a_hot_one(spark):
    rows = [(i, "same", f"l{i % 37}" if i % 3 else "hot", "s", None if i % 5 == 0 else 4) for i in range(300)]
    rows += [(7, "again", "hot", "s", 4)] * 40  # repeated rows are leaves of their own
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(7)
    got = report(df, digits=3)
    assert got == brute(rows)
    assert {k[6] for k in got} == {True, False}


def test_only_tampered_rows_fail(real_docs):
    rows = merkle.manifest_report(real_docs).collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in rows)
    clean = merkle.manifest(real_docs).select("leaf", "root", merkle.fold(merkle.F.col("leaf"), merkle.F.col("path")).alias("x"))
    assert clean.where("x != root").count() == 0
