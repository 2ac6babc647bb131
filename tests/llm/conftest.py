"""Shared rows: every awkward case, plus real documents of the smallest table."""

from __future__ import annotations

import random

import duckdb
import pytest

from ..conftest import SF_SMALL

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `spans` string, `n_words` int, `score` string"


def _docs() -> list[tuple]:
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("st", "tt", "ven", "da", "qui")]

    def prose(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))
    passage = prose(60, 1)
    base = prose(200, 2)
    edited = base.split()
    edited[100] = "changed"
    texts = [
        None, "", "   \n\t ", "a", "One Two", "12 34 !!", base, base, " ".join(edited), base.upper(),
        prose(80, 3) + "\n" + passage + "\n" + prose(30, 4), prose(50, 5) + "\n" + passage + "\n" + prose(90, 6),
        "x" * 5000, "ab" * 3000, "é" * 300 + " ñ " + "漢字" * 100, "tab\tsep\r\nline\x0bvt\x0cff nbsp x ▁mark <s> <|endoftext|>",
        prose(20_000, 8), "\n".join(["same line again and again"] * 40), "### $$$ %%% " * 30, "nul \x00 byte " * 20,
    ]
    texts += [prose(rnd.randint(1, 60), 100 + i) for i in range(20)]
    rows = [(i, t, "xx" if i % 3 else "yy", "s", len(t or ""), "clash", 5, "z") for i, t in enumerate(texts)]
    rows += [rows[6], rows[10], rows[0]]                                       # repeated rows
    rows += [(6, prose(40, 9), "xx", None, None, None, None, None)]            # an id with another text
    rows += [(None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return _docs()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def real_rows():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{SF_SMALL}/documents.parquet') ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def identity(row) -> tuple:
    """Corpus order of a document row: id (null last), then the text's XXH64 as a signed number."""
    import xxhash
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return (2**63 - 1 if row[0] is None else row[0], h - 2**64 if h >= 2**63 else h)
