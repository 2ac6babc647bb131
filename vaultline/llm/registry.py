"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, fingerprints, html_extract, langid, line_dedup, merkle, packing, phrases, quality, simhash,
               suffix_dedup, token_counts, warc)
from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_html_extract(spark, sf_dir):
    """Main text of all pages."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op2_token_counts(spark, sf_dir):
    """Token counts of all documents."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    """SimHash near-duplicate groups of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    """All documents without passages that start earlier."""
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    """Predicted language of all documents."""
    return langid.language_id(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    """Benchmark windows found in all documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark, sf_dir):
    """Quality verdict of all documents."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark, sf_dir):
    """All documents without repeated or near-repeated lines."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    """All pages written to WARC bundles and read back."""
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op10_packing(spark, sf_dir):
    """Place of every piece of all documents in training sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    """Merkle leaves, roots and proofs of all documents."""
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_phrases(spark, sf_dir):
    """Collocations of all documents, by language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_html_extract, op2_token_counts, op3_simhash, op4_suffix_dedup, op5_language_id, op6_decontamination, op7_quality,
    op8_line_dedup, op9_warc, op10_packing, op11_merkle_manifest, op12_phrases, op13_fingerprints)}
SQL: dict[str, str] = {"op6_decontamination": decontaminate.SQL, "op9_warc": warc.SQL, "op11_merkle_manifest": merkle.SQL,
                       "op12_phrases": phrases.SQL}


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
