"""Empty tables, the registered queries against DuckDB, components, and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vaultline.llm import (decontaminate, langid, line_dedup, packing, quality, registry, simhash, suffix_dedup, token_counts,
                           warc)
from vaultline.llm.common import Scratch
from vaultline.llm.components import connected
from vaultline.plans.oracle import canon, duckdb_tables

from ..conftest import SF_SMALL


def test_empty_tables(spark, no_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (token_counts.token_counts(no_docs), simhash.near_duplicates(no_docs), simhash.keep_first(no_docs),
               suffix_dedup.removal_report(no_docs), langid.language_id(no_docs), langid.keep_identified(no_docs),
               decontaminate.contamination(no_docs, bench), decontaminate.drop_contaminated(no_docs, bench),
               quality.quality(no_docs, labels), line_dedup.dedup_lines(no_docs), line_dedup.line_report(no_docs),
               packing.pack(no_docs), warc.archive_report(pages)):
        assert df.collect() == []
    assert decontaminate.contamination(odd_docs, bench).where("contaminated").count() == 0
    assert quality.quality(odd_docs, labels).where("kept = base_failed").count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_registered_sql(spark, name):
    duck = duckdb_tables(SF_SMALL)
    df = registry.QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(registry.SQL[name])
    cols = [d[0] for d in cur.description]
    assert canon(df.columns, df.collect()) == canon(cols, cur.fetchall())


def test_components_of_chains_stars_and_random_graphs(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000)]
    edges += [(rnd.randint(2000, 2200), rnd.randint(2000, 2200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    assert got == {n: root[n] for e in edges if e[0] != e[1] for n in e}


def test_pipeline_stages(spark, real_docs):
    docs, names = real_docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, docs, SF_SMALL), name)
        assert after.columns == real_docs.columns
        before_ids, ids = {r[0] for r in docs.select("doc_id").collect()}, [r[0] for r in after.select("doc_id").collect()]
        assert set(ids) <= before_ids and len(ids) == len(set(ids))
        if name == "simhash_dedup":
            groups = simhash.near_duplicates(docs).collect()
            assert set(ids) == {r["component_id"] for r in groups}
        if name == "decontamination":
            bad = decontaminate.contamination(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).where("contaminated")
            assert set(ids) == before_ids - {r["doc_id"] for r in bad.collect()}
        docs = after
    packed = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(ids)


def test_pipeline_without_labels_keeps_texts(spark, odd_docs, odd_rows):
    """No label at all, or all labelled rows held out: only what has no letter goes."""
    want = Counter(r[1] for r in odd_rows if r[1] and any(c.isalpha() for c in r[1]))
    no_label = F.lit(None).cast("string")
    for lang in (no_label, F.when(langid.held_out(), "xx")):
        docs = odd_docs.withColumn("lang", lang)
        kept = corpus_pipeline.identify_language(spark, docs, SF_SMALL)
        assert kept.columns == docs.columns and Counter(r["text"] for r in kept.collect()) == want
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "unlabelled").save(stage(spark, docs, SF_SMALL), "stage")
    assert docs.count() > 0


def test_pipeline_on_awkward_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "odd").save(stage(spark, docs, SF_SMALL), "stage")
    assert docs.count() > 0
