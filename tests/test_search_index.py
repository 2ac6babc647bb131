"""Indexed search returns the rows of a whole scan and opens few segments."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vaultline.functions.scalars import contains_any, like_any
from vaultline.sources.search_index import SearchIndex, like_runs

COLUMNS = ["name", "email"]
SCHEMA = "id string, name string, email string, n int"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def _people(spark, n=600):
    return spark.range(n).selectExpr(
        "concat('K', lpad(id, 4, '0')) AS id",
        "CASE WHEN id % 50 = 7 THEN NULL WHEN id % 50 = 8 THEN '' WHEN id % 50 = 9 THEN 'x' "
        "ELSE concat('Customer#', lpad(id, 6, '0')) END AS name",
        "CASE WHEN id % 4 = 0 THEN concat('Zoë.', id, '@50%_off\\\\shop') WHEN id % 97 = 5 THEN concat('\U0001f600ab', id) END AS email",
        "CAST(id AS INT) AS n")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    people = _people(spark)
    out = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), people.schema, "id", COLUMNS, segment_rows=40, block=4)
    out.add(people, ["name", "id"])
    return out


TEXTS = ["r#000123", "R#0001", "zoë", "zoë.8@", "x", "1", "59", "#0", "@50%_off", "\U0001f600ab1", "b5", "no such text", "  er#000010 ",
         "ë.1", "customer#000599", "\\sh", "q", "a\0", None, ""]


@pytest.mark.parametrize("text", TEXTS)
def test_find_equals_a_whole_scan(spark, index, text):
    t = (text or "").strip()
    people = _people(spark)
    assert rows_of(index.find(text)) == rows_of(people.filter(contains_any(COLUMNS, t)) if t else people)


@pytest.mark.parametrize("text", ["r#00012_", "zo%shop", "%", "_", "c_s%0001", "a%1", "x", "8@50\\%\\_o", "ER#%9", "r%r", "e%er"])
def test_wildcards_equal_a_whole_scan(spark, index, text):
    assert rows_of(index.find_like(text)) == rows_of(_people(spark).filter(like_any(COLUMNS, text)))


def test_runs_of_a_pattern():
    assert like_runs("Ab%c_d\\%e") == ["ab", "c", "d", "e"]
    assert like_runs("%_") == []


def test_a_rare_text_opens_its_segments_only(index):
    assert sum(map(len, index.manifest().values())) == 15
    files = index.find("customer#000123").inputFiles()
    assert len({f.split("_seg=")[1].split("/")[0] for f in files}) == 1
    assert len(index.candidates(["no such text"])) == 0
    assert len(index.candidates([])) == 15


def test_inserts_updates_and_deletes_are_followed(spark, tmp_path):
    people = _people(spark, 200)
    index = SearchIndex(spark, str(tmp_path), people.schema, "id", COLUMNS, segment_rows=40, block=4)
    assert index.manifest() == {}
    index.add(people, ["name", "id"])
    renamed = people.filter("n < 20").withColumn("name", F.concat(F.lit("Renamed "), "id"))
    new = spark.createDataFrame([("NEW1", "Customer#000003", None, 1000)], SCHEMA)
    gone = people.filter("n BETWEEN 100 AND 109").select("id")
    index.add(renamed.unionByName(new), ["name", "id"], removed=gone)
    index.add(people.filter("n = 105"), ["id"])  # comes back
    now = (people.filter("n >= 20 AND NOT (n BETWEEN 100 AND 109 AND n <> 105)").unionByName(renamed).unionByName(new))
    texts = ["renamed", "customer#00000", "#00010", "zoë", "3"]
    for text in texts:
        assert rows_of(index.find(text)) == rows_of(now.filter(contains_any(COLUMNS, text)))
    assert rows_of(index.read()) == rows_of(now)
    index.compact(["name", "id"])
    assert list(index.manifest()) == [3]
    for text in texts:
        assert rows_of(index.find(text)) == rows_of(now.filter(contains_any(COLUMNS, text)))


def test_a_generation_without_its_manifest_is_not_read(spark, tmp_path):
    people = _people(spark, 60)
    index = SearchIndex(spark, str(tmp_path), people.schema, "id", COLUMNS, segment_rows=40)
    index.add(people, ["id"])
    before = rows_of(index.read())
    people.limit(0).write.parquet(f"{tmp_path}/rows/g=1")  # a job that died
    people.select("id").write.parquet(f"{tmp_path}/changes/g=1")
    assert rows_of(index.read()) == before
    assert index.add(people.limit(0), ["id"]) == 1
    assert rows_of(index.read()) == before


def test_an_empty_index_finds_nothing(spark, tmp_path):
    empty = _people(spark, 0)
    index = SearchIndex(spark, str(tmp_path), empty.schema, "id", COLUMNS)
    index.add(empty, ["id"])
    assert index.find("abc").count() == index.find("a").count() == index.read().count() == 0


def test_postings_are_one_bounded_row_per_piece_and_segment(spark, index):
    """the rows of postings grow with the segments, not with the blocks, and no list outgrows its segment."""
    postings = spark.read.parquet(f"{index.path}/postings/g=0")
    rows = postings.collect()
    assert len({(r.gram, r.g, r.seg) for r in rows}) == len(rows)
    assert max(len(r.blocks) for r in rows) == 40 // 4 and all(len(set(r.blocks)) == len(r.blocks) for r in rows)
    held = {(r.gram, r.seg, b) for r in rows for b in r.blocks}
    for r in spark.read.option("basePath", f"{index.path}/rows/g=0").parquet(f"{index.path}/rows/g=0").collect():
        for value in (r.name, r.email):
            text = (value or "").lower() + "\0\0"
            assert {(text[i:i + 3], r._seg, r._block) for i in range(len(text) - 2)} <= held
