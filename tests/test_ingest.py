"""COPY INTO: columns by name, skipped lines, late foreign keys, append and log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultline.sources import ingest as I

TARGET = "a int, b string"


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], TARGET).schema


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def _load(spark, schema, root, sources, **kw):
    rows, log = I.load_files(spark, sources, schema, str(root), now="2024-01-01 00:00:00", **kw)
    return sorted(tuple(r) for r in rows.collect()), {r.file_name: r for r in log.collect()}


def test_csv_columns_go_by_name_and_files_are_logged_one_by_one(spark, schema, tmp_path):
    src = tmp_path / "in"
    _write(src, "1.csv", "a,b\n1,x\nbad,y\n")
    _write(src, "2.csv", "b,a\nz,2\n")
    _write(src, "3.csv", "A,B,c\n3,w,1\n")
    _write(src, "4.csv", "a\n4\n")
    _write(src, "5.csv", "")
    rows, log = _load(spark, schema, tmp_path, [(str(src), "csv")])
    assert rows == [(1, "x"), (2, "z")]
    assert (log["in/1.csv"].rows_loaded, log["in/1.csv"].errors, log["in/1.csv"].status) == (1, 1, "LOADED")
    assert log["in/2.csv"].rows_loaded == 1
    assert log["in/3.csv"].status == "FAILED" and log["in/3.csv"].message == "field c not found in destination"
    assert log["in/4.csv"].message == "field b missing in file"
    assert log["in/5.csv"].status == "FAILED" and len(log) == 5


def test_skip_header(spark, schema, tmp_path):
    title = _write(tmp_path / "t", "t.csv", "My title\nb,a\nx,1\ny,bad\n")
    rows, log = _load(spark, schema, tmp_path, [(title, "CSV")], skip_header=2)
    assert rows == [(1, "x")] and log["t/t.csv"].errors == 1
    bare = _write(tmp_path / "n", "n.csv", "1,x\n2,y\n")
    assert _load(spark, schema, tmp_path, [(bare, "CSV")], skip_header=0)[0] == [(1, "x"), (2, "y")]


def test_lines_are_skipped_by_place_not_by_text(spark, schema, tmp_path):
    """Data rows that equal the title or the header stay; files of many splits skip at their start only."""
    body = "".join(f"{i},v{i}\n" for i in range(3000))
    src = tmp_path / "p"
    _write(src, "1.csv", "1,one\na,b\n1,one\n2,two\n1,one\n")
    _write(src, "2.csv", "1,one\na,b\n" + body + "a,b\n1,one\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows, log = _load(spark, schema, tmp_path, [(str(src), "CSV")], skip_header=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == sorted([(1, "one"), (2, "two"), (1, "one"), (1, "one")] + [(i, f"v{i}") for i in range(3000)])
    assert (log["p/1.csv"].rows_loaded, log["p/2.csv"].rows_loaded, log["p/2.csv"].errors) == (3, 3001, 1)


def test_a_foreign_json_key_in_a_late_row_refuses_the_file(spark, schema, tmp_path):
    lines = [f'{{"a": {i}, "b": "x"}}' for i in range(3000)]
    good = _write(tmp_path / "g", "g.json", "\n".join(lines) + "\nnot json\n")
    bad = _write(tmp_path / "b", "b.json", "\n".join([*lines, '{"a": 1, "B": "x", "c": 2}']))
    rows, log = _load(spark, schema, tmp_path, [(good, "JSON"), (bad, "JSON")])
    assert len(rows) == 3000 and log["g/g.json"].errors == 1
    assert log["b/b.json"].status == "FAILED" and log["b/b.json"].message == "field c not found in destination"


def test_parquet_columns_and_unknown_format(spark, schema, tmp_path):
    p, q = str(tmp_path / "p"), str(tmp_path / "q")
    spark.createDataFrame([("x", 1)], "b string, a int").coalesce(1).write.parquet(p)
    spark.createDataFrame([(1, 2)], "a int, c int").coalesce(1).write.parquet(q)
    rows, log = _load(spark, schema, tmp_path, [(p, "PARQUET"), (q, "PARQUET")])
    assert rows == [(1, "x")] and sorted(r.status for r in log.values()) == ["FAILED", "LOADED"]
    with pytest.raises(ValueError):
        I.load_files(spark, [(p, "XML")], schema, str(tmp_path))


def test_copy_appends_rows_and_log(spark, schema, tmp_path):
    src = _write(tmp_path / "in", "1.csv", "a,b\n1,x\n")
    table, history = str(tmp_path / "table"), str(tmp_path / "history")
    for n in (1, 2):
        rows, log = I.copy_into(spark, [(src, "CSV")], schema, str(tmp_path), table, history, force=True)
        assert rows.count() == n and log.count() == n


def test_a_file_is_loaded_once(spark, schema, tmp_path):
    src = _write(tmp_path / "in", "1.csv", "a,b\n1,x\n")
    table, history = str(tmp_path / "table"), str(tmp_path / "history")

    def load():
        rows, log = I.copy_into(spark, [(src, "CSV")], schema, str(tmp_path), table, history)
        return sorted(tuple(r) for r in rows.collect()), log.count()
    assert load() == ([(1, "x")], 1)
    assert load() == ([(1, "x")], 1)
    _write(tmp_path / "in", "2.csv", "a,b\n2,y\n")
    spark.createDataFrame([(9, "lost")], TARGET).write.parquet(f"{table}/load=died")  # died before its log
    assert load() == ([(1, "x"), (2, "y")], 2)
    _write(tmp_path / "in", "1.csv", "a,b\n1,changed\n")  # another length
    assert load() == ([(1, "changed"), (1, "x"), (2, "y")], 3)


def test_quoted_fields_that_span_lines(spark, schema, tmp_path):
    src = _write(tmp_path / "in", "1.csv", 'a,b\n1,"two\nlines"\n2,"one, ""line"""\n')
    _write(tmp_path / "in", "2.csv", 'a,b\n3,"x\\"y"\n')
    rows, log = _load(spark, schema, tmp_path, [(src, "CSV")])
    assert rows == [(3, 'x"y')] and log["in/1.csv"].message == I.SPANS
    rows, log = _load(spark, schema, tmp_path, [(src, "CSV")], multi_line=True)
    assert (1, "two\nlines") in rows and log["in/1.csv"].rows_loaded == 2
    with pytest.raises(ValueError):
        _load(spark, schema, tmp_path, [(src, "CSV")], multi_line=True, skip_header=2)


def test_camel_case():
    from vaultline.sources import sinks as SK
    assert SK.camel_case("TRANSACTION_ID") == "transactionId"
    assert SK.camel_case("customer name") == "customerName"
    assert SK.camel_case("amount") == "amount"


def test_footers_of_equal_files_are_read_together(spark, tmp_path, monkeypatch):
    """one look for any number of fine files; foreign columns and types that do not merge are found by halving."""
    target = T.StructType.fromDDL("id bigint, name string")
    spark.range(0, 40, 1, 40).select("id", F.lit("x").alias("name")).write.parquet(f"{tmp_path}/fine")
    looks = []
    monkeypatch.setattr(I, "schema_issue", lambda *a, real=I.schema_issue, **k: looks.append(a) or real(*a, **k))
    fine = [f for f, _ in I.list_files(spark, f"{tmp_path}/fine")]
    assert len(fine) == 40
    assert I._footer_issues(spark, fine, target) == dict.fromkeys(fine) and len(looks) == 1
    spark.range(2).select("id", F.lit("n").alias("nick")).coalesce(1).write.parquet(f"{tmp_path}/foreign")
    spark.range(2).select(F.lit("n").alias("id"), F.lit("x").alias("NAME")).coalesce(1).write.parquet(f"{tmp_path}/text")
    foreign, text = ([f for f, _ in I.list_files(spark, f"{tmp_path}/{x}")] for x in ("foreign", "text"))
    assert len(foreign) == len(text) == 1
    found = I._footer_issues(spark, fine[:20] + foreign + fine[20:] + text, target)
    assert found == dict.fromkeys(fine + text) | {foreign[0]: "field nick not found in destination"}
    assert I._footer_issues(spark, [], target) == {}
