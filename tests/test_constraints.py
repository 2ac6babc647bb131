"""Maintained constraint reports equal the reports over whole tables after every batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vaultline.operators import changes as C
from vaultline.operators.constraints import CHECKS, ConstraintState, images
from vaultline.sources import schemas

TABLES = list(schemas.PRIMARY_KEYS)


def _full(tables):
    """The reports of whole tables in the maintained report's shape."""
    keys = C.key_constraints_report(tables).select("table_name", "check_kind", "column", F.lit(None).cast("string").alias("parent_table"), "violations")
    orphans = C.orphan_report(tables).select(F.col("child_table").alias("table_name"), F.lit("foreign_key").alias("check_kind"), "column",
                                             "parent_table", F.col("orphans").alias("violations"))
    return sorted(map(repr, keys.unionByName(orphans).collect()))


def _kept(state):
    return sorted(map(repr, state.report().collect()))


@pytest.fixture
def tables(spark, bank):
    """A small cut of every table, so that parents are missing."""
    return {t: spark.createDataFrame(bank.table(t).orderBy(k).limit(40).collect(), bank.table(t).schema) for t, k in schemas.PRIMARY_KEYS.items()}


def test_equals_whole_reports_after_every_batch(spark, tables, tmp_path):
    state = ConstraintState(spark, str(tmp_path), parts=8)
    state.apply({t: images(df) for t, df in tables.items()}, 0)
    assert _kept(state) == _full(tables)
    assert len(_kept(state)) == len(CHECKS)
    # a parent goes, a key comes twice, a null key and a null amount come
    c = tables["customers"]
    gone = c.orderBy("customer_id").limit(3)
    twice = c.orderBy(F.col("customer_id").desc()).limit(2)
    t = tables["transactions"]
    odd = spark.createDataFrame(t.limit(2).withColumn("transaction_id", F.lit(None).cast("string")).withColumn(
        "amount", F.lit(None).cast("decimal(15,2)")).collect(), _nullable(t.schema))
    batch = {"customers": images(gone, -1).unionByName(images(twice)), "transactions": images(odd)}
    state.apply(batch, 1)
    now = {**tables, "customers": c.join(gone.select("customer_id"), "customer_id", "left_anti").unionByName(twice),
           "transactions": t.unionByName(odd)}
    assert _kept(state) == _full(now) != _full(tables)
    state.apply(batch, 1)  # replayed
    assert _kept(state) == _full(now)
    state.apply({"customers": images(gone).unionByName(images(twice, -1)), "transactions": images(odd, -1)}, 2)
    assert _kept(state) == _full(tables)
    assert state.fold(1) and _kept(state) == _full(tables)
    state.apply({"customers": images(gone, -1)}, 3)
    assert _kept(state) == _full({**tables, "customers": c.join(gone.select("customer_id"), "customer_id", "left_anti")})


def _nullable(schema):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def test_a_small_batch_reads_its_parts_only(spark, tables, tmp_path, monkeypatch):
    state = ConstraintState(spark, str(tmp_path), parts=64)
    state.apply({t: images(df) for t, df in tables.items()}, 0)
    asked = []
    read = state.counts.read
    monkeypatch.setattr(state.counts, "read", lambda before=None, parts=None: asked.append(parts) or read(before, parts))
    state.apply({"accounts": images(tables["accounts"].limit(2))}, 1)
    assert len(asked) == 1 and 0 < len(asked[0]) <= 2 * 3  # its own key, its customer, its transactions


def test_missing_parents_and_violating_keys(spark, tables, tmp_path):
    state = ConstraintState(spark, str(tmp_path), parts=8)
    state.apply({t: images(df) for t, df in tables.items()}, 0)
    check = next(c for c in CHECKS if c.kind == "foreign_key" and c.table == "accounts")
    known = tables["customers"].first().customer_id
    batch = spark.createDataFrame([("A1", known), ("A2", "nobody"), ("A3", None), ("A4", "nobody")], "account_number string, customer_id string")
    assert sorted(r.account_number for r in state.missing_parents(check, batch).collect()) == ["A2", "A4"]
    orphans = tables["accounts"].join(tables["customers"], "customer_id", "left_anti").filter("customer_id IS NOT NULL")
    assert {(r.key, r.violations) for r in state.violating_keys(check).collect()} == {
        (r.customer_id, r["count"]) for r in orphans.groupBy("customer_id").count().collect()}


def test_empty_tables_have_no_violations(spark, tables, tmp_path):
    state = ConstraintState(spark, str(tmp_path), parts=4)
    state.apply({t: images(df.limit(0)) for t, df in tables.items()}, 0)
    assert {r.violations for r in state.report().collect()} == {0}
