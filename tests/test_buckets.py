"""Bulk changes on bucketed tables: same rows as on whole tables, few buckets read and written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vaultline.operators import changes as C
from vaultline.operators import stored_changes as SC
from vaultline.sources.buckets import BucketTable


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def tables(spark, bank, tmp_path):
    out = {}
    for name in ("transactions", "accounts", "customers"):
        out[name] = BucketTable(spark, str(tmp_path / name), name, buckets=32)
        out[name].replace(bank.table(name))
    return out


def _changes(spark, bank, n):
    tx = bank.transactions.orderBy("transaction_id").limit(n)
    known = tx.select("transaction_id", "account_number", F.lit("FEE").alias("transaction_type"), F.lit("5").alias("amount"),
                      F.lit(1).alias("_seq"))
    odd = spark.createDataFrame([("TXnone", "ACC1", "FEE", "1", 2), (None, "ACC1", "FEE", "1", 3)], known.schema)
    foreign = known.limit(1).withColumn("account_number", F.lit("nobody")).withColumn("_seq", F.lit(9))
    out = known.unionByName(odd).unionByName(foreign)
    for c in ("currency", "merchant_name", "location", "risk_factor", "status"):
        out = out.withColumn(c, F.lit(None).cast("string"))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_a_batch_reads_and_writes_its_buckets_only(spark, bank, tables, few, monkeypatch):
    if not few:
        monkeypatch.setattr(SC, "BROADCAST_MAX_KEYS", 0)
    batch, tx = _changes(spark, bank, 10), tables["transactions"]
    whole = C.update_transactions(bank.transactions, batch, bank.accounts)
    before = tx.manifest()
    got = SC.apply(tx, batch, "transaction_id", C.update_transactions, [(tables["accounts"], "account_number")])
    rewritten = {x for x, v in tx.manifest().items() if v == 1}
    named = {r[0] for r in batch.select(tx.bucket_of(F.col("transaction_id"))).distinct().collect()}
    assert rewritten <= named and len(named) <= 12 < len(before) == 32
    assert set(tx.manifest()) == set(before)
    opened = got.rejects.inputFiles()
    assert {f.split("_bucket=")[1].split("/")[0] for f in opened if "/transactions/" in f and "_bucket=" in f} <= {str(x) for x in named}
    assert rows_of(got.next) == rows_of(whole.next)
    assert rows_of(got.rejects) == rows_of(whole.rejects)
    assert rows_of(got.accepted) == rows_of(whole.accepted)
    assert rows_of(tx.read(version=0)) == rows_of(C._conform(bank.transactions, "transactions"))


def test_insert_twice_adds_once_and_empty_batches_commit_nothing(spark, bank, tables):
    accounts, batch = tables["accounts"], spark.createDataFrame(
        [("N1", "CUS1", "SAVINGS", "1", None), ("N1", "CUS1", "SAVINGS", "1", None), ("N2", "nobody", "SAVINGS", "1", None)],
        "account_number string, customer_id string, account_type string, balance string, status string")
    n = accounts.read().count()
    for rejects in (2, 3):
        got = SC.apply(accounts, batch, "account_number", C.insert_accounts, [(tables["customers"], "customer_id")])
        assert got.next.count() == n + 1 and got.rejects.count() == rejects
    version = accounts.version()
    got = SC.apply(accounts, batch.limit(0), "account_number", C.insert_accounts, [(tables["customers"], "customer_id")])
    assert got.next.count() == n + 1 and got.rejects.count() == 0 and accounts.version() == version


def test_unfinished_version_is_not_read_and_vacuum_keeps_what_is(spark, bank, tables):
    customers = tables["customers"]
    rows = customers.read()
    n, b = rows.count(), customers.bucket_of(F.col("customer_id"))
    some = sorted(customers.manifest())[:3]
    rows.limit(0).write.parquet(f"{customers.path}/data/v=1")  # a job that died before its manifest
    assert customers.version() == 0 and customers.read().count() == n
    left = rows.filter(b.isin(some[1:])).withColumn("risk_score", F.lit(1))
    assert customers.replace(left, some) == 1  # the first bucket becomes empty
    assert some[0] not in customers.manifest()
    now = rows_of(customers.read())
    assert len(now) == rows.filter(b != some[0]).count()
    with pytest.raises(ValueError):
        customers.replace(left, some[:1])
    assert customers.version() == 1
    assert customers.vacuum(keep=1) == 3 and rows_of(customers.read()) == now


def test_empty_table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "records", buckets=4)
    assert t.version() == -1 and t.read().count() == 0
    batch = spark.createDataFrame([("r1", "n", "e", None), ("r2", None, "e", "d")], "id string, name string, email string, details string")
    got = SC.apply(t, batch, "id", lambda rows, x: C.upsert_records(rows, x, "2024-01-01 00:00:00"))
    assert [r.id for r in got.next.collect()] == ["r1"] and [r.change_key for r in got.rejects.collect()] == ["r2"]
