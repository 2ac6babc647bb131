"""Feeds of the stored transactions equal the lists and open the days they need."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vaultline.operators import feeds, lists
from vaultline.sources.stored import StoredBank, write_tables

DAYS = 25


@pytest.fixture(scope="module")
def stored(spark, bank, tmp_path_factory):
    """25 days: the last ones are sparse, one has no row, three rows have no time."""
    root = str(tmp_path_factory.mktemp("feeds"))
    write_tables(bank, root, ("accounts", "customers"))
    day = F.when(F.col("n") % 40 == 0, 20 + F.col("n") % 5).otherwise(F.col("n") % 20)
    n = F.row_number().over(Window.orderBy("transaction_id"))
    t = (bank.transactions.withColumn("n", n).filter("n <= 1000")
         .withColumn("timestamp", F.when(F.col("n") <= 3, None).otherwise(
             F.expr("timestamp_ntz '2024-03-01 00:00:00'") + F.make_dt_interval(days=F.when(day == 22, 21).otherwise(day).cast("int"),
                                                                              secs=F.col("n") % 50)))
         .withColumn("risk_factor", F.when(F.col("n") % 333 == 7, "High").otherwise("LOW"))
         .withColumn("merchant_name", F.when(F.col("n") == 500, "Needle").otherwise(F.col("merchant_name"))).drop("n"))
    feeds.write_transactions(t.filter("transaction_id < 'TX5'"), root)
    feeds.write_transactions(t.filter("transaction_id >= 'TX5'"), root, "append")
    out = StoredBank(spark, root)
    assert out.transactions.count() == 1000
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("kind, risk, k, search", [
    (None, None, 10, None), (None, None, 2, None), (None, None, 5000, None), (None, "high", 2, None), (None, " HIGH ", 50, None),
    ("deposit", "ALL", 30, None), ("no such type", None, 5, None), (None, None, 3, "needle"), (None, None, 40, "merchant 1"),
    (None, "high", 3, "tx"), (None, None, 4, "no such text"), (None, None, 4, "unknown")])
def test_feed_equals_the_list(spark, stored, kind, risk, k, search, monkeypatch):
    monkeypatch.setattr(feeds, "FIRST_ROWS", 20)
    assert rows_of(feeds.txn_enriched(stored, kind, risk, k, search)) == rows_of(lists.txn_enriched(stored, kind, risk, k, search))


def test_recent_activity_equals_the_list(stored):
    assert rows_of(feeds.recent_activity(stored)) == rows_of(lists.recent_activity(stored))


def test_only_the_days_that_are_needed_are_opened(spark, stored):
    days = feeds.day_counts(spark, stored.root)
    assert days[0] == (None, 3) and [d for d, _ in days[1:]] == sorted((d for d, _ in days[1:]), reverse=True)
    assert dt.date(2024, 3, 23) not in dict(days)
    first = feeds.steps(days, 10)[0]
    assert 1 < len(first) < 5 and sum(n for d, n in days if d in first) >= 10
    opened = {f.split(f"{feeds.DAY}=")[1].split("/")[0] for f in feeds.in_days(stored, first, feeds.folders(stored)).inputFiles()}
    assert len(opened) == len(first)
    rare = feeds.day_counts(spark, stored.root, risk="high")
    assert len(rare) <= 4 and sum(n for _, n in rare) == stored.transactions.filter("risk_factor = 'High'").count()


def test_steps_grow_and_no_day_comes_twice():
    days = [(dt.date(2024, 1, 30) - dt.timedelta(days=i), 10) for i in range(30)]
    got = feeds.steps(days, 20)
    assert [len(s) for s in got] == [2, 8, 20]
    assert [d for s in got for d in s] == [d for d, _ in days]
    assert feeds.steps([], 20) == []


def test_a_counted_day_without_rows_costs_nothing(spark, stored):
    missing = [dt.date(2030, 1, 1)]
    assert feeds.in_days(stored, missing, feeds.folders(stored)).count() == 0
