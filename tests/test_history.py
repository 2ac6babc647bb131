"""Versions from snapshots equal a replay of the whole log, also with late changes and after expiry."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from vaultline.operators import versions as V
from vaultline.sources.history import History

SCHEMA = "k string, op string, v int, change_ts timestamp_ntz, _seq long"
START = dt.datetime(2024, 1, 1)


def _at(hour):
    return (START + dt.timedelta(hours=hour)).isoformat(sep=" ")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def _changes(rnd, n, first, last, seq):
    return [(rnd.choice([None, "a", "b", "c", "d", "e", "f", "g"]), rnd.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), rnd.choice([None, 1, 2]),
             rnd.choice([None] + [START + dt.timedelta(hours=rnd.uniform(first, last))] * 15), seq + i) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    return History(spark, str(tmp_path), empty.schema, "k")


def _check(spark, store, log, hours):
    whole = spark.createDataFrame(log, SCHEMA)
    for hour in hours:
        assert rows_of(store.as_of(_at(hour))) == rows_of(V.table_as_of(whole, "k", _at(hour))), hour


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_replay_with_late_appends(spark, store, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr("vaultline.sources.history.BROADCAST_MAX_KEYS", 0)
    rnd, log = random.Random(seed), []
    for step, (first, last, snap) in enumerate([(0, 100, 50), (40, 200, 150), (0, 250, 100), (200, 300, 260)]):
        part = _changes(rnd, 40, first, last, 1000 * step)
        log += part
        store.append(spark.createDataFrame(part, SCHEMA))
        store.snapshot(_at(snap))
    _check(spark, store, log, [-1, 30, 50, 99, 150, 170, 260, 400])


def test_an_old_change_that_comes_late_does_not_bring_a_deleted_key_back(spark, store):
    first = [("a", "INSERT", 1, START, 1), ("a", "DELETE", None, START + dt.timedelta(hours=5), 2)]
    store.append(spark.createDataFrame(first, SCHEMA))
    store.snapshot(_at(10))
    late = [("a", "UPDATE", 7, START + dt.timedelta(hours=3), 3), ("b", "INSERT", 2, START + dt.timedelta(hours=3), 4)]
    store.append(spark.createDataFrame(late, SCHEMA))
    _check(spark, store, first + late, [2, 4, 12])
    assert [r.k for r in store.as_of(_at(12)).collect()] == ["b"]


def test_reads_one_snapshot_and_the_later_days(spark, store):
    rnd = random.Random(3)
    store.append(spark.createDataFrame(_changes(rnd, 200, 0, 480, 0), SCHEMA))
    store.snapshot(_at(24 * 5))
    store.snapshot(_at(24 * 10 + 6))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # filters whole, not cut for display
    version = store.as_of(_at(24 * 12))
    files = version.inputFiles()
    assert {f.split("/snapshots/")[1].split("/")[0] for f in files if "/snapshots/" in f} == {"n=1"}
    plan = version._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("2024-01-11" in f and "2024-01-13" in f for f in filters)


def test_expiry_keeps_every_time_within_the_retention(spark, store, tmp_path):
    rnd, log = random.Random(4), []
    for step, snap in enumerate([24, 24 * 12]):  # the second one is made before the late append
        part = _changes(rnd, 60, 0, 24 * 20, 1000 * step)
        log += part
        store.append(spark.createDataFrame(part, SCHEMA))
        store.snapshot(_at(snap))
    part = _changes(rnd, 30, 0, 24 * 20, 5000)
    log += part
    store.append(spark.createDataFrame(part, SCHEMA))
    store.snapshot(_at(24 * 5))  # earlier in time, made later
    assert store.expire(_at(24 * 3), 14) == 0 and store.floor() is None
    assert store.expire(_at(24 * 20), 14) > 0  # bound: day 6
    assert store.floor()[:10] == "2024-01-06"
    with pytest.raises(ValueError, match="oldest version"):
        store.as_of(_at(24 * 4))
    _check(spark, store, log, [24 * 5, 24 * 6 + 1, 24 * 12, 24 * 13, 24 * 19])
    days = {p.name for g in (0, 1) for p in (tmp_path / f"log/g={g}").glob("_day=2024-01-0[1-5]")}
    assert not [d for d in days if (tmp_path / "log/g=0" / d).exists()]
    assert list((tmp_path / "log/g=2").glob("_day=2024-01-0[1-5]"))  # still late to a snapshot
    store.snapshot(_at(24 * 16))
    _check(spark, store, log, [24 * 12, 24 * 17])


def test_empty_history(spark, store):
    assert store.as_of(_at(0)).count() == 0
    store.snapshot(_at(0))
    assert store.as_of(_at(5)).count() == 0
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.as_of(_at(5)).count() == 0
