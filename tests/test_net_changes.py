"""Net changes of a log's interval against the diff of two whole replays."""

from __future__ import annotations

import random

import pytest

from vaultline.operators import versions as V

SCHEMA = "k string, op string, v int, change_ts timestamp_ntz, _seq long"
COLS = ["v", "last_change_ts"]


def _at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def _log(spark, rows):
    import datetime as dt
    return spark.createDataFrame([(k, op, v, None if m is None else dt.datetime.fromisoformat(_at(m)), i) for i, (k, op, v, m) in enumerate(rows)],
                                 SCHEMA)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_kinds(spark):
    log = _log(spark, [("same", "INSERT", 1, 0), ("gone", "INSERT", 1, 0), ("back", "INSERT", 1, 0),
                       ("flash", "INSERT", 5, 11), ("flash", "DELETE", None, 12), ("back", "DELETE", None, 11),
                       ("back", "INSERT", 2, 12), ("gone", "DELETE", None, 13), ("new", "INSERT", 7, 14), ("later", "INSERT", 7, 99),
                       ("timeless", "INSERT", 1, None)])
    got = {r.k: (r.change_type, r.old_v, r.new_v) for r in V.net_changes(log, "k", _at(10), _at(20), COLS).collect()}
    assert got == {"gone": ("DELETE", 1, None), "back": ("UPDATE", 1, 2), "new": ("INSERT", None, 7)}
    assert V.net_changes(log.limit(0), "k", _at(10), _at(20), COLS).count() == 0


def test_equals_the_diff_of_two_replays(spark):
    rnd = random.Random(5)
    rows = [(f"k{rnd.randrange(40)}", rnd.choice(["INSERT", "UPDATE", "DELETE"]), rnd.choice([None, 1, 2]), rnd.randrange(300)) for _ in range(600)]
    log = _log(spark, rows).cache()
    for after, upto in ((0, 299), (100, 110), (299, 300)):
        old, new = (V.table_as_of(log, "k", _at(m)) for m in (after, upto))
        assert _rows(V.net_changes(log, "k", _at(after), _at(upto), COLS)) == _rows(V.cdc_changes(old, new, "k", COLS))


def test_position_moves_on_commit_only(spark, tmp_path):
    log = _log(spark, [("a", "INSERT", 1, 1), ("a", "UPDATE", 2, 5), ("b", "INSERT", 3, 6)])
    reader = V.ChangeReader(spark, str(tmp_path / "position"), "k", ["v"])
    first = _rows(reader.read(log, _at(4)))
    assert len(first) == 1 and _rows(reader.read(log, _at(4))) == first
    reader.commit(_at(4))
    again = V.ChangeReader(spark, str(tmp_path / "position"), "k", ["v"])
    assert {(r.k, r.change_type) for r in again.read(log, _at(9)).collect()} == {("a", "UPDATE"), ("b", "INSERT")}
    with pytest.raises(ValueError):
        again.commit(_at(3))
