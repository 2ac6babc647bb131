"""Fraud rules against brute force on a small fixture with a hot account,
equal timestamps and gaps exactly at the limit."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import random

import pytest
from pyspark.sql import functions as F

from vaultline.operators import fraud as FR
from vaultline.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def _fixture(seed=7, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows on one account (skew), the rest spread
        acc = "ACC1" if i % 3 == 0 else f"ACC{rnd.randint(2, 9)}"
        secs = rnd.choice([0, 60, 600, 3600, 3601, 5400]) + rnd.randint(0, 86400 * 2)
        if i % 17 == 0 and rows:  # exact same timestamp as the previous row of the list
            secs = int((rows[-1][6] - T0).total_seconds())
        amt = decimal.Decimal(rnd.choice(["10.00", "10.40", "25.50", "99.99"]))
        rows.append((f"TX{i:04d}", acc, amt, "PURCHASE", f"Merchant {rnd.randint(0, 2)}",
                     f"City {rnd.randint(0, 2)}", T0 + dt.timedelta(seconds=secs)))
    return rows


SCHEMA = ("transaction_id string, account_number string, amount decimal(15,2), transaction_type string, "
          "merchant_name string, location string, timestamp timestamp_ntz")


def _brute_previous(rows, keyf, minutes):
    out = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        k = keyf(r)
        p = by.get(k)
        if p is not None:
            gap = int((r[6] - T0).total_seconds()) - int((p[6] - T0).total_seconds())
            if gap <= minutes * 60:
                out[r[0]] = (p, gap)
        by[k] = r
    return out


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(_fixture(), SCHEMA)


def test_geographic_matches_brute_force(tx):
    rows = _fixture()
    prev = _brute_previous(rows, lambda r: r[1], 60)
    want = {(r[0], p[5], p[0], gap) for r in rows for (p, gap) in [prev.get(r[0], (None, None))]
            if p is not None and p[5] != r[5]}
    got = {(r.transaction_id, r.previous_location, r.previous_transaction_id, r.gap_seconds)
           for r in FR.fraud_geographic(tx, 60).collect()}
    assert got == want and len(want) > 0


@pytest.mark.parametrize("scale", [2, 0])
def test_duplicate_matches_brute_force(tx, scale):
    rows = _fixture()
    q = decimal.Decimal(1).scaleb(-scale)
    prev = _brute_previous(rows, lambda r: (r[1], r[2].quantize(q, rounding=decimal.ROUND_HALF_UP), r[4]), 30)
    want = {(t, p[0], gap) for t, (p, gap) in prev.items()}
    got = {(r.transaction_id, r.duplicate_of, r.gap_seconds) for r in FR.fraud_duplicate(tx, 30, scale).collect()}
    assert got == want and len(want) > 0


@pytest.mark.parametrize("window, slide", [("1 hour", "10 minutes"), ("25 minutes", "10 minutes"), ("7 days", "1 day"), ("3 days", "7 hours")])
def test_velocity_by_panes_equals_sliding_windows(tx, window, slide):
    want = tx.groupBy("account_number", F.window("timestamp", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("s")).filter("n > 1")
    want = sorted(map(repr, (tuple(r) for r in want.select("account_number", "w.start", "w.end", "n", "s").collect())))
    got = FR.fraud_velocity(tx, window, slide, 1).drop("alert_type").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == want and want


def test_velocity_matches_brute_force(tx):
    rows = _fixture()
    counts = {}
    for r in rows:
        s = int((r[6] - dt.datetime(1970, 1, 1)).total_seconds())
        first = s - s % 600
        for k in range(6):
            start = first - 600 * k
            counts[(r[1], start)] = counts.get((r[1], start), 0) + 1
    want = {(a, s, c) for (a, s), c in counts.items() if c > 2}
    got = {(r.account_number, int((r.window_start - dt.datetime(1970, 1, 1)).total_seconds()), r.tx_count)
           for r in FR.fraud_velocity(tx, "1 hour", "10 minutes", 2).collect()}
    assert got == want


def test_high_value_threshold_inclusive(tx):
    got = {r.transaction_id for r in FR.fraud_high_value(tx, 25.5).collect()}
    want = {r[0] for r in _fixture() if r[2] >= decimal.Decimal("25.5")}
    assert got == want


def _as_events(spark, rows, folder):
    """Write fixture rows in the events shape (value, props {"k": n})."""
    ev = [(int(t[0][2:]), t[6], int(t[1][3:]), "purchase", float(t[2]),
           '{"k": %d}' % (int(t[5][-1]) + 5 * int(t[4][-1]))) for t in rows]
    spark.createDataFrame(ev, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                              "value double, props string").coalesce(1).write.parquet(folder)


def _two_file_stream(spark, tmp_path):
    """Two files arriving one after the other (split on the rule's order)."""
    rows = sorted(_fixture(), key=lambda r: (r[6], r[0]))
    src = str(tmp_path / "in")
    os.makedirs(src)
    _as_events(spark, rows[:200], str(tmp_path / "part1"))
    _as_events(spark, rows[200:], str(tmp_path / "part2"))
    for i, part in enumerate(("part1", "part2")):
        f = [x for x in os.listdir(tmp_path / part) if x.endswith(".parquet")][0]
        os.link(tmp_path / part / f, f"{src}/events-{i}.parquet")
    stream = spark.readStream.schema(J.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    return src, stream


def test_geographic_stream_equals_batch_over_two_batches(spark, tmp_path):
    """The second batch finds each account's last event in the stored areas."""
    src, stream = _two_file_stream(spark, tmp_path)
    out, changes = J.fraud_geographic_stream(spark, stream, 60, path=str(tmp_path / "sink"))
    batch = FR.fraud_geographic(J.event_transactions(spark.read.parquet(src)), 60)
    cols = ["transaction_id", "previous_transaction_id", "gap_seconds"]
    assert sorted(out.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert out.count() > 0 and changes.where("_sign < 0").count() == 0  # in order, nothing is taken back


@pytest.mark.parametrize("scale", [2, 0])
def test_duplicate_stream_equals_batch_over_two_batches(spark, tmp_path, scale):
    """Several keys per account, and a rule as wide as ten hours."""
    src, stream = _two_file_stream(spark, tmp_path)
    out, _ = J.fraud_duplicate_stream(spark, stream, 600, scale, path=str(tmp_path / "sink"))
    batch = FR.fraud_duplicate(J.event_transactions(spark.read.parquet(src)), 600, scale)
    cols = ["transaction_id", "duplicate_of", "gap_seconds"]
    assert sorted(out.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert out.count() > 0


def _many_files(spark, tmp_path, groups):
    """One file for each group of rows, arriving in this order."""
    src = str(tmp_path / "many")
    os.makedirs(src)
    for i, rows in enumerate(groups):
        part = str(tmp_path / f"many{i}")
        _as_events(spark, rows, part)
        f = [x for x in os.listdir(part) if x.endswith(".parquet")][0]
        os.link(f"{part}/{f}", f"{src}/events-{i}.parquet")
        os.utime(f"{src}/events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return src, spark.readStream.schema(J.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


@pytest.mark.parametrize("order", ["random", "newest first"])
def test_previous_rules_are_exact_in_any_order_of_files(spark, tmp_path, order):
    """Six files; alerts that a later file proves wrong are taken back."""
    rows = sorted(_fixture(), key=lambda r: (r[6], r[0]))
    if order == "random":
        random.Random(1).shuffle(rows)
        groups = [rows[i::6] for i in range(6)]
    else:
        groups = [rows[i * 67: i * 67 + 67] for i in reversed(range(6))]
    src, stream = _many_files(spark, tmp_path, groups)
    tx = J.event_transactions(spark.read.parquet(src))
    out, changes = J.fraud_geographic_stream(spark, stream, 60, path=str(tmp_path / "geo"))
    want = FR.fraud_geographic(tx, 60)
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect()) and out.count() > 0
    assert changes.select("_batch").distinct().count() == 6
    if order == "newest first":  # no event comes between two known ones, so nothing is taken back
        return
    assert changes.where("_sign < 0").count() > 0
    dup, _ = J.fraud_duplicate_stream(spark, stream, 600, 2, path=str(tmp_path / "dup"))
    want = FR.fraud_duplicate(tx, 600, 2)
    assert sorted(dup.select(*want.columns).collect()) == sorted(want.collect()) and dup.count() > 0


def test_previous_rule_batch_replayed_and_bounded(spark, tmp_path):
    """A batch written again leaves the same alerts; it opens only the areas it touches and their neighbours."""
    from vaultline.streaming.previous import AREA, PreviousRule

    rows = [(f"TX{i:04d}", "ACC1", decimal.Decimal(5), "PURCHASE", "M", f"City {i % 3}", T0 + dt.timedelta(hours=6 * i)) for i in range(80)]
    tx = spark.createDataFrame(rows, SCHEMA).select("transaction_id", "timestamp", "account_number", "location")
    rule = PreviousRule(spark, str(tmp_path / "r"), FR.GEOGRAPHIC_KEYS, 600, FR.GEOGRAPHIC_CARRY, FR.geographic_alerts, tx.schema, parts=2)
    late = F.col("transaction_id").isin("TX0041", "TX0042")
    rule.write(tx.where(~late), 0)
    before = sorted(rule.current().collect())
    for _ in range(2):  # the second time after a failure
        rule.write(tx.where(late), 1)
        assert sorted(rule.current().collect()) == sorted(FR.fraud_geographic(tx, 600).collect()) != before
    seen = rule.stored(2).select(AREA).distinct().count()
    area = rule.stored(2).where("_batch = 1").select(AREA).distinct().collect()
    read = rule.stored(1, sorted({r[0] + d * 2 for r in area for d in (-1, 0, 1)}))
    assert "PartitionFilters: [isnotnull(_batch" in read._jdf.queryExecution().toString() and read.select(AREA).distinct().count() <= 4 < seen
