"""Property: the segmented 'previous event within m minutes' equals brute
force for any events, window width and key skew."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from vaultline.operators import fraud as FR

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("transaction_id string, account_number string, amount decimal(15,2), transaction_type string, "
          "merchant_name string, location string, timestamp timestamp_ntz")

events = st.lists(
    st.tuples(st.sampled_from(["ACC1", "ACC1", "ACC1", "ACC2", "ACC3"]),   # one account dominates
              st.integers(min_value=0, max_value=6 * 3600),                  # seconds after T0
              st.integers(min_value=0, max_value=999),                       # sub-second part (ms)
              st.sampled_from(["City 0", "City 1"])),
    min_size=1, max_size=60)


def _brute(rows, minutes):
    width = minutes * 60
    out = {}
    last = {}
    for tid, acc, ts, loc in sorted(rows, key=lambda r: (r[2], r[0])):
        p = last.get(acc)
        if p is not None:
            gap = int((ts - T0).total_seconds()) - int((p[2] - T0).total_seconds())
            if gap <= width and p[3] != loc:
                out[tid] = (p[0], gap)
        last[acc] = (tid, acc, ts, loc)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ev=events, minutes=st.sampled_from([1, 7, 60]))
def test_geographic_equals_brute_force(spark, ev, minutes):
    rows = [(f"TX{i:03d}", acc, T0 + dt.timedelta(seconds=s, milliseconds=ms), loc)
            for i, (acc, s, ms, loc) in enumerate(ev)]
    df = spark.createDataFrame([(t, a, None, "X", "M", loc, ts) for t, a, ts, loc in rows], SCHEMA)
    got = {r.transaction_id: (r.previous_transaction_id, r.gap_seconds)
           for r in FR.fraud_geographic(df, minutes).collect()}
    assert got == _brute(rows, minutes)


def _alerts(p):
    hit = p.filter(F.col("prev_location").isNotNull() & (F.col("location") != F.col("prev_location")))
    return {r.transaction_id: (r.prev_transaction_id, r.gap_seconds) for r in hit.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ev=events, minutes=st.sampled_from([1, 60]), budget=st.sampled_from([2, 7, 1000]))
def test_segments_equal_brute_force(spark, ev, minutes, budget):
    rows = [(f"TX{i:03d}", acc, T0 + dt.timedelta(seconds=s, milliseconds=ms), loc)
            for i, (acc, s, ms, loc) in enumerate(ev)]
    df = spark.createDataFrame([(t, a, None, "X", "M", loc, ts) for t, a, ts, loc in rows], SCHEMA)
    p = FR.previous_within(df, ["account_number"], minutes, ["location", "transaction_id"], rows_per_group=budget)
    assert _alerts(p) == _brute(rows, minutes)


def _burst(n=3000):
    """One row five years earlier, then everything within an hour on one account."""
    rows = [("TX-old", "HOT", T0 - dt.timedelta(days=5 * 365), "City 9")]
    return rows + [(f"TX{i:04d}", "HOT" if i % 10 else f"ACC{i}", T0 + dt.timedelta(milliseconds=1200 * i), f"City {i % 3}")
                   for i in range(n)]


def test_a_burst_after_one_old_row_is_cut_by_row_count(spark):
    rows, budget = _burst(), 100
    df = spark.createDataFrame([(t, a, None, "X", None if i % 2 else "M", loc, ts)
                                for i, (t, a, ts, loc) in enumerate(rows)], SCHEMA)
    p = FR.previous_within(df, ["account_number"], 1, ["location", "transaction_id"], rows_per_group=budget)
    got = _alerts(p)
    assert got == _brute(rows, 1) and len(got) > 2000
    base = df.withColumn("_us", F.timestamp_diff("MICROSECOND", F.lit(FR.EPOCH).cast("timestamp_ntz"), F.col("timestamp")))
    cuts = FR._hot_cuts(base, "account_number", budget)
    sized = (base.join(cuts, base.account_number == cuts._hot).withColumn(
        "seg", F.size(F.filter("_cuts", lambda c: c < F.col("_us")))).groupBy("_hot", "seg").count())
    assert sized.agg(F.max("count")).first()[0] <= budget and sized.count() >= 27
    # a key with a NULL part agrees with the plan without hot accounts
    k, cols = ["account_number", "merchant_name"], ["transaction_id", "prev_transaction_id", "gap_seconds"]
    a = FR.previous_within(df, k, 1, ["transaction_id"], rows_per_group=50)
    b = FR.previous_within(df, k, 1, ["transaction_id"])
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())


def test_ordinary_accounts_need_one_exchange(spark):
    df = spark.createDataFrame([(t, a, None, "X", "M", loc, ts) for t, a, ts, loc in _burst(50)], SCHEMA)
    plan = FR.fraud_geographic(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
