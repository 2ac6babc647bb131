"""Streaming jobs: keyed sink idempotency, multi-batch results equal the
batch form, and the high-risk dynamic table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vaultline.operators.joins import account_branch_map
from vaultline.operators.metrics import daily_branch_volume
from vaultline.sources.tables import event_transactions
from vaultline.streaming import jobs as J

from .conftest import SF_SMALL


def test_keyed_sink_replay_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = J.keyed_sink(path)
    b0 = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    b1 = spark.createDataFrame([("a", 5)], "k string, v int")
    write(b0, 0)
    write(b1, 1)
    write(b1, 1)  # the same batch again after a failure
    got = {r.k: r.v for r in J.read_latest(spark, path, ["k"], b0.schema).collect()}
    assert got == {"a": 5, "b": 2}
    assert spark.read.parquet(path).count() == 3


def _split_events(spark, tmp_path):
    """The events file as two files (by time), so the stream sees two batches."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = tmp_path / "in"
    os.makedirs(src)
    cut = "2024-01-15"
    for i, part in enumerate((ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut))):
        d = tmp_path / f"p{i}"
        part.coalesce(1).write.parquet(str(d))
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(d / f, src / f"events-{i}.parquet")
    return str(src)


def test_live_daily_branch_two_batches_equals_batch(spark, bank, tmp_path):
    src = _split_events(spark, tmp_path)
    stream = spark.readStream.schema(J.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    ab = account_branch_map(bank.accounts, bank.customers)
    out = J.live_daily_branch(spark, stream, ab, path=str(tmp_path / "sink"))
    tx = event_transactions(spark.read.parquet(src))
    want = daily_branch_volume(bank, tx)
    cols = ["transaction_date", "branch_name", "daily_count", "daily_amount"]
    assert sorted(out.select(*cols).collect()) == sorted(want.select(*cols).collect())
    # two micro-batches really ran
    assert spark.read.parquet(str(tmp_path / "sink" / "data")).select("_batch").distinct().count() == 2


def _reverse_files(spark, tmp_path, n=4):
    """The events as ``n`` files that arrive newest first."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = str(tmp_path / "rev")
    os.makedirs(src)
    order = [r.event_id for r in ev.orderBy("ts", "event_id").collect()]
    for i in range(n):
        chosen = order[len(order) * (n - 1 - i) // n: len(order) * (n - i) // n]
        d = tmp_path / f"r{i}"
        ev.filter(F.col("event_id").isin(chosen)).coalesce(1).write.parquet(str(d))
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(d / f, f"{src}/events-{i}.parquet")
        os.utime(f"{src}/events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(J.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_rollups_are_exact_for_files_in_reverse_time_order(spark, bank, tmp_path):
    from vaultline.operators import fraud as FR

    ab = account_branch_map(bank.accounts, bank.customers)
    tx = event_transactions(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    stream = _reverse_files(spark, tmp_path)
    cols = ["transaction_date", "branch_name", "daily_count", "daily_amount"]
    daily = J.live_daily_branch(spark, stream, ab, path=str(tmp_path / "d"))
    assert sorted(daily.select(*cols).collect()) == sorted(daily_branch_volume(bank, tx).select(*cols).collect())
    assert spark.read.parquet(str(tmp_path / "d" / "data")).select("_batch").distinct().count() == 4
    hourly = J.hourly_consolidate(spark, stream, ab, path=str(tmp_path / "h"))
    assert hourly.agg(F.sum("transaction_count")).first()[0] == daily.agg(F.sum("daily_count")).first()[0]
    fast = J.fraud_velocity_stream(spark, stream, path=str(tmp_path / "v"))
    want = FR.fraud_velocity(tx)
    assert sorted(fast.select(*want.columns).collect()) == sorted(want.collect())


def test_second_hour_reads_the_snapshot_and_new_batches_only(spark, bank, tmp_path):
    from vaultline.sources.batches import account_changes_from

    root, ev = str(tmp_path / "hourly"), spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ab, src = account_branch_map(bank.accounts, bank.customers), str(tmp_path / "in")
    os.makedirs(src)
    for hour, part in enumerate([ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")]):
        d = tmp_path / f"p{hour}"
        part.coalesce(1).write.parquet(str(d))
        os.link(d / [x for x in os.listdir(d) if x.endswith(".parquet")][0], f"{src}/events-{hour}.parquet")
        log = account_changes_from(spark.readStream.schema(J.EVENTS_SCHEMA).parquet(src))
        out = sorted(J.hourly_deposits(spark, log, ab, "account_number", f"2024-01-30 0{hour}:00:00", root).collect())
        if hour == 0:  # what the first hour consumed is in the snapshot: its batch may go
            J._drop_folder(spark, f"{root}/changes/data/_batch=0")
    log = account_changes_from(J.event_stream(spark, SF_SMALL))
    want = sorted(J.hourly_deposits(spark, log, ab, "account_number", "2024-01-30 01:00:00", str(tmp_path / "one")).collect())
    assert out == want and J._versions(spark, f"{root}/state") == [0, 1]


def test_high_risk_stream(spark, bank, tmp_path):
    out = J.high_risk_stream(spark, J.event_stream(spark, SF_SMALL), bank.customers, 80, path=str(tmp_path / "hr"))
    assert out.columns == ["transaction_id", "customer_name", "amount", "risk_score"]
    assert out.filter(F.col("risk_score") <= 80).count() == 0
    assert out.count() == bank.fraud_alerts.filter(F.col("risk_score") > 80).count()


def test_cdc_stream_reads_only_new_changes(spark, bank, tmp_path):
    """Two runs of the change consumer on one checkpoint: the second run
    reads only the file that arrived after the first."""
    from vaultline.operators.versions import table_as_of
    from vaultline.sources.batches import account_changes_from

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = tmp_path / "in"
    os.makedirs(src)
    parts = [ev.filter(F.col("ts") < "2024-01-15"), ev.filter(F.col("ts") >= "2024-01-15")]
    sink = str(tmp_path / "cdc")
    for i, part in enumerate(parts):
        d = tmp_path / f"p{i}"
        part.coalesce(1).write.parquet(str(d))
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(d / f, src / f"events-{i}.parquet")
        log = account_changes_from(spark.readStream.schema(J.EVENTS_SCHEMA).parquet(str(src)))
        data = J.run_cdc(spark, log, "t_cdc", "account_number", path=sink)
    stored = spark.read.parquet(data)
    assert stored.select("_batch").distinct().count() == 2
    # every stored row of the second run comes from the second file
    second = stored.filter(F.col("_batch") == 1)
    assert second.filter(F.col("change_ts") < "2024-01-15").count() == 0
    got = table_as_of(stored.drop("_batch"), "account_number", "9999-12-31 00:00:00")
    want = table_as_of(account_changes_from(ev), "account_number", "9999-12-31 00:00:00")
    assert sorted(got.collect()) == sorted(want.collect())


def test_hourly_deposits_rerun_is_idempotent(spark, bank, tmp_path):
    from vaultline.sources.batches import account_changes_from

    ab = account_branch_map(bank.accounts, bank.customers)
    root = str(tmp_path / "hourly")

    def run(hour):
        log = account_changes_from(J.event_stream(spark, SF_SMALL))
        return J.hourly_deposits(spark, log, ab, "account_number", hour, root)

    first = sorted(run("2024-01-30 00:00:00").collect())
    again = sorted(run("2024-01-30 00:00:00").collect())  # same hour re-run: replaced, not repeated
    assert first == again and len(first) > 0
    run("2024-01-30 01:00:00")
    table = spark.read.parquet(f"{root}/rollup")
    assert table.select("run_hour").distinct().count() == 2
    assert table.count() == 2 * len(first)


def test_dynamic_table_runs_on_a_processing_time_trigger(spark, bank, tmp_path):
    s = J.high_risk_alerts_stream(J.event_stream(spark, SF_SMALL), 80)
    q = J.start_stream(spark, s, "t_dyn", path=str(tmp_path / "dyn"), trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.parquet(str(tmp_path / "dyn" / "data"))
    assert out.count() == bank.fraud_alerts.filter(F.col("risk_score") > 80).count()


def test_stream_windows_follow_the_event_clock_in_any_session_time_zone(spark, bank, tmp_path):
    ab = account_branch_map(bank.accounts, bank.customers)
    want = sorted(daily_branch_volume(bank, event_transactions(spark.read.parquet(f"{SF_SMALL}/events.parquet")))
                  .select("transaction_date", "branch_name", "daily_count", "daily_amount").collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        out = J.live_daily_branch(spark, J.event_stream(spark, SF_SMALL), ab, path=str(tmp_path / "tz"))
        got = sorted(out.select("transaction_date", "branch_name", "daily_count", "daily_amount").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == want
