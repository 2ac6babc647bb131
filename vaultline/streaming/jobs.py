"""Structured Streaming jobs: the warehouse's stream / dynamic table / task.

Every job is ``job(stream_df, static_dfs, params) -> streaming DataFrame``;
``run_*`` helpers start it with a checkpoint under the shared checkpoint
root and wait for it, which is how the registered queries and the tests
drive them (``trigger(availableNow=True)`` = the hourly task run; a
``processingTime`` trigger = the one-minute dynamic table).

Aggregating jobs run in *update* mode into a keyed sink
(``foreachBatch``): each micro-batch's changed rows go to their own
``_batch=<id>`` folder with dynamic partition overwrite, so a replayed
batch after an executor or driver loss rewrites the same folder
(idempotent), and readers take the row of the highest batch per key. This
replaces MERGE, which plain parquet tables do not have.

Order of arrival: a table of many files arrives in order of file time, not
of event time. The rollups and the velocity rule therefore keep no stream
state and no watermark: each micro-batch writes its own partial counts and
sums, and reading adds up all batches, which is exact in any order. The
previous-event rules (``previous``) judge again what a batch can change and
write signed alerts; the views of ``views`` follow updates and deletes too.

Event times stay ``timestamp_ntz``, so windows follow the event's own clock
in any session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fraud
from ..session import scratch_path
from ..sources.tables import alerts_from_events, event_transactions
from .deltas import drop_folder as _drop_folder
from .deltas import numbered
from .previous import run_previous_rule

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


# ---------------------------------------------------------------- sources

def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet",
                 max_bytes_per_trigger: int | None = 256 * 1024 * 1024) -> DataFrame:
    """The events table as a file stream (fixed schema, no inference).

    ``name`` is a glob inside ``folder``: new files matching it are picked
    up as they land. ``max_bytes_per_trigger`` bounds a micro-batch, which
    also bounds what one key can bring to one task in a batch.
    """
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", name)
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", str(int(max_bytes_per_trigger)))
    return r.parquet(folder)


# ---------------------------------------------------------------- keyed sink

def keyed_sink(path: str):
    """``foreachBatch`` writer: the batch's rows into ``path/_batch=<id>``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(path))
    return write


def read_latest(spark: SparkSession, path: str, keys, schema: T.StructType) -> DataFrame:
    """Current table of a keyed sink: the value of the highest batch per key
    (an aggregate on the keys with a partial step in each task)."""
    values = [f.name for f in schema.fields if f.name not in keys]
    df = spark.read.schema(T.StructType(schema.fields + [T.StructField("_batch", T.LongType())])).parquet(path)
    w = df.groupBy(*keys).agg(F.max(F.struct("_batch", *values)).alias("_v"))
    return w.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def partials_sink(path: str, keys, sums):
    """``foreachBatch`` writer: the batch's sums per key into its own folder.
    A replayed batch rewrites its folder, so nothing counts twice."""
    write = keyed_sink(path)
    return lambda batch, batch_id: write(batch.groupBy(*keys).agg(*sums), batch_id)


def read_sums(spark: SparkSession, path: str, keys, sums, schema: T.StructType) -> DataFrame:
    """The rollup: ``sums`` (column names) added up over all batches."""
    df = spark.read.schema(schema).parquet(path)
    return df.groupBy(*keys).agg(*[F.sum(c).cast(schema[c].dataType).alias(c) for c in sums])


def run_partials(spark: SparkSession, rows: DataFrame, name: str, keys, sums, schema: T.StructType, trigger=None,
                 path: str | None = None) -> DataFrame:
    """Roll up ``rows`` to the end of the input; (keys, sums) over all batches."""
    out = path or scratch_path(spark, name)
    q = (rows.writeStream.option("checkpointLocation", f"{out}/_checkpoint").trigger(**(trigger or {"availableNow": True}))
         .foreachBatch(partials_sink(f"{out}/data", keys, sums)).start())
    q.awaitTermination()
    return read_sums(spark, f"{out}/data", keys, [f.name for f in schema.fields if f.name not in keys], schema)


# The dynamic table's declared lag: a long-running job's default trigger.
DYNAMIC_TABLE_TRIGGER = {"processingTime": "1 minute"}


def start_stream(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", keys=None,
                 trigger=None, path: str | None = None):
    """Start ``stream`` into ``path`` (a fresh folder under the shared
    checkpoint root by default) and return the running ``StreamingQuery``.
    Append jobs write parquet; keyed jobs write through ``keyed_sink``."""
    out = path or scratch_path(spark, name)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint")
    w = w.trigger(**(trigger or DYNAMIC_TABLE_TRIGGER)).queryName(f"{name}-{out.rsplit('-', 1)[-1]}")
    if keys:
        return w.foreachBatch(keyed_sink(f"{out}/data")).start()
    return w.format("parquet").start(f"{out}/data")


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str, keys=None, trigger=None,
         path: str | None = None) -> tuple[str, T.StructType]:
    """Run ``stream`` to the end of its input (availableNow by default) and
    wait for it. Returns (output folder, output schema)."""
    out = path or scratch_path(spark, name)
    q = start_stream(spark, stream, name, mode, keys, trigger or {"availableNow": True}, out)
    q.awaitTermination()
    return out, stream.schema


def run_append(spark: SparkSession, stream: DataFrame, name: str, **kw) -> DataFrame:
    out, schema = _run(spark, stream, name, "append", **kw)
    return spark.read.schema(schema).parquet(f"{out}/data")


def run_keyed(spark: SparkSession, stream: DataFrame, name: str, keys, **kw) -> DataFrame:
    out, schema = _run(spark, stream, name, "update", keys=keys, **kw)
    return read_latest(spark, f"{out}/data", keys, schema)


# ---------------------------------------------------------------- jobs

def high_risk_alerts_stream(events: DataFrame, threshold: int = 80) -> DataFrame:
    """Alerts with risk_score > threshold, as they arrive (keys only: the
    customer's name is joined when the table is read, not per trigger)."""
    a = alerts_from_events(events).filter(F.col("risk_score") > threshold)
    return a.select("transaction_id", "customer_id", "amount", "risk_score")


def with_customer_names(alerts: DataFrame, customers: DataFrame) -> DataFrame:
    """The dynamic table's columns: customer name by left join ('Unknown')."""
    names = customers.select("customer_id", F.col("name").alias("_n"))
    return (alerts.join(names, "customer_id", "left")
            .select("transaction_id", F.coalesce("_n", F.lit("Unknown")).alias("customer_name"),
                    "amount", "risk_score"))


def high_risk_stream(spark: SparkSession, events: DataFrame, customers: DataFrame, threshold: int = 80,
                     path: str | None = None, trigger=None) -> DataFrame:
    """The one-minute dynamic table. The stream appends the high-risk alerts;
    names are joined in the batch read, so no trigger shuffles the
    customer table (a stream-static left join could not broadcast it)."""
    alerts = run_append(spark, high_risk_alerts_stream(events, threshold), "high_risk", path=path, trigger=trigger)
    return with_customer_names(alerts, customers)


def _volume_by_account(spark: SparkSession, events: DataFrame, bucket, bucket_type: T.DataType, name: str, time_col: str,
                       count_col: str, sum_col: str, path=None, trigger=None) -> DataFrame:
    """Count and amount per (time bucket, account): no join in the stream, so
    a trigger never shuffles the account -> branch map."""
    tx = event_transactions(events).withColumn(time_col, bucket)
    schema = T.StructType([T.StructField(time_col, bucket_type), T.StructField("account_number", T.StringType()),
                           T.StructField(count_col, T.LongType()), T.StructField(sum_col, T.DecimalType(38, 2))])
    sums = [F.count(F.lit(1)).alias(count_col), F.sum("amount").cast("decimal(38,2)").alias(sum_col)]
    return run_partials(spark, tx, name, [time_col, "account_number"], sums, schema, trigger, path)


def rollup_by_branch(partials: DataFrame, account_branch: DataFrame, time_col: str, count_col: str,
                     sum_col: str) -> DataFrame:
    """Per-account partials summed per (time, branch): one batch join at
    read time, after the partials were combined per account."""
    return (partials.join(account_branch, "account_number", "inner")
            .groupBy(time_col, "branch_name")
            .agg(F.sum(count_col).cast("bigint").alias(count_col), F.sum(sum_col).cast("decimal(38,2)").alias(sum_col)))


def live_daily_branch(spark: SparkSession, events: DataFrame, account_branch: DataFrame,
                      path: str | None = None, trigger=None) -> DataFrame:
    """The materialized daily branch aggregate kept current. The stream keeps
    per-(day, account) partial counts and sums; the branch totals are summed on read."""
    part = _volume_by_account(spark, events, F.to_date("timestamp"), T.DateType(), "live_daily_branch", "transaction_date",
                              "daily_count", "daily_amount", path, trigger)
    return rollup_by_branch(part, account_branch, "transaction_date", "daily_count", "daily_amount")


def hourly_consolidate(spark: SparkSession, events: DataFrame, account_branch: DataFrame,
                       path: str | None = None, trigger=None) -> DataFrame:
    """The hourly task as an idempotent keyed rollup: per (branch, hour)
    transaction count and amount (the reference's INSERT repeats one key)."""
    hour = F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz")
    part = _volume_by_account(spark, events, hour, T.TimestampNTZType(), "hourly_consolidate", "hour_start",
                              "transaction_count", "total_amount", path, trigger)
    return rollup_by_branch(part, account_branch, "hour_start", "transaction_count", "total_amount")


def fraud_velocity_stream(spark: SparkSession, events: DataFrame, window: str = "1 hour", slide: str = "10 minutes",
                          max_count: int = 2, path: str | None = None, trigger=None) -> DataFrame:
    """Sliding-window count per account over all batches; windows whose count
    passed ``max_count``. Batches store one row per account and pane."""
    tx = event_transactions(events).select("account_number", "amount", fraud.pane("timestamp", window, slide).alias("pane"))
    schema = T.StructType([T.StructField("account_number", T.StringType()), T.StructField("pane", T.TimestampNTZType()),
                           T.StructField("tx_count", T.LongType()), T.StructField("total_amount", T.DecimalType(38, 2))])
    sums = [F.count(F.lit(1)).alias("tx_count"), F.sum("amount").cast("decimal(38,2)").alias("total_amount")]
    out = run_partials(spark, tx, "fraud_velocity", ["account_number", "pane"], sums, schema, trigger, path)
    return fraud.velocity_alerts(out, window, slide, max_count)


def fraud_geographic_stream(spark: SparkSession, events: DataFrame, minutes: int = 60, path: str | None = None,
                            trigger=None) -> tuple[DataFrame, DataFrame]:
    """(alerts in force, signed changes) of the geographic rule over the stream."""
    tx = event_transactions(events).select("transaction_id", "timestamp", "account_number", "location")
    return run_previous_rule(spark, tx, "fraud_geographic", fraud.GEOGRAPHIC_KEYS, minutes, fraud.GEOGRAPHIC_CARRY,
                             fraud.geographic_alerts, path, trigger)


def fraud_duplicate_stream(spark: SparkSession, events: DataFrame, minutes: int = 30, amount_scale: int = 2,
                           path: str | None = None, trigger=None) -> tuple[DataFrame, DataFrame]:
    """(alerts in force, signed changes) of the duplicate rule over the stream."""
    tx = event_transactions(events).select("transaction_id", "timestamp", "account_number", "amount", "merchant_name")
    return run_previous_rule(spark, fraud.with_amount_key(tx, amount_scale), "fraud_duplicate", fraud.DUPLICATE_KEYS, minutes,
                             fraud.DUPLICATE_CARRY, fraud.duplicate_alerts, path, trigger)


# ---------------------------------------------------------------- change data capture

def compacting_sink(path: str, key: str, ts: str = "change_ts", seq: str = "_seq"):
    """``foreachBatch`` writer for a change log: the batch's last change per
    key (a ``max(struct)`` aggregate, no state store) into
    ``path/_batch=<id>``; a replayed batch rewrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        payload = [c for c in batch.columns if c not in (key, ts, seq)]
        last = batch.groupBy(key).agg(F.max(F.struct(ts, seq, *payload)).alias("_w"))
        (last.select(key, *[F.col(f"_w.{c}").alias(c) for c in (ts, seq, *payload)])
         .withColumn("_batch", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(path))
    return write


def run_cdc(spark: SparkSession, changes: DataFrame, name: str, key: str, path: str | None = None,
            trigger=None) -> str:
    """Consume a change-log stream since its checkpoint (the warehouse's
    STREAM object: each run reads only rows not read before) into a
    compacting sink. Returns the sink folder."""
    out = path or scratch_path(spark, name)
    q = (changes.writeStream.option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(**(trigger or {"availableNow": True}))
         .foreachBatch(compacting_sink(f"{out}/data", key)).start())
    q.awaitTermination()
    return f"{out}/data"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete version folders ``v=<n>`` of ``path``, ascending."""
    return numbered(spark, path, "v=")


def compacted_state(spark: SparkSession, data: str, snapshots: str, schema: T.StructType, key: str, ts: str = "change_ts",
                    seq: str = "_seq") -> DataFrame:
    """The last change per key (deletes kept as such) as a snapshot table.

    ``snapshots/v=<batch>`` holds the state up to that batch of the change
    sink ``data``. A run reads the newest snapshot and only the batches after
    it, and writes the next snapshot; older ones are dropped."""
    have = _versions(spark, snapshots)
    since = have[-1] if have else -1
    new = spark.read.schema(T.StructType(schema.fields + [T.StructField("_batch", T.LongType())])).parquet(data) \
        .filter(F.col("_batch") > since)
    upto = new.agg(F.max("_batch")).first()[0]
    if upto is None:
        return spark.read.schema(schema).parquet(f"{snapshots}/v={since}")
    rows = new.drop("_batch")
    if have:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{snapshots}/v={since}"))
    payload = [f.name for f in schema.fields if f.name not in (key, ts, seq)]
    last = rows.groupBy(key).agg(F.max(F.struct(ts, seq, *payload)).alias("_w"))
    last.select(*[F.col(c) if c == key else F.col(f"_w.{c}").alias(c) for c in schema.names]) \
        .write.mode("overwrite").parquet(f"{snapshots}/v={upto}")
    for v in have[:-1]:
        _drop_folder(spark, f"{snapshots}/v={v}")
    return spark.read.schema(schema).parquet(f"{snapshots}/v={upto}")


def hourly_deposits(spark: SparkSession, changes: DataFrame, account_branch: DataFrame, key: str,
                    run_hour: str, root: str, balance: str = "balance") -> DataFrame:
    """The hourly task's body as an idempotent job: consume the account
    change log since the last run (compacting sink), then write total
    deposits of the live accounts per branch into the ``run_hour``
    partition (dynamic overwrite: a re-run of the same hour replaces its
    rows instead of repeating them). Returns the rows of this run."""
    from ..operators.versions import table_as_of
    data = run_cdc(spark, changes, "deposits", key, path=f"{root}/changes")
    compacted = compacted_state(spark, data, f"{root}/state", changes.schema, key)
    current = table_as_of(compacted, key, "9999-12-31 00:00:00")
    rollup = (current.join(account_branch, key, "inner").groupBy("branch_name")
              .agg(F.sum(balance).cast("decimal(38,2)").alias("total_deposits"),
                   F.count(F.lit(1)).alias("accounts"))
              .withColumn("run_hour", F.lit(run_hour).cast("timestamp_ntz")))
    (rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_hour").parquet(f"{root}/rollup"))
    out = spark.read.schema(rollup.schema).parquet(f"{root}/rollup")
    return out.filter(F.col("run_hour") == F.lit(run_hour).cast("timestamp_ntz")).drop("run_hour")
