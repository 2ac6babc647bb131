"""Table versions from a change log: point-in-time state, diffs, clones.

The warehouse's time travel, change stream and clone become jobs over an
ordered change log (key, op, payload, change_ts, _seq):

* ``table_as_of``  -- last change per key at or before ``as_of``, deletes
  dropped. The winner is picked by a ``max(struct(change_ts, _seq, ...))``
  aggregate with a partial step in each task (no window over a whole key in
  one task).
* ``cdc_changes``  -- full outer join of two versions on the key,
  classified INSERT / UPDATE / DELETE; unchanged rows are dropped.
* ``net_changes``  -- the same rows from the log's interval between two
  times: only the keys that it names are folded and looked up before it.
* ``ChangeReader`` -- a consumer's position in the log; it moves on only
  when the consumer has committed what it read.
* ``clone_table``  -- a full copy written to a new path (a real copy, not
  the warehouse's metadata-only clone).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.deltas import numbered

RETENTION_DAYS = 14


def table_as_of(changes: DataFrame, key: str, as_of: str, ts: str = "change_ts", seq: str = "_seq",
                op: str = "op", now: str | None = None, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """The table at ``as_of``. With ``now``, a time further back than the
    retention is refused, as the warehouse does."""
    if now is not None and dt.datetime.fromisoformat(as_of) < dt.datetime.fromisoformat(now) - dt.timedelta(days=retention_days):
        raise ValueError(f"{as_of} is more than {retention_days} days before {now}")
    payload = [c for c in changes.columns if c not in (key, ts, seq, op)]
    c = changes.filter(F.col(ts) <= F.lit(as_of).cast(changes.schema[ts].dataType))
    w = c.groupBy(key).agg(F.max(F.struct(ts, seq, op, *payload)).alias("_w"))
    return (w.filter(F.col(f"_w.{op}") != "DELETE")
            .select(key, *[F.col(f"_w.{p}").alias(p) for p in payload], F.col(f"_w.{ts}").alias("last_change_ts")))


def cdc_changes(old: DataFrame, new: DataFrame, key: str, cols) -> DataFrame:
    """Rows changed between two versions, one row per changed key."""
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in cols]).withColumn("_in_old", F.lit(True))
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in cols]).withColumn("_in_new", F.lit(True))
    j = o.join(n, key, "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in cols])
    kind = (F.when(F.col("_in_old").isNull(), "INSERT").when(F.col("_in_new").isNull(), "DELETE")
            .when(differs, "UPDATE"))
    return (j.withColumn("change_type", kind).filter(F.col("change_type").isNotNull())
            .select(key, "change_type", *[f"old_{c}" for c in cols], *[f"new_{c}" for c in cols]))


def net_changes(changes: DataFrame, key: str, after: str | None, upto: str, cols, ts: str = "change_ts", seq: str = "_seq",
                op: str = "op") -> DataFrame:
    """What the changes in (``after``, ``upto``] did to each key in the end:
    the rows of ``cdc_changes`` between the two versions, without building
    either. ``cols`` may name ``last_change_ts``.

    The interval is folded to one last image per key in a partial aggregate.
    Only rows of keys in it leave the older log, folded likewise, so the rest
    of the table is neither shuffled nor compared. A key that came and went
    inside the interval has no row; one that went and came back is an UPDATE.
    Without ``after`` the interval starts at the log's beginning. Changes
    without a time are in no interval."""
    payload = [c for c in changes.columns if c not in (key, ts, seq, op)]

    def at(value):
        return F.lit(value).cast(changes.schema[ts].dataType)

    def last(rows, side):
        held = rows.groupBy(key).agg(F.max(F.struct(ts, seq, op, *payload)).alias("_w"))
        there = F.col(f"_w.{op}") != "DELETE"
        image = [F.when(there, F.col(f"_w.{ts if c == 'last_change_ts' else c}")).alias(f"{side}_{c}") for c in cols]
        return held.select(F.col(key).alias(f"_{side}_key"), there.alias(f"_in_{side}"), *image)

    inside = changes.filter(F.col(ts) <= at(upto))
    if after is None:
        before = changes.limit(0)
    else:
        inside = inside.filter(F.col(ts) > at(after))
        before = changes.filter(F.col(ts) <= at(after)).join(inside.select(key).distinct(), key, "left_semi")
    j = last(inside, "new").join(last(before, "old"), F.col("_new_key").eqNullSafe(F.col("_old_key")), "left")
    was, now = F.coalesce("_in_old", F.lit(False)), F.col("_in_new")
    differs = reduce(lambda a, b: a | b, [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in cols])
    kind = F.when(~was & now, "INSERT").when(was & ~now, "DELETE").when(was & now & differs, "UPDATE")
    return (j.withColumn("change_type", kind).filter(F.col("change_type").isNotNull())
            .select(F.col("_new_key").alias(key), "change_type", *[f"old_{c}" for c in cols], *[f"new_{c}" for c in cols]))


class ChangeReader:
    """A consumer's place in a change log, kept under ``path``.

    ``read`` gives the net changes since the position and names the new one;
    ``commit`` stores it. A consumer that dies in between reads the same
    interval again, with what came since. A position is a change time, so
    ``upto`` must be a time before which no change can come any more."""

    def __init__(self, spark, path: str, key: str, cols):
        self.spark, self.path, self.key, self.cols = spark, path, key, cols

    def position(self) -> str | None:
        kept = numbered(self.spark, self.path, "n=")
        return self.spark.read.schema("at string").parquet(f"{self.path}/n={kept[-1]}").first()[0] if kept else None

    def read(self, changes: DataFrame, upto: str) -> DataFrame:
        return net_changes(changes, self.key, self.position(), upto, self.cols)

    def commit(self, upto: str) -> None:
        position = self.position()
        if position is not None and dt.datetime.fromisoformat(upto) < dt.datetime.fromisoformat(position):
            raise ValueError(f"{upto} is before the position {position}")
        number = (numbered(self.spark, self.path, "n=") or [-1])[-1] + 1
        self.spark.createDataFrame([(upto,)], "at string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/n={number}")


def clone_table(df: DataFrame, path: str) -> DataFrame:
    """Write a full copy to ``path`` (a new folder) and return the copy."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

