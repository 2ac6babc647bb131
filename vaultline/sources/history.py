"""A change log kept by day, with snapshots: any version from the nearest one.

    log/g=<n>/_day=<d>/   changes of one append, by the day of their time
    snapshots/n=<n>/      the last image of every key at a time, deletes included
    index/n=<n>/          that time and the last append the snapshot holds;
                          written last, so it is the snapshot's commit
    floor/n=<n>/          the oldest time that can be read

``as_of`` takes the newest snapshot at or before the time and replays the
changes after it: the later days, and whatever was appended after the snapshot
was made, however late it came. Deleted keys stay in a snapshot with their time,
so that an older change that comes late can't bring them back. The changes are
folded to one image per key; only these keys of the snapshot are folded again,
the others pass through.

``expire`` deletes what no time within the retention needs: older snapshots,
and the log's days before the oldest one kept, where they are in it.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import BROADCAST_MAX_KEYS
from ..operators.versions import RETENTION_DAYS
from ..streaming.deltas import drop_folder, hadoop_path, numbered

DAY, APPEND = "_day", "g"


def _iso(at) -> str:
    """A time as text that orders like the time."""
    return (at if isinstance(at, dt.datetime) else dt.datetime.fromisoformat(at)).isoformat(sep=" ", timespec="microseconds")


class Snapshot(NamedTuple):
    n: int
    at: str
    upto: int  # the last append it holds


class History:
    """``schema`` has the key, ``ts``, ``seq``, ``op`` and the payload."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, ts: str = "change_ts", seq: str = "_seq",
                 op: str = "op"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.ts, self.seq, self.op = key, ts, seq, op
        self.payload = [c for c in schema.fieldNames() if c not in (key, ts, seq, op)]

    # -- writing ------------------------------------------------------------

    def append(self, changes: DataFrame) -> int:
        """Add changes of any times; returns the append's number."""
        g = (numbered(self.spark, f"{self.path}/log", f"{APPEND}=") or [-1])[-1] + 1
        out = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        # rebalanced, so that a day with many changes becomes several files
        (out.withColumn(DAY, F.to_date(self.ts)).hint("rebalance", DAY)
         .write.mode("overwrite").partitionBy(DAY).parquet(f"{self.path}/log/{APPEND}={g}"))
        return g

    def snapshot(self, at: str) -> int:
        """Keep the version at ``at``, built from the snapshot before it."""
        appends = self._appends()
        n = (numbered(self.spark, f"{self.path}/index", "n=") or [-1])[-1] + 1
        self._images(at, appends).write.mode("overwrite").parquet(f"{self.path}/snapshots/n={n}")
        (self.spark.createDataFrame([(n, _iso(at), appends[-1] if appends else -1)], "n int, at string, upto int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/index/n={n}"))
        return n

    def expire(self, now: str, retention_days: int = RETENTION_DAYS) -> int:
        """Delete what is only needed for times more than the retention before
        ``now``; returns how many folders went. Without a snapshot at or before
        that bound nothing goes. A bound before the floor changes nothing."""
        bound = _iso(dt.datetime.fromisoformat(now) - dt.timedelta(days=retention_days))
        oldest = self.nearest(bound)
        if oldest is None:
            return 0
        # the floor is written first: a job that dies while deleting leaves no time that is read in part
        n = (numbered(self.spark, f"{self.path}/floor", "n=") or [-1])[-1] + 1
        (self.spark.createDataFrame([(oldest.at,)], "at string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/floor/n={n}"))
        gone, kept = 0, []
        for s in self.snapshots():
            if (s.at, s.n) >= (oldest.at, oldest.n):
                kept.append(s)
                continue
            drop_folder(self.spark, f"{self.path}/index/n={s.n}")
            drop_folder(self.spark, f"{self.path}/snapshots/n={s.n}")
            gone += 1
        held = min(s.upto for s in kept)  # a later append is late to one of the snapshots
        for g in self._appends():
            fs, p = hadoop_path(self.spark, f"{self.path}/log/{APPEND}={g}")
            for status in fs.listStatus(p) if g <= held else ():
                name = status.getPath().getName()
                if name.startswith(f"{DAY}=") and name[len(DAY) + 1:] < oldest.at[:10]:
                    drop_folder(self.spark, status.getPath().toString())
                    gone += 1
        return gone

    # -- reading ------------------------------------------------------------

    def snapshots(self) -> list[Snapshot]:
        found = numbered(self.spark, f"{self.path}/index", "n=")
        if not found:
            return []
        rows = self.spark.read.schema("n int, at string, upto int").parquet(*[f"{self.path}/index/n={n}" for n in found]).collect()
        return sorted((Snapshot(*r) for r in rows), key=lambda s: (s.at, s.n))

    def nearest(self, at: str) -> Snapshot | None:
        """The newest snapshot at or before a time."""
        return max((s for s in self.snapshots() if s.at <= _iso(at)), key=lambda s: (s.at, s.n), default=None)

    def floor(self) -> str | None:
        """The oldest time that can be read; None before the first ``expire``."""
        found = numbered(self.spark, f"{self.path}/floor", "n=")
        return self.spark.read.schema("at string").parquet(f"{self.path}/floor/n={found[-1]}").first()[0] if found else None

    def as_of(self, at: str) -> DataFrame:
        """The table at a time: key, payload and the time of the last change.
        A time that ``expire`` has given up is refused."""
        images = self._images(at, self._appends())
        return images.filter(F.col(self.op) != "DELETE").select(self.key, *self.payload, F.col(self.ts).alias("last_change_ts"))

    def _appends(self) -> list[int]:
        return numbered(self.spark, f"{self.path}/log", f"{APPEND}=")

    def _log(self, appends: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(APPEND, T.IntegerType()), T.StructField(DAY, T.DateType())])
        if not appends:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/log").filter(F.col(APPEND).isin(appends))

    def _last(self, rows: DataFrame) -> DataFrame:
        image = F.max(F.struct(self.ts, self.seq, self.op, *self.payload)).alias("_w")
        return rows.groupBy(self.key).agg(image).select(*[F.col(c if c == self.key else f"_w.{c}").alias(c) for c in self.schema.fieldNames()])

    def _images(self, at: str, appends: list[int]) -> DataFrame:
        """The last image of every key at a time, deletes included."""
        def time(value):
            return F.lit(value).cast(self.schema[self.ts].dataType)

        floor = self.floor()
        if floor is not None and _iso(at) < floor:
            raise ValueError(f"{at} is before {floor}, the oldest version kept")
        base, log = self.nearest(at), self._log(appends)
        log = log.filter((F.col(DAY) <= F.lit(_iso(at)[:10]).cast("date")) & (F.col(self.ts) <= time(at)))
        if base is None:
            return self._last(log.select(*self.schema.fieldNames()))
        late = F.col(APPEND) > base.upto
        log = log.filter(((F.col(DAY) >= F.lit(base.at[:10]).cast("date")) | late) & ((F.col(self.ts) > time(base.at)) | late))
        delta = self._last(log.select(*self.schema.fieldNames()))
        kept = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/n={base.n}")
        changed = delta.select(F.col(self.key).alias("_changed"))
        if delta.limit(BROADCAST_MAX_KEYS + 1).count() <= BROADCAST_MAX_KEYS:
            changed = F.broadcast(changed)
        same = F.col(self.key).eqNullSafe(F.col("_changed"))
        return kept.join(changed, same, "left_anti").unionByName(self._last(kept.join(changed, same, "left_semi").unionByName(delta)))
