"""Previous-event fraud rules over a stream, exact in any order of arrival.

Events are stored by area: a hash of the account and a stretch of time no
shorter than the rule's width. A rule's verdict on an event depends on the
event before it, at most one width earlier; so a batch can change verdicts
only in the areas it touches and in the ones right after them. Each batch
judges these areas twice, without and with its own events (the area before
gives their first events a predecessor), and writes the difference as signed
alerts: +1 for a new one, -1 for one that no longer holds. The alerts in force
are the sums. Nothing is rejected, and no state is kept but the events.

A batch reads only the areas named above, as a filter on the folder names.
Both outputs are folders per batch, and a batch reads only the batches before
it, so a replayed batch writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fraud
from ..session import scratch_path
from .deltas import BATCH, DeltaLog

AREA = "_area"
ACCOUNT_PARTS = 4
STRETCH_SECONDS = 86_400
# Areas of one batch that are listed in a filter; a batch that touches more reads the stored events whole.
MAX_LISTED = 10_000


class PreviousRule:
    """One rule over events stored under ``path``.

    ``keys`` part the events (the account first), ``carry`` names the columns
    taken from the previous event, ``alerts`` turns judged events into alerts."""

    def __init__(self, spark: SparkSession, path: str, keys, minutes: int, carry, alerts, event_schema: T.StructType,
                 parts: int = ACCOUNT_PARTS, stretch: int = STRETCH_SECONDS):
        self.spark, self.path, self.keys, self.minutes, self.carry, self.alerts = spark, path, list(keys), minutes, list(carry), alerts
        self.parts, self.stretch, self.schema = parts, max(stretch, minutes * 60), event_schema
        none = self.judged(spark.createDataFrame([], event_schema)).schema
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in none.fields)
        self.log = DeltaLog(spark, f"{path}/alerts", f"{ddl}, _sign long", ["_sign"])

    def judged(self, events: DataFrame) -> DataFrame:
        return self.alerts(fraud.previous_within(events, self.keys, self.minutes, self.carry))

    def _area(self) -> F.Column:
        part = F.pmod(F.xxhash64(self.keys[0]), F.lit(self.parts))
        return F.floor(fraud._seconds("timestamp") / self.stretch) * self.parts + part

    def stored(self, before: int, areas: list[int] | None = None) -> DataFrame:
        """Events of the batches below ``before``, in some areas or all."""
        schema = T.StructType(self.schema.fields + [T.StructField(BATCH, T.LongType()), T.StructField(AREA, T.LongType())])
        events = self.spark.read.schema(schema).parquet(f"{self.path}/events").where(F.col(BATCH) < before)
        return events if areas is None else events.where(F.col(AREA).isin(areas))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function."""
        rows = batch.select(*self.schema.names).withColumn(AREA, self._area())
        # one writer for each area, several for a large one
        rows.hint("rebalance", AREA).write.mode("overwrite").partitionBy(AREA).parquet(f"{self.path}/events/{BATCH}={batch_id}")
        touched = self.stored(batch_id + 1).where(F.col(BATCH) == batch_id).select(AREA).distinct()
        areas = [r[0] for r in touched.limit(MAX_LISTED + 1).collect()]
        if len(areas) > MAX_LISTED:
            judged, read = None, None
        else:
            judged = sorted({a + d * self.parts for a in areas for d in (0, 1)})
            read = sorted({a + d * self.parts for a in areas for d in (-1, 0, 1)})

        def verdicts(before: int, sign: int) -> DataFrame:
            events = self.stored(before, read)
            found = self.judged(events.select(*self.schema.names))
            if judged is not None:  # the area of the alert's own event
                place = events.select("transaction_id", AREA).where(F.col(AREA).isin(judged)).select("transaction_id").distinct()
                found = found.join(place, "transaction_id", "left_semi")
            return found.withColumn("_sign", F.lit(sign).cast("long"))
        self.log.write(verdicts(batch_id + 1, 1).unionByName(verdicts(batch_id, -1)), batch_id)

    def current(self) -> DataFrame:
        """The alerts in force."""
        return self.log.read().select(*self.log.group, F.explode(F.sequence(F.lit(1), F.col("_sign").cast("int"))).alias("_i")).drop("_i")

    def changes(self) -> DataFrame:
        """Every signed alert, with its batch."""
        out = None
        for b in self.log.batches():
            d = self.log.delta(b).withColumn(BATCH, F.lit(b).cast("long"))
            out = d if out is None else out.unionByName(d)
        return out if out is not None else self.log.read().withColumn(BATCH, F.lit(None).cast("long"))


def run_previous_rule(spark: SparkSession, tx: DataFrame, name: str, keys, minutes: int, carry, alerts, path=None,
                      trigger=None) -> tuple[DataFrame, DataFrame]:
    """Run a rule to the end of its input: (alerts in force, signed changes)."""
    out = path or scratch_path(spark, name)
    rule = PreviousRule(spark, out, keys, minutes, carry, alerts, T.StructType(tx.schema.fields))
    q = (tx.writeStream.option("checkpointLocation", f"{out}/_checkpoint").trigger(**(trigger or {"availableNow": True}))
         .foreachBatch(rule.write).start())
    q.awaitTermination()
    return rule.current(), rule.changes()
