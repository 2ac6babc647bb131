"""Key and foreign key reports kept up to date by signed counts.

A ``ConstraintState`` holds, for every constraint and key value, how many rows
have the key and (for foreign keys) how many parents do. A batch of row images,
+1 for one that came and -1 for one that went, becomes signed counts per
(constraint, key); the counts of only these keys are looked up, in the parts of
the log that hold them, and what the batch does to the number of violations is
their contribution after it less the one before. Violations are summed per
batch, so a report adds up a few rows and scans no table.

A hot key is one sum from the map side on. A replayed batch rewrites its folders
and counts once; ``fold`` adds up old batches. All images of a batch, of
children and parents, belong in one ``apply``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas
from ..streaming.deltas import DeltaLog

SIGN = "_sign"


class Check(NamedTuple):
    table: str
    kind: str  # primary_key, unique, not_null or foreign_key
    column: str
    parent: str | None = None

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}.{self.kind}"


UNIQUE = [("customers", "email"), ("branch_performance", "branch_name")]
CHECKS = [Check(t, "primary_key", pk) for t, pk in schemas.PRIMARY_KEYS.items()] \
    + [Check(t, "unique", c) for t, c in UNIQUE] \
    + [Check(t, "not_null", f.name) for t, pk in schemas.PRIMARY_KEYS.items() for f in schemas.BY_NAME[t].fields
       if not f.nullable and f.name != pk] \
    + [Check(t, "foreign_key", c, parent) for t, c, parent in schemas.FOREIGN_KEYS]


def images(df: DataFrame, sign: int = 1) -> DataFrame:
    """Rows that came (+1) or went (-1)."""
    return df.withColumn(SIGN, F.lit(sign))


def entries(table: str, signed: DataFrame) -> DataFrame:
    """Signed counts (check, key, n, parents) of a table's row images, from
    one read of them. Null keys count for primary keys and NOT NULL only."""
    sign, none = F.col(SIGN).cast("bigint"), F.lit(0).cast("bigint")
    out = []
    for c in CHECKS:
        if c.table == table:
            key = F.col(c.column).cast("string")
            entry = F.struct(F.lit(c.name).alias("check"), key.alias("key"), sign.alias("n"), none.alias("parents"))
            counts = {"primary_key": F.lit(True), "not_null": key.isNull()}.get(c.kind, key.isNotNull())
            out.append(F.when(counts, entry))
        if c.parent == table:
            key = F.col(schemas.PRIMARY_KEYS[table]).cast("string")
            out.append(F.when(key.isNotNull(), F.struct(F.lit(c.name).alias("check"), key.alias("key"), none.alias("n"),
                                                        sign.alias("parents"))))
    return signed.select(F.explode(F.array_compact(F.array(*out))).alias("_e")).select("_e.*")


def _violations(n, parents):
    """How many rows of one (check, key) break it."""
    kind = F.element_at(F.split("check", r"\."), -1)
    return (F.when((kind == "not_null") | ((kind == "primary_key") & F.col("key").isNull()), n)
            .when(kind == "foreign_key", F.when(parents <= 0, n).otherwise(F.lit(0)))
            .otherwise(F.when(n > 1, n).otherwise(F.lit(0))))


class ConstraintState:
    def __init__(self, spark: SparkSession, path: str, parts: int = 256):
        self.spark = spark
        self.counts = DeltaLog(spark, f"{path}/counts", "check string, key string, n bigint, parents bigint", ["n", "parents"], "key", parts)
        self.totals = DeltaLog(spark, f"{path}/totals", "check string, violations bigint", ["violations"])

    def apply(self, changed: dict[str, DataFrame], batch_id: int) -> None:
        """Count a batch: row images per table, each with its sign. Batches
        are numbered upwards; the first one is the tables as they are."""
        rows = [entries(t, df) for t, df in changed.items()]
        self.counts.write(reduce(DataFrame.unionByName, rows), batch_id)
        delta = self.counts.delta(batch_id)
        held = self.counts.read(before=batch_id, parts=self.counts.parts_with(delta) if self.counts.batches()[0] != batch_id else [])
        held = held.select(F.col("check").alias("_c"), F.col("key").alias("_k"), F.col("n").alias("_n"), F.col("parents").alias("_p"))
        both = delta.join(held, (F.col("check") == F.col("_c")) & F.col("key").eqNullSafe(F.col("_k")), "left")
        n, p = F.coalesce("_n", F.lit(0)), F.coalesce("_p", F.lit(0))
        moved = _violations(n + F.col("n"), p + F.col("parents")) - _violations(n, p)
        self.totals.write(both.select("check", moved.alias("violations")), batch_id)

    def fold(self, upto: int, at_least: int = 1) -> bool:
        """Add up the batches up to ``upto``; they can't be replayed after."""
        done = self.counts.fold(upto, at_least)
        return self.totals.fold(upto, at_least) or done

    def report(self) -> DataFrame:
        """Violations of every constraint: table_name, check_kind, column, parent_table, violations."""
        names = self.spark.createDataFrame([(c.name, c.table, c.kind, c.column, c.parent) for c in CHECKS],
                                           "check string, table_name string, check_kind string, column string, parent_table string")
        return names.join(self.totals.read(), "check", "left").select(
            "table_name", "check_kind", "column", "parent_table", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"))

    def violating_keys(self, check: Check) -> DataFrame:
        """Keys that break a constraint, with their rows."""
        held = self.counts.read().filter(F.col("check") == check.name)
        return held.select("key", _violations(F.col("n"), F.col("parents")).alias("violations")).filter("violations > 0")

    def missing_parents(self, check: Check, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose foreign key names no parent, from the parts
        of the batch's keys. Null keys name none and are not returned."""
        keyed = batch.filter(F.col(check.column).isNotNull()).withColumn("_key", F.col(check.column).cast("string"))
        held = self.counts.read(parts=self.counts.parts_with(keyed, "_key")).filter((F.col("check") == check.name) & (F.col("parents") > 0))
        return keyed.join(held.select(F.col("key").alias("_key")), "_key", "left_anti").select(*batch.columns)
