"""Tables kept as additive rows in batch folders.

A ``DeltaLog`` holds rows (group columns, sums). Every micro-batch writes its
rows, summed per group, to a folder of its own, so a replayed batch rewrites
that folder and nothing counts twice; a reader adds up all folders and drops
groups whose sums are all zero. With ``key`` the rows are also parted by a
hash of that column, and a reader that knows which keys it needs opens only
their parts. ``fold`` adds up old folders into one base folder.

A ``KeyedState`` is such a log of row images with a count of +1 or -1: the
newest row of each key, deletes included as marked rows. ``apply`` looks up
the images that a batch of changes replaces, in the parts of its keys only,
and writes them with -1 beside the new images with +1. Changes are ordered by
their own (time, sequence), so they may arrive in any order and repeatedly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, PART = "_batch", "_part"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a folder in any store that Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the complete folders ``path/<prefix><n>``, ascending."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)]
    return sorted(int(q.getName()[len(prefix):]) for q in found if fs.exists(make(q, "_SUCCESS")))


class DeltaLog:
    """Sums per group, in batch folders under ``path``.

    ``schema`` has the group columns and the sums (numbers). ``key`` is the
    group column by whose hash rows are parted into ``parts``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, sums: list[str], key: str | None = None, parts: int = 16):
        self.spark, self.path, self.sums, self.key, self.parts = spark, path, sums, key, parts
        self.schema = T.StructType.fromDDL(schema)
        self.group = [f.name for f in self.schema.fields if f.name not in sums]

    def _summed(self, df: DataFrame) -> DataFrame:
        some = " or ".join(f"{c} <> 0" for c in self.sums)
        return df.groupBy(*self.group).agg(*[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in self.sums]) \
            .where(some).select(*self.schema.names)

    def part_of(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def parts_with(self, keys: DataFrame, column: str | None = None) -> list[int]:
        """Parts that hold the keys of ``keys``; at most ``parts`` numbers."""
        found = keys.select(self.part_of(F.col(column or self.key)).alias(PART)).distinct()
        return sorted(r[0] for r in found.collect())

    def _store(self, df: DataFrame, path: str) -> None:
        if self.key:
            df.withColumn(PART, self.part_of(F.col(self.key))).write.mode("overwrite").partitionBy(PART).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def _open(self, path: str) -> DataFrame:
        fields = self.schema.fields + ([T.StructField(PART, T.IntegerType())] if self.key else [])
        return self.spark.read.schema(T.StructType(fields)).parquet(path)

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Write the batch's rows, replacing what an earlier try of it wrote."""
        self._store(self._summed(df), f"{self.path}/delta/{BATCH}={batch_id}")

    def delta(self, batch_id: int) -> DataFrame:
        """The stored rows of one batch."""
        return self._open(f"{self.path}/delta/{BATCH}={batch_id}").select(*self.schema.names)

    def batches(self) -> list[int]:
        """Batches since the base."""
        base = numbered(self.spark, f"{self.path}/base", "v=")
        return [b for b in numbered(self.spark, f"{self.path}/delta", f"{BATCH}=") if not base or b > base[-1]]

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """Sums over the base and all batches (below ``before``), in some parts or all."""
        base = numbered(self.spark, f"{self.path}/base", "v=")[-1:]
        if before is not None and base and base[0] >= before:
            raise ValueError(f"batch {before} is already folded into the base")
        paths = [f"{self.path}/base/v={v}" for v in base]
        paths += [f"{self.path}/delta/{BATCH}={b}" for b in self.batches() if before is None or b < before]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        out = self._open(paths[0])
        for p in paths[1:]:
            out = out.unionByName(self._open(p))
        if parts is not None:
            out = out.where(F.col(PART).isin(parts))
        return self._summed(out)

    def fold(self, upto: int, at_least: int = 1) -> bool:
        """Add up all batches up to ``upto`` into a new base, if there are
        ``at_least`` of them, and drop what it replaces. A batch after them can still be replayed."""
        old = [b for b in self.batches() if b <= upto]
        if len(old) < max(1, at_least):
            return False
        before = numbered(self.spark, f"{self.path}/base", "v=")
        self._store(self.read(before=old[-1] + 1), f"{self.path}/base/v={old[-1]}")
        for v in before:
            drop_folder(self.spark, f"{self.path}/base/v={v}")
        for b in old:
            drop_folder(self.spark, f"{self.path}/delta/{BATCH}={b}")
        return True


class KeyedState(DeltaLog):
    """The newest image of every key; ``payload`` is DDL of the other columns.

    ``parts`` bounds what a batch of few keys reads: their parts of the state."""

    def __init__(self, spark: SparkSession, path: str, key: str, payload: str, parts: int = 16):
        schema = f"{key} string, {payload}, _at timestamp_ntz, _seq long, _gone boolean, _n long"
        super().__init__(spark, path, schema, ["_n"], key, parts)
        self.payload = [f.name for f in T.StructType.fromDDL(payload).fields]

    def apply(self, changes: DataFrame, batch_id: int) -> DataFrame:
        """Apply ``changes`` (op, key, payload, change_ts, _seq); returns the
        live images that went (-1) and came (+1)."""
        c = changes.select(F.col(self.key).cast("string").alias(self.key), F.col("change_ts").alias("_at"), F.col("_seq").cast("long").alias("_seq"),
                           (F.col("op") == "DELETE").alias("_gone"), *self.payload)
        last = c.groupBy(self.key).agg(F.max(F.struct("_at", "_seq", "_gone", *self.payload)).alias("_new"))
        parts = self.parts_with(c) if batch_id else []
        old = self.read(before=batch_id, parts=parts).select(
            F.col(self.key).alias("_k"), F.struct("_at", "_seq", "_gone", *self.payload).alias("_old"))
        j = last.join(old, F.col(self.key) == F.col("_k"), "left")
        newer = F.col("_old").isNull() | (F.struct("_new._at", "_new._seq") > F.struct("_old._at", "_old._seq"))
        image = lambda c, n: F.struct(f"{c}.*", F.lit(n).cast("long").alias("_n"))
        both = F.when(F.col("_old").isNull(), F.array(image("_new", 1))).otherwise(F.array(image("_old", -1), image("_new", 1)))
        rows = j.where(newer).select(self.key, F.explode(both).alias("_r")).select(self.key, "_r.*")
        self.write(rows, batch_id)
        return self.live(self.delta(batch_id))

    def live(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.col("_gone")).select(self.key, *self.payload, "_n")
