"""Banking tables in key-hash buckets, rewritten bucket by bucket.

A ``BucketTable`` keeps a table's rows in a fixed number of buckets by the
hash of the primary key. A version writes only the buckets it changes, into
its own folder, and then a manifest that names, for every bucket, the version
that holds it. The manifest is the commit: a job that dies before it leaves
the table as it was, and its retry overwrites the folder it had begun. So a
batch of few keys reads and writes few buckets however large the table is, and
every earlier version stays readable until ``vacuum``.

The manifest has one row per bucket. Choose ``buckets`` so that one holds
about an input split; a hot key is no concern, as primary keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.deltas import drop_folder, hadoop_path, numbered
from . import schemas

BUCKET = "_bucket"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        self.schema, self.key = schemas.BY_NAME[name], schemas.PRIMARY_KEYS[name]

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last committed version; -1 before the first."""
        return (numbered(self.spark, f"{self.path}/manifest", "v=") or [-1])[-1]

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket -> the version whose folder holds it; empty buckets have none."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, held int").parquet(f"{self.path}/manifest/v={version}")
        return dict(rows.collect())

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets, now or as of a version."""
        held = self.manifest(version)
        wanted = held if buckets is None else [x for x in buckets if x in held]
        paths = [f"{self.path}/data/v={held[x]}/{BUCKET}={x}" for x in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, buckets: list[int] | None = None) -> int:
        """Commit ``rows`` as the whole content of ``buckets`` (None: of the
        table); returns the new version."""
        version = self.version() + 1
        kept = {} if buckets is None else {x: v for x, v in self.manifest().items() if x not in set(buckets)}
        folder = f"{self.path}/data/v={version}"
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        out = out.withColumn(BUCKET, self.bucket_of(F.col(self.key)))
        # rebalanced, so that a large bucket becomes several files of the advisory size
        out.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        fs, p = hadoop_path(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        written = {int(n[len(BUCKET) + 1:]): version for n in names if n.startswith(f"{BUCKET}=")}
        if buckets is not None and not set(written) <= set(buckets):
            raise ValueError("rows outside the buckets that are replaced")
        held = sorted({**kept, **written}.items())
        (self.spark.createDataFrame(held, "bucket int, held int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}"))
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Remove what none of the last ``keep`` versions reads; returns how
        many folders went. Versions before them can't be read any more."""
        versions = numbered(self.spark, f"{self.path}/manifest", "v=")
        needed = {(v, x) for n in versions[-keep:] for x, v in self.manifest(n).items()}
        gone = 0
        for v in numbered(self.spark, f"{self.path}/data", "v="):
            if not versions or v > versions[-1]:
                continue  # not committed yet
            fs, p = hadoop_path(self.spark, f"{self.path}/data/v={v}")
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                if name.startswith(f"{BUCKET}=") and (v, int(name[len(BUCKET) + 1:])) not in needed:
                    drop_folder(self.spark, s.getPath().toString())
                    gone += 1
        for v in versions[:-keep]:
            drop_folder(self.spark, f"{self.path}/manifest/v={v}")
        return gone
