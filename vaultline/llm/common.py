"""Shared helpers: row identity, Arrow scans, stored intermediate tables.

Row identity. A document is a distinct (doc_id, text) pair. ``KEY_D`` is the
doc_id (nulls sort after every other id) and ``KEY_H`` the XXH64 of the text
(null reads as empty). Rows that repeat both are one document listed several
times: each row gets that document's result. Rows that share a doc_id but not
the text are different documents, ordered by ``KEY_H``.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

KEY_D, KEY_H = "__llm_d", "__llm_h"
KEYS = [KEY_D, KEY_H]
NO_ID = 2**63 - 1  # stands for a null doc_id, so that nulls order last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with the document key columns added."""
    return df.withColumns({
        KEY_D: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
        KEY_H: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })


def doc_texts(df: DataFrame) -> DataFrame:
    """Only the key and the text (null: empty) of each row."""
    return keyed(df.select("doc_id", "text")).select(
        *KEYS, F.coalesce("text", F.lit("")).alias("text"))


def id_or_null(col) -> F.Column:
    """The doc_id behind a ``KEY_D`` value."""
    return F.when(col != F.lit(NO_ID), col)


BATCH_BYTES = 8 * 1024 * 1024
_BATCH_CONF, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_CONF, _SPARK_DEFAULT) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema) -> DataFrame:
    """``fn`` turns each Arrow batch into column dicts (arrays or lists).

    Types come from ``schema`` (a StructType or DDL). Batches hold at most
    ``spark.sql.execution.arrow.maxBytesPerBatch`` bytes (plus one row), which
    bounds a worker's memory; where nobody set it, ``BATCH_BYTES`` is used.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            out = fn(batch)
            for cols in ([out] if isinstance(out, dict) else out):
                arrays = [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type)
                          for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, target)


class Scratch:
    """Intermediate tables of one run, in the cluster's shared folder.

    Saving cuts the lineage (a lost executor costs no upstream stage) and
    lets Spark free the shuffle files of the finished step. Tables that no
    result reads any more are dropped by ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        schema = df.schema
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # finished shuffles are released with their plan
        return self.spark.read.schema(schema).parquet(path)

    def free(self) -> None:
        """Once more let Spark release the shuffle files of finished steps: right
        after a step, its last events can still hold its plan. For steps
        before one that shuffles whole texts."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
