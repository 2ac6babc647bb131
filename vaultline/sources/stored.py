"""Stored banking tables: the layout a cluster keeps, read with fixed schemas.

``write_tables(bank, root)`` writes the banking tables as parquet folders;
``StoredBank(spark, root)`` reads them back with the DDL's fixed schemas
(no inference, no footer merging) and offers the same attributes as
``Bank``, so every operator runs on either.

Transactions are partitioned by day (``transaction_date``): a date filter
of a report becomes partition pruning at the scan instead of a row filter.
Rows are rebalanced by day before the write, so files have about the
advisory size and a hot day is split over several tasks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

TABLES = ("customers", "accounts", "transactions", "loans", "branch_performance", "fraud_alerts", "records")
PARTITIONS = {"transactions": ("transaction_date", lambda df: F.to_date(df["timestamp"]))}


def stored_schema(name: str) -> T.StructType:
    schema = schemas.BY_NAME[name]
    if name in PARTITIONS:
        col = PARTITIONS[name][0]
        schema = T.StructType(list(schema.fields) + [T.StructField(col, T.DateType(), True)])
    return schema


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Write one banking table under ``root/name`` in the stored layout."""
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.BY_NAME[name].fields])
    w = out
    if name in PARTITIONS:
        col, expr = PARTITIONS[name]
        # rebalance: AQE merges small days and splits a hot day into files
        # of the advisory size, so no task writes a skewed day alone
        w = out.withColumn(col, expr(out)).hint("rebalance", col)
        w.write.mode(mode).partitionBy(col).parquet(f"{root}/{name}")
    else:
        w.write.mode(mode).parquet(f"{root}/{name}")


def write_tables(bank, root: str, names=TABLES) -> None:
    for name in names:
        write_table(bank.table(name), root, name)


class StoredBank:
    """Banking tables read from ``root`` with their fixed schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(stored_schema(name)).parquet(f"{self.root}/{name}")

    @cached_property
    def customers(self) -> DataFrame:
        return self._read("customers")

    @cached_property
    def accounts(self) -> DataFrame:
        return self._read("accounts")

    @cached_property
    def transactions(self) -> DataFrame:
        return self._read("transactions")

    @cached_property
    def loans(self) -> DataFrame:
        return self._read("loans")

    @cached_property
    def branch_performance(self) -> DataFrame:
        return self._read("branch_performance")

    @cached_property
    def fraud_alerts(self) -> DataFrame:
        return self._read("fraud_alerts")

    @cached_property
    def records(self) -> DataFrame:
        return self._read("records")
