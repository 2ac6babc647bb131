"""Sinks: the daily aggregate table, JSON rows, camelCase result columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import daily_branch_volume


def camel_case(name: str) -> str:
    """lower-case, then ``_x`` / `` x`` -> ``X`` (the client's key rule)."""
    return re.sub(r"[_ ]([a-z0-9])", lambda m: m.group(1).upper(), name.lower())


def camel_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel_case(c) for c in df.columns])


def json_rows(df: DataFrame, camel: bool = True) -> DataFrame:
    """One JSON object per row (keys camelCased), NULL fields kept."""
    d = camel_case_columns(df) if camel else df
    return d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("json"))


def refresh_daily_branch(bank, path: str, transactions: DataFrame | None = None) -> DataFrame:
    """Materialize the daily branch aggregate, partitioned by day.

    Dynamic partition overwrite replaces only the days present in the new
    result, so refreshing a slice of days (a filtered ``transactions``)
    leaves the other days of the table untouched. The aggregate has at most
    one row per (day, branch), so no day can be skewed: it is hash
    partitioned by day over the shuffle partitions before the write, one
    file per day instead of one per (task, day), written in parallel.
    """
    agg = daily_branch_volume(bank, transactions)
    n = int(bank.spark.conf.get("spark.sql.shuffle.partitions"))
    (agg.repartition(n, "transaction_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("transaction_date").parquet(path))
    return bank.spark.read.schema(agg.schema).parquet(path)
