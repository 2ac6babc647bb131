"""Newest-k feeds of the stored transactions: from the last day backwards.

Transactions lie in one folder per day, and a small table counts the rows of
each (day, type, risk). A feed reads days from the newest on (rows without a
time come before all others, as in the lists) until k rows are certain:

* without a search text, the counts say exactly which days hold the newest k
  matching rows, so these days are read once and nothing else, however sparse
  the last days are or rare the type is;
* with one, days are read in steps, each of about ``GROWTH`` times the rows of
  the one before, until k rows are found. No day is read twice, so a text that
  never occurs costs one pass.

A step keeps at most k rows (checkpointed); days are listed on the driver, as
the file listing is. The counts are sums: every write of transactions adds its
own (``write_transactions``), and they must cover all rows of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import all_of, contains_any, optional_eq
from ..sources import stored
from ..streaming.deltas import hadoop_path
from . import lists
from .joins import enrich_customer_name, pin

DAY = stored.PARTITIONS["transactions"][0]
COUNTS_SCHEMA = f"{DAY} date, kind string, risk string, n bigint"
GROWTH = 4
FIRST_ROWS = 100_000  # rows that the first step of a search reads at least, if there are as many


def write_transactions(df: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Write transactions in the stored layout and add their day counts.

    The counts go first: a day that is counted but not there costs a look, a
    day that is there but not counted would be missed."""
    day = stored.PARTITIONS["transactions"][1]
    (df.groupBy(day(df).alias(DAY), F.upper("transaction_type").alias("kind"), F.upper("risk_factor").alias("risk"))
     .agg(F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(f"{root}/transaction_days"))
    stored.write_table(df, root, "transactions", mode)


def day_counts(spark: SparkSession, root: str, tx_type=None, risk=None) -> list[tuple]:
    """(day, matching rows) of every day that has any, newest first."""
    counts = spark.read.schema(COUNTS_SCHEMA).parquet(f"{root}/transaction_days")
    matching = all_of(optional_eq("kind", tx_type), optional_eq("risk", risk))
    counts = counts if matching is None else counts.filter(matching)
    days = counts.groupBy(DAY).agg(F.sum("n").alias("n")).collect()
    return sorted(((r[DAY], r.n) for r in days), key=lambda d: (d[0] is None, d[0] and d[0].toordinal()), reverse=True)


def steps(days: list[tuple], first: int) -> list[list]:
    """Days in steps: the first has at least ``first`` rows, each further one
    ``GROWTH`` times as many as the one before."""
    out, rows, wanted = [[]], 0, first
    for day, n in days:
        if rows >= wanted:
            out.append([])
            rows, wanted = 0, wanted * GROWTH
        out[-1].append(day)
        rows += n
    return out if days else []


def folders(bank: stored.StoredBank) -> set[str]:
    """Names of the day folders there are: one listing, not of the files in them."""
    fs, p = hadoop_path(bank.spark, f"{bank.root}/transactions")
    return {s.getPath().getName() for s in fs.listStatus(p)}


def in_days(bank: stored.StoredBank, days: list, there: set[str]) -> DataFrame:
    """Rows of the given days; no other folder is listed or opened."""
    names = [f"{DAY}={'__HIVE_DEFAULT_PARTITION__' if d is None else d.isoformat()}" for d in days]
    paths = [f"{bank.root}/transactions/{n}" for n in names if n in there]
    schema = stored.stored_schema("transactions")
    if not paths:
        return bank.spark.createDataFrame([], schema)
    return bank.spark.read.schema(schema).option("basePath", f"{bank.root}/transactions").parquet(*paths)


def newest(bank: stored.StoredBank, tx_type=None, risk=None, k: int = 200, search: str | None = None,
           first_rows: int = FIRST_ROWS) -> DataFrame:
    """The newest k matching transactions, unordered, in at most k rows."""
    days = day_counts(bank.spark, bank.root, tx_type, risk)
    text, kept, found = (search or "").strip(), [], 0
    matching, there = all_of(optional_eq("transaction_type", tx_type), optional_eq("risk_factor", risk)), folders(bank)
    columns = stored.stored_schema("transactions").fieldNames()
    for step in steps(days, max(k, first_rows) if text else k):
        if found >= k:
            break
        t = in_days(bank, step, there)
        t = t if matching is None else t.filter(matching)
        if text and text.lower() in "unknown":
            t = lists.enrich_all_customer_names(t, bank).filter(
                contains_any(["transaction_id", "account_number", "customer_name", "merchant_name"], text)).drop("customer_name")
        elif text:
            t = lists.own_or_named(t, bank, text)
        kept.append(pin(lists.top_k(t.select(*columns), lists.NEWEST_FIRST(), k - found)))
        found += kept[-1].count()
    return reduce(DataFrame.unionByName, kept) if kept else in_days(bank, [], there)


def txn_enriched(bank: stored.StoredBank, tx_type=None, risk=None, k: int = 200, search: str | None = None) -> DataFrame:
    """``lists.txn_enriched`` on the stored layout."""
    top = newest(bank, tx_type, risk, k, search)
    return lists.txn_feed(enrich_customer_name(top, bank.accounts, bank.customers, k))


def recent_activity(bank: stored.StoredBank, k: int = 10) -> DataFrame:
    """``lists.recent_activity`` on the stored layout."""
    return lists.activity_feed(enrich_customer_name(newest(bank, k=k), bank.accounts, bank.customers, k))
