"""Branch volume views kept current under inserts, updates and deletes.

The view sums transactions per (time bucket, branch) over the join of
transactions T, accounts A and customers C. Each batch brings changes of any
of the three (op, key, columns, change_ts, _seq). With primes for the tables
after the batch, the view changes by

    dT * A' * C'  +  T * dA * C'  +  T * A * dC

where d is a table's signed rows: images that went (-1) and came (+1), from
``KeyedState``. T enters as a log of partial sums per (account, bucket), A
also as a log by customer, so each term opens only the parts of the keys that
changed. The products are summed per (bucket, branch) into the view's own log;
a group whose count falls to zero is gone. Old folders are folded into bases
once there are ``fold_after`` of them; the batch before stays replayable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .deltas import DeltaLog, KeyedState


class BranchVolumeView:
    """Count and amount per (time bucket, branch) under ``path``.

    ``bucket`` is an expression over a transaction's ``timestamp``; its type
    is ``bucket_type`` and its column ``bucket_name``."""

    def __init__(self, spark: SparkSession, path: str, bucket: str, bucket_type: str, bucket_name: str,
                 parts: int = 8, fold_after: int = 20):
        self.bucket, self.name, self.fold_after = bucket, bucket_name, fold_after
        sums = "n long, s decimal(38,2)"
        self.tx = KeyedState(spark, f"{path}/transactions", "transaction_id",
                             f"account_number string, bucket {bucket_type}, amount decimal(15,2)", parts)
        self.accounts = KeyedState(spark, f"{path}/accounts", "account_number", "customer_id string", parts)
        self.customers = KeyedState(spark, f"{path}/customers", "customer_id", "branch_name string", parts)
        self.by_customer = DeltaLog(spark, f"{path}/accounts_by_customer", "customer_id string, account_number string, _n long",
                                    ["_n"], "customer_id", parts)
        self.partials = DeltaLog(spark, f"{path}/partials", f"account_number string, bucket {bucket_type}, {sums}",
                                 ["n", "s"], "account_number", parts)
        self.view = DeltaLog(spark, f"{path}/view", f"bucket {bucket_type}, branch_name string, {sums}", ["n", "s"])

    def _logs(self):
        return [self.tx, self.accounts, self.customers, self.by_customer, self.partials, self.view]

    def _product(self, tx: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
        """(bucket, branch_name, n, s) of partial sums times signed accounts times signed customers."""
        a = accounts.select("account_number", "customer_id", F.col("_n").alias("_a"))
        c = customers.select("customer_id", "branch_name", F.col("_n").alias("_c"))
        sign = F.col("_a") * F.col("_c")
        j = tx.join(a, "account_number").join(c, "customer_id")
        return j.select("bucket", "branch_name", (F.col("n") * sign).alias("n"), (F.col("s") * sign).cast("decimal(38,2)").alias("s"))

    def apply(self, batch_id: int, transactions: DataFrame | None = None, accounts: DataFrame | None = None,
              customers: DataFrame | None = None) -> None:
        """Bring the view up to date with one batch of changes. Batches are
        numbered upwards from 0; a replayed one gives the same result."""
        for log in self._logs():
            log.fold(batch_id - 1, self.fold_after)
        after, terms = batch_id + 1, []
        d_acc = self.accounts.apply(accounts, batch_id) if accounts is not None else None
        d_cus = self.customers.apply(customers, batch_id) if customers is not None else None
        if transactions is not None:
            t = transactions.withColumn("bucket", F.expr(self.bucket))
            d_tx = self.tx.apply(t, batch_id).select(
                "account_number", "bucket", F.col("_n").alias("n"), (F.col("amount") * F.col("_n")).cast("decimal(38,2)").alias("s"))
            self.partials.write(d_tx, batch_id)
            d_tx = self.partials.delta(batch_id)
            held = self.accounts.live(self.accounts.read(after, self.accounts.parts_with(d_tx)))
            terms.append(self._product(d_tx, held, self._customers(after)))
        if d_acc is not None:
            old = self.partials.read(batch_id, self.partials.parts_with(d_acc))
            terms.append(self._product(old, d_acc, self._customers(after)))
            self.by_customer.write(d_acc, batch_id)
        if d_cus is not None:
            held = self.by_customer.read(batch_id, self.by_customer.parts_with(d_cus))
            terms.append(self._product(self.partials.read(batch_id), held, d_cus))
        for k, term in enumerate(terms):
            terms[0] = term if not k else terms[0].unionByName(term)
        if terms:
            self.view.write(terms[0], batch_id)

    def _customers(self, before: int) -> DataFrame:
        return self.customers.live(self.customers.read(before))

    def read(self, count_name: str, sum_name: str) -> DataFrame:
        """The view now."""
        return self.view.read().select(F.col("bucket").alias(self.name), "branch_name", F.col("n").alias(count_name),
                                       F.col("s").alias(sum_name))


def daily_view(spark: SparkSession, path: str, **kw) -> BranchVolumeView:
    return BranchVolumeView(spark, path, "to_date(timestamp)", "date", "transaction_date", **kw)


def hourly_view(spark: SparkSession, path: str, **kw) -> BranchVolumeView:
    return BranchVolumeView(spark, path, "cast(date_trunc('HOUR', timestamp) as timestamp_ntz)", "timestamp_ntz", "hour_start", **kw)


def follow(view: BranchVolumeView, transactions: DataFrame, path: str, first_batch: int = 0, trigger=None) -> int:
    """Apply a stream of transaction changes to the end of its input, as
    batches from ``first_batch`` on; returns the next free batch number."""
    last = [first_batch - 1]

    def write(batch: DataFrame, batch_id: int) -> None:
        view.apply(first_batch + batch_id, transactions=batch)
        last[0] = first_batch + batch_id
    q = (transactions.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(**(trigger or {"availableNow": True}))
         .foreachBatch(write).start())
    q.awaitTermination()
    return last[0] + 1
