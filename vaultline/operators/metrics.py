"""Aggregations of the workload: dashboard, daily/monthly series, rollups.

Money sums are cast to ``decimal(38,2)`` (one declared type for every
engine). Every aggregate here is a hash aggregate with a partial (map-side)
step, so a hot key is combined inside each task before the shuffle. Where a
join feeds an aggregate, the fact table is aggregated on the join key first
and joined afterwards (fewer rows through the join, no fan-out of sums).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dateadd, since, to_char
from .joins import account_branch_map

MONEY_SUM = "decimal(38,2)"


def money_sum(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SUM)


def count_if(pred) -> F.Column:
    return F.count(F.when(pred, F.lit(1)))


def recent(df: DataFrame, ts: str, as_of: str, unit: str, n: int,
           day_partition: str = "transaction_date") -> DataFrame:
    """Rows with ``ts >= DATEADD(unit, -n, as_of)``. On a table partitioned
    by day the implied day predicate (``day >= start``, exact because the
    bound is midnight) is added as well, so the scan prunes partitions."""
    out = df.filter(since(ts, as_of, unit, n))
    if day_partition in df.columns:
        out = out.filter(F.col(day_partition) >= dateadd(unit, -n, F.lit(as_of).cast("date")))
    return out


# -- dashboard ------------------------------------------------------------

def dashboard_summary(bank) -> DataFrame:
    """Eight KPIs, one aggregation pass per table, folded into one row.

    TRANSACTIONS and LOANS are each read once (conditional aggregates), not
    once per KPI as in the eight scalar subqueries of the reference.
    """
    parts = [
        bank.customers.agg(F.count(F.lit(1)).alias("total_customers")),
        bank.accounts.agg(F.count(F.lit(1)).alias("total_accounts")),
        bank.transactions.agg(
            F.count(F.lit(1)).alias("total_transactions"),
            money_sum(F.when(F.col("status") == "COMPLETED", F.col("amount"))).alias("total_revenue"),
            count_if((F.col("risk_factor") == "HIGH") & (F.col("status") == "COMPLETED"))
            .alias("high_risk_transactions")),
        bank.loans.agg(F.count(F.lit(1)).alias("total_loans"),
                       count_if(F.col("status") == "ACTIVE").alias("active_loans")),
        bank.branch_performance.agg(F.count(F.lit(1)).alias("total_branches")),
    ]
    # Each part is one row carrying its own KPIs; stacking them and taking the
    # non-null value per column folds them into the single dashboard row.
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    cols = ["total_customers", "total_accounts", "total_transactions", "total_loans", "total_revenue",
            "total_branches", "active_loans", "high_risk_transactions"]
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def daily_transactions(bank, as_of: str, days: int = 7) -> DataFrame:
    """Count and amount per day for the last ``days`` days (days without
    rows are absent, as in the reference)."""
    t = recent(bank.transactions, "timestamp", as_of, "day", days)
    g = t.groupBy(F.to_date("timestamp").alias("_d")).agg(
        F.count(F.lit(1)).alias("count"), money_sum("amount").alias("amount"))
    return g.select(to_char("_d", "YYYY-MM-DD").alias("date"), "count", "amount").orderBy("date")


def monthly_revenue(bank, as_of: str, months: int = 6) -> DataFrame:
    """Revenue and count per month over the last ``months`` months; all
    statuses count here (the summary counts COMPLETED only)."""
    t = recent(bank.transactions, "timestamp", as_of, "month", months)
    g = t.groupBy(F.trunc(F.to_date("timestamp"), "month").alias("_m")).agg(
        money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("transactions"))
    return g.select(to_char("_m", "YYYY-MM").alias("month"), "revenue", "transactions").orderBy("month")


def daily_branch_volume(bank, transactions: DataFrame | None = None) -> DataFrame:
    """Daily count and amount per branch (the materialized view's query).

    Transactions are first aggregated per (account, day); only those partial
    rows are joined to the account->branch map, then rolled up per
    (day, branch). A hot account collapses to one row per day before any
    shuffle of the join.
    """
    t = transactions if transactions is not None else bank.transactions
    per_acc = t.groupBy("account_number", F.to_date("timestamp").alias("transaction_date")).agg(
        F.count("transaction_id").alias("_n"), F.sum("amount").alias("_s"))
    j = per_acc.join(account_branch_map(bank.accounts, bank.customers), "account_number", "inner")
    return j.groupBy("transaction_date", "branch_name").agg(
        F.sum("_n").cast("bigint").alias("daily_count"), F.sum("_s").cast(MONEY_SUM).alias("daily_amount"))


def daily_branch_join(bank) -> DataFrame:
    """The inner join of the three tables behind the daily view (row level)."""
    t = bank.transactions.select("transaction_id", "account_number", "amount", "timestamp")
    return t.join(account_branch_map(bank.accounts, bank.customers), "account_number", "inner")


def daily_amount(bank) -> DataFrame:
    """Amount per day over TRANSACTIONS alone."""
    return bank.transactions.groupBy(F.to_date("timestamp").alias("transaction_date")).agg(
        money_sum("amount").alias("daily_amount"))


def amount_by_type(bank) -> DataFrame:
    """Saved query ``SELECT SUM(amount), transaction_type ... GROUP BY 2``."""
    spark = bank.spark
    bank.register_views(["transactions"])
    return spark.sql("SELECT CAST(SUM(amount) AS DECIMAL(38,2)) AS total_amount, transaction_type "
                     "FROM transactions GROUP BY 2")


def branch_deposit_task(bank, branch_id: str = "BR-SV", branch_name: str = "Silicon Valley Branch") -> DataFrame:
    """Literal body of the hourly task: SUM(balance) of ACTIVE accounts as one
    branch row. The per-branch form is ``branch_kpi_rollup``."""
    a = bank.accounts.filter(F.col("status") == "ACTIVE")
    return a.agg(F.sum("balance").cast(MONEY_SUM).alias("total_deposits")).select(
        F.lit(branch_id).alias("branch_id"), F.lit(branch_name).alias("branch_name"), "total_deposits")


def customer_deposit_totals(bank, name_text: str) -> DataFrame:
    """Generated query: SUM(amount) of all transaction types per customer
    name, names LIKE %text%, largest first.

    Transactions are aggregated per account before the joins (partial
    aggregation per task). When the name filter is selective and the fact
    is large, Spark's runtime bloom filter on the join
    (``spark.sql.optimizer.runtime.bloomFilter.enabled``) prunes the fact
    rows of other accounts before that aggregation. An explicit semi join
    first would shuffle the whole fact whenever the filter matches many
    customers."""
    per_acc = bank.transactions.groupBy("account_number").agg(F.sum("amount").alias("_s"))
    c = bank.customers.filter(F.lower("name").like(f"%{name_text.lower()}%")).select("customer_id", "name")
    a = bank.accounts.select("account_number", "customer_id")
    j = c.join(a, "customer_id", "inner").join(per_acc, "account_number", "inner")
    return (j.groupBy("name").agg(F.sum("_s").cast(MONEY_SUM).alias("total_deposits"))
            .orderBy(F.col("total_deposits").desc_nulls_first(), F.col("name")))


def credits_month(bank, as_of: str) -> DataFrame:
    """COALESCE(SUM(credits_used), 0) over the last month of the usage log."""
    u = bank.usage_log.filter(since("start_time", as_of, "month", 1))
    return u.agg(F.coalesce(F.sum("credits_used"), F.lit(0)).cast("decimal(38,4)").alias("credit_usage_month"))


def storage_gb_week(bank, as_of: str) -> DataFrame:
    """SUM(bytes)/1024^3 over the last 7 days (a sum of daily values)."""
    s = bank.storage_log.filter(F.col("usage_date") >= F.date_sub(F.lit(as_of).cast("date"), 7))
    # decimal(20,0) / decimal(10,0) keeps 11 decimals, enough for an exact /2^30
    gb = F.coalesce(F.sum("bytes"), F.lit(0)).cast("decimal(20,0)") / F.lit(1024 * 1024 * 1024).cast("decimal(10,0)")
    return s.agg(gb.cast("decimal(38,10)").alias("storage_gb_used"))


# -- re-aimed rollups -----------------------------------------------------

def loan_recovery(bank) -> DataFrame:
    """Recovered share of lent amount by category and rating."""
    g = bank.loans.groupBy("category", "risk_rating").agg(
        F.count(F.lit(1)).alias("loans"),
        F.sum("amount").cast(MONEY_SUM).alias("total_amount"),
        F.sum("recovered_amount").cast(MONEY_SUM).alias("total_recovered"),
        F.sum("remaining_balance").cast(MONEY_SUM).alias("total_remaining"))
    ratio = F.round(F.col("total_recovered").cast("double") / F.col("total_amount").cast("double"), 6)
    return g.withColumn("recovery_rate", ratio.cast("decimal(12,6)"))


def branch_kpi_rollup(bank, as_of: str, days: int = 90) -> DataFrame:
    """Branch KPIs computed from the data, each table aggregated on its own
    key before any join (no fan-out of sums).

    Loans, accounts and transactions become partials per customer, in one
    shape; they are added up per customer and meet the customer -> branch map
    once. The growth rate compares the branch's COMPLETED revenue of the last
    ``days`` days before ``as_of`` with the same span before (percent; 0 if
    that had none).
    """
    names = ["_l", "_d", "_n", "_r", "_now", "_then"]

    def shaped(df, **cols):
        return df.select("customer_id", *[cols.get(c, F.lit(None)).cast("decimal(38,2)").alias(c) for c in names])
    loans = bank.loans.filter(F.col("status") == "ACTIVE").groupBy("customer_id").agg(F.count(F.lit(1)).alias("_l"))
    end = F.lit(as_of).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.col("timestamp"), end)
    done, span = F.col("status") == "COMPLETED", days * 86400
    per_account = bank.transactions.groupBy("account_number").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(done, F.col("amount"))).alias("_r"),
        F.sum(F.when(done & (age >= 0) & (age < span), F.col("amount"))).alias("_now"),
        F.sum(F.when(done & (age >= span) & (age < 2 * span), F.col("amount"))).alias("_then"))
    # an account row carries its own balance and its transactions' partials
    accounts = bank.accounts.select("account_number", "customer_id", F.when(F.col("status") == "ACTIVE", F.col("balance")).alias("_d"))
    acc = accounts.join(per_account, "account_number", "left")
    parts = shaped(loans, _l=F.col("_l")).unionByName(shaped(acc, **{c: F.col(c) for c in ("_d", "_n", "_r", "_now", "_then")}))
    per_customer = parts.groupBy("customer_id").agg(*[F.sum(c).alias(c) for c in names])
    per_branch = (bank.customers.select("customer_id", "branch_name").join(per_customer, "customer_id", "left")
                  .groupBy("branch_name").agg(F.count(F.lit(1)).alias("customer_count"), *[F.sum(c).alias(c) for c in names]))
    out = bank.branch_performance.select("branch_id", "branch_name", "city", "manager").join(per_branch, "branch_name", "left")

    def filled(c, kind, name):
        return F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(name)
    change = (F.coalesce("_now", F.lit(0)).cast("double") - F.col("_then").cast("double")) / F.col("_then").cast("double")
    return out.select(
        "branch_id", "branch_name", "city", "manager", filled("customer_count", "bigint", "customer_count"),
        filled("_l", "bigint", "active_loans"), filled("_d", MONEY_SUM, "total_deposits"),
        filled("_r", MONEY_SUM, "total_revenue"), filled("_n", "bigint", "transaction_count"),
        F.coalesce(F.when(F.col("_then") != 0, F.round(100 * change, 2)), F.lit(0.0)).cast("decimal(12,2)").alias("growth_rate"))
