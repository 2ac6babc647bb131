"""Change batches derived from the driver's tables.

The workload's writes arrive one row at a time over HTTP; the batch jobs
take a DataFrame of changes. These derivations give each job a batch whose
size grows with the data (suppliers onboarded as customers, events posted
as transactions, pending orders as loan applications, ...). They are fixed
values of the registered queries and of the tests; the DuckDB twins live in
``plans.catalog``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Bank, case_map, event_transactions, prefixed


def customers_batch(bank: Bank) -> DataFrame:
    s = bank.raw("supplier")
    return s.select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@supplier.example.com")))
         .alias("email"),
        F.concat(F.lit("+1-555-"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("phone"),
        F.when(F.col("s_acctbal") > 5000, F.lit("GOLD")).alias("segment"),
        F.col("s_acctbal").alias("lifetime_value"),
        F.lit(None).cast("string").alias("branch_name"),
        F.lit(None).cast("int").alias("risk_score"))


def accounts_batch(bank: Bank) -> DataFrame:
    s = bank.raw("supplier")
    return s.select(
        prefixed("SUP", "s_suppkey").alias("account_number"),
        prefixed("CUS", F.col("s_suppkey") * 20).alias("customer_id"),
        F.when(F.col("s_acctbal") < 0, F.lit(None).cast("string")).otherwise(F.lit("SAVINGS")).alias("account_type"),
        F.col("s_acctbal").alias("balance"),
        F.lit(None).cast("string").alias("status"))


def transactions_batch(bank: Bank) -> DataFrame:
    e = bank.raw("events")
    return e.select(
        prefixed("EV", "event_id").alias("source_id"),
        prefixed("ACC", "user_id").alias("account_number"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .otherwise(F.upper("event_type")).alias("transaction_type"),
        F.col("value").alias("amount"),
        F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("merchant_name"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("risk_factor"),
        F.lit(None).cast("string").alias("status"), F.col("ts").alias("change_ts"))


def transaction_changes(bank: Bank) -> DataFrame:
    """Whole-row replacements keyed by transaction id (TX<event_id>)."""
    e = bank.raw("events")
    return e.select(
        prefixed("TX", "event_id").alias("transaction_id"), F.col("event_id").alias("_seq"),
        prefixed("ACC", "user_id").alias("account_number"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .otherwise(F.upper("event_type")).alias("transaction_type"),
        F.col("value").alias("amount"), F.lit("EUR").alias("currency"),
        F.lit(None).cast("string").alias("merchant_name"), F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("risk_factor"),
        F.when(F.col("event_type") == "purchase", F.lit("PENDING")).alias("status"))


def account_changes(bank: Bank) -> DataFrame:
    """Whole-row account replacements: every click event restates account
    ACC<user> (several changes per key; the latest event wins)."""
    e = bank.raw("events").filter(F.col("event_type") == "click")
    return e.select(
        prefixed("ACC", "user_id").alias("account_number"), F.col("event_id").alias("_seq"),
        prefixed("CUS", "user_id").alias("customer_id"),
        F.when(F.col("event_id") % 3 != 0, F.lit("CHECKING")).alias("account_type"),  # else invalid: type missing
        F.col("value").alias("balance"),
        F.when(F.col("value") < 10, F.lit("DORMANT")).alias("status"))


def customer_changes(bank: Bank) -> DataFrame:
    """Whole-row customer replacements from signup events (CUS<user>)."""
    e = bank.raw("events").filter(F.col("event_type") == "signup")
    return e.select(
        prefixed("CUS", "user_id").alias("customer_id"), F.col("event_id").alias("_seq"),
        prefixed("User ", "user_id").alias("name"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")))
         .alias("email"),  # else invalid: email missing
        F.lit(None).cast("string").alias("phone"),
        F.when(F.col("value") > 50, F.lit("GOLD")).alias("segment"),
        F.col("value").alias("lifetime_value"), F.lit(None).cast("string").alias("branch_name"),
        F.lit(None).cast("int").alias("risk_score"))


def loans_batch(bank: Bank) -> DataFrame:
    o = bank.raw("orders").filter(F.col("o_orderstatus") == "P")
    return o.select(
        prefixed("P", "o_orderkey").alias("source_id"),
        prefixed("CUS", "o_custkey").alias("customer_id"),
        case_map(F.col("o_orderpriority"), {"1-URGENT": "HOME", "2-HIGH": "AUTO", "3-MEDIUM": "PERSONAL",
                                            "4-NOT SPECIFIED": "BUSINESS"}, "EDUCATION").alias("category"),
        F.col("o_totalprice").alias("amount"), F.lit(5.5).alias("interest_rate"), F.lit(36).alias("term_months"),
        F.lit(None).cast("double").alias("emi"), F.lit(None).cast("double").alias("remaining_balance"),
        F.lit(None).cast("date").alias("next_due_date"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("risk_rating"), F.lit(None).cast("double").alias("recovered_amount"))


def loan_changes(bank: Bank) -> DataFrame:
    """Loan updates without customer id; due date given for open orders only
    (as text, the way the form sends it)."""
    o = bank.raw("orders")
    return o.select(
        prefixed("LOAN", "o_orderkey").alias("loan_id"), F.col("o_orderkey").alias("_seq"),
        F.lit(None).cast("string").alias("customer_id"), F.lit("PERSONAL").alias("category"),
        F.col("o_totalprice").alias("amount"), F.lit(7.25).alias("interest_rate"), F.lit(48).alias("term_months"),
        F.lit(None).cast("double").alias("emi"), F.lit(None).cast("double").alias("remaining_balance"),
        F.when(F.col("o_orderstatus") == "O", F.date_format(F.date_add(F.to_date("o_orderdate"), 400), "yyyy-MM-dd"))
         .when(F.col("o_orderstatus") == "F", F.lit("null")).alias("next_due_date"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("risk_rating"),
        F.lit(None).cast("double").alias("recovered_amount"))


def branches_batch(bank: Bank) -> DataFrame:
    s = bank.raw("supplier")
    n = bank.raw("nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.concat(F.col("s_name"), F.lit(" Branch")).alias("branch_name"), F.col("n_name").alias("city"),
        prefixed("Manager ", "s_suppkey").alias("manager"),
        F.lit(None).cast("bigint").alias("customer_count"), F.lit(None).cast("bigint").alias("active_loans"),
        F.col("s_acctbal").alias("total_deposits"), F.lit(None).cast("double").alias("total_revenue"),
        F.lit(None).cast("bigint").alias("transaction_count"), F.lit(None).cast("double").alias("growth_rate"))


def branch_changes(bank: Bank) -> DataFrame:
    """Every supplier restates its nation's branch (BR<nation>); those with a
    negative balance leave the manager out (invalid)."""
    s = bank.raw("supplier")
    return s.select(
        prefixed("BR", F.col("s_nationkey") + F.when(F.col("s_suppkey") % 10 == 0, 100).otherwise(0)).alias("branch_id"),
        F.col("s_suppkey").alias("_seq"), F.concat(F.col("s_name"), F.lit(" Branch")).alias("branch_name"),
        prefixed("City ", "s_nationkey").alias("city"),
        F.when(F.col("s_acctbal") >= 0, prefixed("Manager ", "s_suppkey")).alias("manager"),
        F.lit(None).cast("bigint").alias("customer_count"), F.lit(7).cast("bigint").alias("active_loans"),
        F.col("s_acctbal").alias("total_deposits"), F.lit(None).cast("double").alias("total_revenue"),
        F.lit(None).cast("bigint").alias("transaction_count"), F.lit(None).cast("double").alias("growth_rate"))


def alert_changes(bank: Bank) -> DataFrame:
    """Two restatements of every alert: the first confirms it, the second,
    later one lacks the amount (invalid) for every other alert and names an
    unknown customer for every fifth; views name alerts that do not exist."""
    e = bank.raw("events").filter(F.col("event_type").isin("error", "view"))
    two = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    k, late = F.col("event_id"), F.col("turn") == 1
    return two.select(
        prefixed("AL", "event_id").alias("alert_id"), (k * 2 + F.col("turn")).alias("_seq"),
        prefixed("TX", "event_id").alias("transaction_id"),
        F.when(late & (k % 5 == 0), F.lit("CUS-NOPE")).otherwise(prefixed("CUS", F.col("user_id") * 11)).alias("customer_id"),
        F.when(~late | (k % 2 == 0), F.col("value") + F.col("turn")).alias("amount"), F.lit("HIGH_VALUE").alias("alert_type"),
        F.lit(None).cast("int").alias("risk_score"), F.when(~late, F.lit("CONFIRMED")).alias("status"),
        F.lit(None).cast("string").alias("details"))


def alerts_batch(bank: Bank) -> DataFrame:
    e = bank.raw("events").filter(F.col("event_type") == "purchase")
    return e.select(
        prefixed("EV", "event_id").alias("source_id"), prefixed("TX", "event_id").alias("transaction_id"),
        prefixed("CUS", F.col("user_id") * 11).alias("customer_id"), F.col("value").alias("amount"),
        F.lit("HIGH_VALUE").alias("alert_type"), F.lit(None).cast("int").alias("risk_score"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("details"),
        F.col("ts").alias("change_ts"))


def records_batch(bank: Bank) -> DataFrame:
    pages = bank.raw("pages").filter(F.col("url").contains("/en/")).select(
        prefixed("rec-", "page_id").alias("id"), F.col("url").alias("name"),
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.lit("en").alias("details"))
    items = bank.raw("benchmark").select(
        prefixed("rec-b", "item_id").alias("id"), prefixed("item ", "item_id").alias("name"),
        F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("details"))
    return pages.unionByName(items)


def account_change_log(bank: Bank) -> DataFrame:
    """Balance change log of accounts ACC<user>: signup inserts, errors
    delete, every other event updates the balance."""
    return account_changes_from(bank.raw("events"))


def account_changes_from(events: DataFrame) -> DataFrame:
    """The change-log shape over events (batch or streaming)."""
    return events.select(
        prefixed("ACC", "user_id").alias("account_number"),
        case_map(F.col("event_type"), {"signup": "INSERT", "error": "DELETE"}, "UPDATE").alias("op"),
        F.col("value").cast("decimal(15,2)").alias("balance"),
        F.col("ts").alias("change_ts"), F.col("event_id").alias("_seq"))


def transaction_changes_from(events: DataFrame) -> DataFrame:
    """A transaction change log over events (batch or streaming): each event
    inserts its transaction; a signup then doubles its amount, an error deletes it."""
    t = event_transactions(events)
    kind, cols = F.col("transaction_type"), ["transaction_id", "account_number", "timestamp"]

    def change(op, amount, seq):
        return F.struct(F.lit(op).alias("op"), amount.cast("decimal(15,2)").alias("amount"), F.lit(seq).cast("long").alias("_seq"))
    first = change("INSERT", F.col("amount"), 0)
    both = F.when(kind == "SIGNUP", F.array(first, change("UPDATE", F.col("amount") * 2, 1))) \
        .when(kind == "ERROR", F.array(first, change("DELETE", F.lit(None), 1))).otherwise(F.array(first))
    return t.select(*cols, F.explode(both).alias("_c")).select("_c.op", *cols, "_c.amount", F.col("timestamp").alias("change_ts"), "_c._seq")


LOADED_AT, CHANGED_AT = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def account_opening(bank: Bank) -> DataFrame:
    """All accounts as inserts."""
    return _dated(bank.accounts.select(F.lit("INSERT").alias("op"), "account_number", "customer_id"), LOADED_AT)


def account_closing(bank: Bank) -> DataFrame:
    """Dormant accounts as deletes."""
    gone = bank.accounts.where("status = 'DORMANT'")
    return _dated(gone.select(F.lit("DELETE").alias("op"), "account_number", F.lit(None).cast("string").alias("customer_id")), CHANGED_AT)


def customer_opening(bank: Bank) -> DataFrame:
    """All customers as inserts."""
    return _dated(bank.customers.select(F.lit("INSERT").alias("op"), "customer_id", "branch_name"), LOADED_AT)


def customer_moves(bank: Bank) -> DataFrame:
    """Gold customers move to the head office."""
    gold = bank.customers.where("segment = 'GOLD'")
    return _dated(gold.select(F.lit("UPDATE").alias("op"), "customer_id", F.lit("HEAD OFFICE").alias("branch_name")), CHANGED_AT)


def _dated(changes: DataFrame, at: str) -> DataFrame:
    return changes.withColumns({"change_ts": F.lit(at).cast("timestamp_ntz"), "_seq": F.lit(0).cast("long")})
