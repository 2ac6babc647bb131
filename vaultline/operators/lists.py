"""List and feed operators: filter, newest/first k, enrich.

Each function takes the ``Bank`` tables and returns a lazy DataFrame. The
filter runs before the top-k (one plan), the top-k runs before the
enrichment joins (see ``operators.joins``), and every ORDER BY names its
null order and ends with the primary key so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_of, contains_any, like_any, norm_param, optional_eq, to_char
from .joins import bounded, enrich_customer_name, enrich_customer_name_direct, lookup_by_keys, pin


def _where(df: DataFrame, pred) -> DataFrame:
    return df if pred is None else df.filter(pred)


def _txn_out(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols)


def sorted_small(df: DataFrame, *order) -> DataFrame:
    """Total order of a result bounded by k rows: one partition sorted in
    place. A global ``orderBy`` would add a range exchange and its sampling
    job for at most k rows."""
    return df.coalesce(1).sortWithinPartitions(*order)


def _newest_first_out(df: DataFrame) -> DataFrame:
    """The k output rows back in ORDER BY order (the enrichment join does
    not keep it); the text timestamp sorts like the time it shows."""
    return sorted_small(df, F.col("timestamp").desc_nulls_first(), F.col("id").asc())


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """ORDER BY ... LIMIT k (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


# -- transactions ---------------------------------------------------------

def TXN_COLUMNS():
    return [
        F.col("transaction_id").alias("id"), "account_number", "customer_name",
        F.col("transaction_type").alias("type"), "amount", "currency",
        to_char("timestamp", "YYYY-MM-DD HH24:MI:SS").alias("timestamp"), "status",
        F.col("merchant_name").alias("merchant"), "location", "risk_factor",
    ]


def NEWEST_FIRST():
    return [F.col("timestamp").desc_nulls_first(), F.col("transaction_id").asc()]


def txn_enriched(bank, tx_type=None, risk=None, k: int = 200, search: str | None = None) -> DataFrame:
    """Transactions with customer name, optional type/risk filters, newest k.

    ``search`` is the grid search (id, account, customer, merchant). The
    customer-name part is answered by the accounts whose customer's name
    matches (usually few, so Spark broadcasts them), not by joining every
    transaction to the name map; only the k winners are enriched. When the
    text is part of 'Unknown', transactions without a known customer match
    too, and the whole-table enrichment runs instead (exact either way).
    """
    t = _where(bank.transactions, all_of(optional_eq("transaction_type", tx_type),
                                         optional_eq("risk_factor", risk)))
    if search and search.lower() in "unknown":
        enriched = enrich_all_customer_names(t, bank)
        enriched = enriched.filter(contains_any(["transaction_id", "account_number", "customer_name",
                                                 "merchant_name"], search))
        return _newest_first_out(_txn_out(top_k(enriched, NEWEST_FIRST(), k), TXN_COLUMNS()))
    if search:
        t = own_or_named(t, bank, search)
    top = pin(top_k(t, NEWEST_FIRST(), k))
    return txn_feed(enrich_customer_name(top, bank.accounts, bank.customers, k))


def txn_feed(enriched: DataFrame) -> DataFrame:
    """The columns and order of the transactions list."""
    return _newest_first_out(_txn_out(enriched, TXN_COLUMNS()))


def own_or_named(t: DataFrame, bank, search: str) -> DataFrame:
    """Transactions with the text in a column of their own or in the name of
    their account's customer."""
    named = bank.customers.filter(contains_any(["name"], search)).select("customer_id")
    hits = (bank.accounts.select("account_number", "customer_id").join(named, "customer_id", "left_semi")
            .select("account_number").distinct().withColumn("_name_hit", F.lit(True)))
    own = contains_any(["transaction_id", "account_number", "merchant_name"], search)
    return t.join(hits, "account_number", "left").filter(own | F.col("_name_hit").isNotNull()).drop("_name_hit")


def enrich_all_customer_names(t: DataFrame, bank) -> DataFrame:
    """Whole-table form of the enrichment (no top-k in front): the small
    account->name map is built first, then joined once to the transactions."""
    names = (bank.accounts.select("account_number", "customer_id")
             .join(bank.customers.select("customer_id", "name"), "customer_id", "left")
             .select("account_number", F.col("name").alias("_n")))
    return (t.join(names, "account_number", "left")
            .withColumn("customer_name", F.coalesce(F.col("_n"), F.lit("Unknown"))).drop("_n"))


def recent_activity(bank, k: int = 10) -> DataFrame:
    """Dashboard feed: newest k transactions with customer name."""
    top = pin(top_k(bank.transactions, NEWEST_FIRST(), k))
    return activity_feed(enrich_customer_name(top, bank.accounts, bank.customers, k))


def activity_feed(enriched: DataFrame) -> DataFrame:
    """The columns and order of the dashboard feed."""
    return _newest_first_out(enriched.select(
        F.col("transaction_id").alias("id"), F.col("transaction_type").alias("type"), "customer_name", "amount",
        to_char("timestamp", "YYYY-MM-DD HH24:MI:SS").alias("timestamp"), "status", "risk_factor"))


# -- loans ----------------------------------------------------------------

def loans_list(bank, category=None, rating=None, k: int = 200) -> DataFrame:
    """Loans with customer name, ORDER BY next_due_date ASC NULLS LAST."""
    l = _where(bank.loans, all_of(optional_eq("category", category), optional_eq("risk_rating", rating)))
    top = pin(top_k(l, [F.col("next_due_date").asc_nulls_last(), F.col("loan_id").asc()], k))
    e = enrich_customer_name_direct(top, bank.customers, k)
    return e.select(F.col("loan_id").alias("id"), "customer_id", "customer_name", "category", "amount",
                    "interest_rate", "term_months", "emi", "remaining_balance",
                    to_char("next_due_date", "YYYY-MM-DD").alias("next_due_date"),
                    "status", "risk_rating", "recovered_amount") \
        .transform(lambda d: sorted_small(d, F.col("next_due_date").asc_nulls_last(), F.col("id").asc()))


# -- fraud alerts ---------------------------------------------------------

def fraud_alerts_list(bank, k: int = 200) -> DataFrame:
    top = pin(top_k(bank.fraud_alerts, [F.col("timestamp").desc_nulls_first(), F.col("alert_id").asc()], k))
    e = enrich_customer_name_direct(top, bank.customers, k)
    return e.select(F.col("alert_id").alias("id"), "transaction_id", "customer_name", "amount",
                    F.col("alert_type").alias("type"),
                    to_char("timestamp", "YYYY-MM-DD HH24:MI:SS").alias("timestamp"),
                    "risk_score", "status", "details").transform(_newest_first_out)


def high_risk_alerts(bank, threshold: int = 80) -> DataFrame:
    """Saved query: SELECT * FROM FRAUD_ALERTS WHERE risk_score > 80."""
    return bank.fraud_alerts.filter(F.col("risk_score") > threshold)


# -- accounts -------------------------------------------------------------

def accounts_list(bank, customer_id=None, status=None, k: int = 200) -> DataFrame:
    """Exact-match filters (status is *not* upper-cased), by account number."""
    cid = norm_param(customer_id, upper=False)
    st = norm_param(status, upper=False)
    a = bank.accounts
    a = a if cid is None else a.filter(F.col("customer_id") == cid)
    a = a if st is None else a.filter(F.col("status") == st)
    return top_k(a, [F.col("account_number").asc_nulls_last()], k).select(
        "account_number", "customer_id", F.col("account_type").alias("type"), "balance", "status")


def account_holder_lookup(bank, default: str = "Unknown Customer") -> DataFrame:
    """Every account with its holder's name (client lookup, whole table)."""
    a = bank.accounts
    c = bank.customers.select("customer_id", F.col("name").alias("_n"))
    return (a.join(c, "customer_id", "left")
            .select("account_number", "customer_id", F.coalesce("_n", F.lit(default)).alias("customer_name"),
                    F.col("account_type").alias("type"), "balance", "status"))


# -- branches and records -------------------------------------------------

def branches_list(bank, k: int = 200) -> DataFrame:
    b = bank.branch_performance
    return top_k(b, [F.col("branch_name").asc_nulls_last(), F.col("branch_id").asc()], k).select(
        F.col("branch_id").alias("id"), F.col("branch_name").alias("name"), "city", "manager",
        "customer_count", "active_loans", "total_deposits", "total_revenue",
        "transaction_count", "growth_rate")


def records_list(bank) -> DataFrame:
    """All records, newest first (the reference has no limit here)."""
    return bank.records.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").asc())


# -- customers ------------------------------------------------------------

def CUSTOMER_COLUMNS():
    return [
        F.col("customer_id").alias("id"), "name", "email", "phone", "segment", "lifetime_value",
        F.col("branch_name").alias("branch"), "risk_score",
        to_char("joined_date", "YYYY-MM-DD").alias("joined_date"),
    ]


def customers_page(bank, search: str | None = None, segment=None, k: int = 200) -> DataFrame:
    """Customers filtered by search text and segment, first k by name."""
    c = bank.customers
    s = (search or "").strip()
    if s:
        c = c.filter(like_any(["name", "email"], s))
    c = _where(c, optional_eq("segment", segment))
    return top_k(c, [F.col("name").asc_nulls_last(), F.col("customer_id").asc()], k)


def customer_accounts_flat(bank, search: str | None = None, segment=None, k: int = 200) -> DataFrame:
    """First k customers with their accounts: one row per (customer,
    account), customers without accounts once with NULL account columns. The
    shape is the same however many accounts a customer has.

    The accounts of only those k customers are read (broadcast semi join on
    k ids, replacing the reference's IN list)."""
    top = pin(customers_page(bank, search, segment, k))
    acc = lookup_by_keys(bank.accounts, top, "customer_id", k).select(
        "customer_id", "account_number", F.col("account_type").alias("account_type"),
        F.col("balance"), F.col("status").alias("account_status"))
    return acc.join(bounded(top, k), "customer_id", "right").select(*CUSTOMER_COLUMNS(), "account_number", "account_type",
                                                                    "balance", "account_status")


def customer_accounts_nested(bank, search: str | None = None, segment=None, k: int = 200) -> DataFrame:
    """The flat rows rendered for a page: each customer with the array of its
    accounts ([] if none), always one row per customer."""
    flat = customer_accounts_flat(bank, search, segment, k)
    own = [c for c in flat.columns if c not in ("account_number", "account_type", "balance", "account_status")]
    account = F.when(F.col("account_number").isNotNull(), F.struct(
        "account_number", F.col("account_type").alias("type"), "balance", F.col("account_status").alias("status")))
    return (flat.groupBy(*own).agg(F.sort_array(F.collect_list(account)).alias("accounts"))
            .orderBy(F.col("name").asc_nulls_last(), F.col("id").asc()))


def render_accounts(nested: DataFrame) -> DataFrame:
    """Nested accounts as comparable text: ``num:type:balance:status;...``."""
    txt = F.array_join(F.transform("accounts", lambda a: F.concat_ws(
        ":", a["account_number"], a["type"], a["balance"].cast("string"), a["status"])), ";")
    return nested.withColumn("n_accounts", F.size("accounts").cast("bigint")) \
        .withColumn("accounts", txt)


def customer_search(bank, text: str, k: int = 200) -> DataFrame:
    """LOWER(name) LIKE %s% OR LOWER(email) LIKE %s%, first k by name."""
    return customers_page(bank, text, None, k).select(*CUSTOMER_COLUMNS())


def customer_search_indexed(index, text: str, k: int = 200) -> DataFrame:
    """``customer_search`` on a ``SearchIndex`` of customers (name, email)."""
    return top_k(index.find_like(text), [F.col("name").asc_nulls_last(), F.col("customer_id").asc()], k).select(*CUSTOMER_COLUMNS())


def txn_search_indexed(index, text: str, k: int = 200) -> DataFrame:
    """The grid search on a ``SearchIndex`` of enriched transactions
    (``enrich_all_customer_names``): names are those of the time a row was
    added, so a renamed customer's transactions are added again."""
    return _newest_first_out(_txn_out(top_k(index.find(text), NEWEST_FIRST(), k), TXN_COLUMNS()))


def point_lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Batch form of ``WHERE pk = ?``: semi join on a frame of keys.

    The keys side is not assumed small; Spark picks the join strategy from
    its size (broadcast only under the size threshold, else shuffle)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def in_list_filter(bank, k: int = 200) -> DataFrame:
    """Accounts of the first page of customers (``customer_id IN (...)``)."""
    top = pin(customers_page(bank, None, None, k))
    return lookup_by_keys(bank.accounts, top, "customer_id", k).select(
        "account_number", F.col("account_type").alias("type"), "balance", "status", "customer_id")


# -- management grids -----------------------------------------------------

def _with_holder(df: DataFrame, bank, default: str) -> DataFrame:
    names = bank.customers.select("customer_id", F.col("name").alias("_n"))
    return (df.join(names, "customer_id", "left")
            .withColumn("customer_name", F.coalesce(F.col("_n"), F.lit(default))).drop("_n"))


def management_grid(bank, name: str, search: str | None = None, status: str | None = "ALL",
                    sort: tuple[str, bool] | None = None) -> DataFrame:
    """A management screen over its whole table: case-insensitive substring
    search over the grid's columns (OR), the status filter ANDed to it as an
    exact match ('ALL' for any), then the grid's sort."""
    from . import grid
    rows = {
        "loans": lambda: _with_holder(bank.loans, bank, "Unknown").select(
            "loan_id", "customer_name", "category", "amount", "risk_rating", "status"),
        "branches": lambda: bank.branch_performance.select("branch_id", "branch_name", "city", "manager", "total_deposits"),
        "accounts": lambda: _with_holder(bank.accounts, bank, "Unknown Customer").select(
            "account_number", "customer_id", "customer_name", "account_type", "balance", "status"),
        "transactions": lambda: enrich_all_customer_names(bank.transactions, bank).select(
            "transaction_id", "account_number", "customer_name", "merchant_name", "amount", "timestamp", "status"),
        "fraud_alerts": lambda: _with_holder(bank.fraud_alerts, bank, "Unknown").select(
            "alert_id", "transaction_id", "customer_name", "amount", "alert_type", "risk_score", "status", "details"),
    }[name]()
    if name in grid.GRID_STATUS_FILTER:
        rows = grid.status_filter(rows, status)
    column, ascending = sort or grid.GRID_DEFAULT_SORT[name]
    return grid.grid_sort(grid.grid_search(rows, search, grid.GRID_SEARCH_COLUMNS[name]), column, ascending, grid.GRID_KEY[name])
