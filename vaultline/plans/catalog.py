"""The catalog of registered queries (Spark form + oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from .registry import register

# ---------------------------------------------------------------- 2.1 scans

for _name in ("customers", "accounts", "transactions", "loans", "branch_performance",
              "fraud_alerts", "records", "query_log"):
    register(f"scan_{_name}", f"SELECT * FROM {_name}")(lambda b, _n=_name: b.table(_n))

register("scan_table", "SELECT * FROM transactions")(lambda b: b.transactions)

# ---------------------------------------------------------------- 2.3 / 2.6 lists

TXN_SQL_COLS = """t.transaction_id AS id, t.account_number, COALESCE(c.name, 'Unknown') AS customer_name,
 t.transaction_type AS type, t.amount, t.currency, strftime(t.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
 t.status, t.merchant_name AS merchant, t.location, t.risk_factor"""
TXN_SQL_FROM = """FROM transactions t LEFT JOIN accounts a ON t.account_number = a.account_number
 LEFT JOIN customers c ON a.customer_id = c.customer_id"""


@register("recent_activity", f"""
SELECT t.transaction_id AS id, t.transaction_type AS type, COALESCE(c.name, 'Unknown') AS customer_name, t.amount,
 strftime(t.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, t.status, t.risk_factor
{TXN_SQL_FROM}
ORDER BY t.timestamp DESC NULLS FIRST, t.transaction_id LIMIT 10""")
def _recent_activity(b):
    """Dashboard feed: newest 10 transactions with customer name."""
    return lists.recent_activity(b)


@register("txn_enriched", f"""
SELECT {TXN_SQL_COLS} {TXN_SQL_FROM}
WHERE UPPER(t.transaction_type) = 'DEPOSIT'
ORDER BY t.timestamp DESC NULLS FIRST, t.transaction_id LIMIT 200""")
def _txn_enriched(b):
    return lists.txn_enriched(b, tx_type="deposit", risk="ALL")


@register("optional_filter", f"""
SELECT {TXN_SQL_COLS} {TXN_SQL_FROM}
WHERE UPPER(t.transaction_type) = 'TRANSFER' AND UPPER(t.risk_factor) = 'HIGH'
ORDER BY t.timestamp DESC NULLS FIRST, t.transaction_id LIMIT 200""")
def _optional_filter(b):
    return lists.txn_enriched(b, tx_type=" transfer ", risk="high")


@register("grid_search", f"""
SELECT {TXN_SQL_COLS} {TXN_SQL_FROM}
WHERE contains(lower(COALESCE(t.transaction_id, '')), 'merchant 1')
   OR contains(lower(COALESCE(t.account_number, '')), 'merchant 1')
   OR contains(lower(COALESCE(c.name, 'Unknown')), 'merchant 1')
   OR contains(lower(COALESCE(t.merchant_name, '')), 'merchant 1')
ORDER BY t.timestamp DESC NULLS FIRST, t.transaction_id LIMIT 200""")
def _grid_search(b):
    return lists.txn_enriched(b, search="Merchant 1")


def _contains_sql(cols, text):
    return "(" + " OR ".join(f"contains(lower(COALESCE({c}, '')), '{text.lower()}')" for c in cols) + ")"


@register("grid_search_alerts", f"""
SELECT f.alert_id, f.transaction_id, COALESCE(c.name, 'Unknown') AS customer_name, f.amount, f.alert_type, f.risk_score,
 f.status, f.details FROM fraud_alerts f LEFT JOIN customers c ON f.customer_id = c.customer_id
WHERE {_contains_sql(["f.alert_id", "f.transaction_id", "COALESCE(c.name, 'Unknown')", "f.alert_type", "f.details"], "open")}
ORDER BY f.risk_score DESC NULLS LAST, f.alert_id""")
def _grid_search_alerts(b):
    """The text of a status finds nothing by itself: status is a filter, not a searched column."""
    return lists.management_grid(b, "fraud_alerts", "Open")


@register("grid_filter_alerts", f"""
SELECT f.alert_id, f.transaction_id, COALESCE(c.name, 'Unknown') AS customer_name, f.amount, f.alert_type, f.risk_score,
 f.status, f.details FROM fraud_alerts f LEFT JOIN customers c ON f.customer_id = c.customer_id
WHERE {_contains_sql(["f.alert_id", "f.transaction_id", "COALESCE(c.name, 'Unknown')", "f.alert_type", "f.details"], "al1")}
 AND f.status = 'OPEN' ORDER BY f.risk_score DESC NULLS LAST, f.alert_id""")
def _grid_filter_alerts(b):
    return lists.management_grid(b, "fraud_alerts", "AL1", "OPEN")


@register("grid_search_loans", f"""
SELECT l.loan_id, COALESCE(c.name, 'Unknown') AS customer_name, l.category, l.amount, l.risk_rating, l.status
FROM loans l LEFT JOIN customers c ON l.customer_id = c.customer_id
WHERE {_contains_sql(["l.loan_id", "COALESCE(c.name, 'Unknown')", "l.category"], "auto")} ORDER BY l.loan_id""")
def _grid_search_loans(b):
    return lists.management_grid(b, "loans", "Auto")


@register("grid_search_branches", f"""
SELECT branch_id, branch_name, city, manager, total_deposits FROM branch_performance
WHERE {_contains_sql(["branch_name", "city", "manager", "branch_id"], "asia")} ORDER BY branch_name, branch_id""")
def _grid_search_branches(b):
    return lists.management_grid(b, "branches", "aSia")


@register("grid_search_accounts", f"""
SELECT a.account_number, a.customer_id, COALESCE(c.name, 'Unknown Customer') AS customer_name, a.account_type, a.balance, a.status
FROM accounts a LEFT JOIN customers c ON a.customer_id = c.customer_id
WHERE {_contains_sql(["a.account_number", "a.customer_id", "COALESCE(c.name, 'Unknown Customer')"], "cus1")}
 AND a.status = 'ACTIVE' ORDER BY a.account_number""")
def _grid_search_accounts(b):
    return lists.management_grid(b, "accounts", "cus1", "ACTIVE")


@register("grid_search_transactions", f"""
SELECT t.transaction_id, t.account_number, COALESCE(c.name, 'Unknown') AS customer_name, t.merchant_name, t.amount, t.timestamp,
 t.status {TXN_SQL_FROM}
WHERE {_contains_sql(["t.transaction_id", "t.account_number", "COALESCE(c.name, 'Unknown')", "t.merchant_name"], "merchant 3")}
ORDER BY t.timestamp DESC, t.transaction_id""")
def _grid_search_transactions(b):
    return lists.management_grid(b, "transactions", "Merchant 3")


@register("loans_list", """
SELECT l.loan_id AS id, l.customer_id, COALESCE(c.name, 'Unknown') AS customer_name, l.category, l.amount,
 l.interest_rate, l.term_months, l.emi, l.remaining_balance, strftime(l.next_due_date, '%Y-%m-%d') AS next_due_date,
 l.status, l.risk_rating, l.recovered_amount
FROM loans l LEFT JOIN customers c ON l.customer_id = c.customer_id
WHERE UPPER(l.category) = 'HOME'
ORDER BY l.next_due_date ASC NULLS LAST, l.loan_id LIMIT 200""")
def _loans_list(b):
    return lists.loans_list(b, category="home")


@register("fraud_alerts_list", """
SELECT f.alert_id AS id, f.transaction_id, COALESCE(c.name, 'Unknown') AS customer_name, f.amount,
 f.alert_type AS type, strftime(f.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, f.risk_score, f.status, f.details
FROM fraud_alerts f LEFT JOIN customers c ON f.customer_id = c.customer_id
ORDER BY f.timestamp DESC NULLS FIRST, f.alert_id LIMIT 200""")
def _fraud_alerts_list(b):
    return lists.fraud_alerts_list(b)


@register("high_risk_alerts", "SELECT * FROM fraud_alerts WHERE risk_score > 80")
def _high_risk_alerts(b):
    return lists.high_risk_alerts(b)


@register("accounts_list", """
SELECT account_number, customer_id, account_type AS type, balance, status FROM accounts
WHERE status = 'ACTIVE' ORDER BY account_number LIMIT 200""")
def _accounts_list(b):
    return lists.accounts_list(b, status="ACTIVE")


@register("account_holder_lookup", """
SELECT a.account_number, a.customer_id, COALESCE(c.name, 'Unknown Customer') AS customer_name,
 a.account_type AS type, a.balance, a.status
FROM accounts a LEFT JOIN customers c ON a.customer_id = c.customer_id""")
def _account_holder_lookup(b):
    return lists.account_holder_lookup(b)


@register("branches_list", """
SELECT branch_id AS id, branch_name AS name, city, manager, customer_count, active_loans, total_deposits,
 total_revenue, transaction_count, growth_rate
FROM branch_performance ORDER BY branch_name NULLS LAST, branch_id LIMIT 200""")
def _branches_list(b):
    return lists.branches_list(b)


@register("records_list", "SELECT * FROM records ORDER BY created_at DESC NULLS FIRST, id")
def _records_list(b):
    return lists.records_list(b)


CUST_SQL_COLS = """customer_id AS id, name, email, phone, segment, lifetime_value, branch_name AS branch,
 risk_score, strftime(joined_date, '%Y-%m-%d') AS joined_date"""


@register("customer_search", f"""
SELECT {CUST_SQL_COLS} FROM customers
WHERE LOWER(name) LIKE '%er#0000001%' OR LOWER(email) LIKE '%er#0000001%'
ORDER BY name NULLS LAST, customer_id LIMIT 200""")
def _customer_search(b):
    return lists.customer_search(b, "eR#0000001")


@register("customer_accounts_nested", f"""
WITH top AS (
  SELECT * FROM customers WHERE UPPER(segment) = 'GOLD' ORDER BY name NULLS LAST, customer_id LIMIT 200)
SELECT t.customer_id AS id, t.name, t.email, t.phone, t.segment, t.lifetime_value, t.branch_name AS branch,
 t.risk_score, strftime(t.joined_date, '%Y-%m-%d') AS joined_date,
 COALESCE(string_agg(a.account_number || ':' || a.account_type || ':' || CAST(a.balance AS VARCHAR) || ':' || a.status,
   ';' ORDER BY a.account_number, a.account_type, a.balance, a.status), '') AS accounts,
 CAST(count(a.account_number) AS BIGINT) AS n_accounts
FROM top t LEFT JOIN accounts a ON a.customer_id = t.customer_id
GROUP BY ALL""")
def _customer_accounts_nested(b):
    return lists.render_accounts(lists.customer_accounts_nested(b, segment="gold"))


@register("customer_accounts_flat", f"""
WITH top AS (
  SELECT * FROM customers WHERE UPPER(segment) = 'GOLD' ORDER BY name NULLS LAST, customer_id LIMIT 200)
SELECT t.customer_id AS id, t.name, t.email, t.phone, t.segment, t.lifetime_value, t.branch_name AS branch,
 t.risk_score, strftime(t.joined_date, '%Y-%m-%d') AS joined_date, a.account_number, a.account_type, a.balance,
 a.status AS account_status
FROM top t LEFT JOIN accounts a ON a.customer_id = t.customer_id""")
def _customer_accounts_flat(b):
    """The same page in its fixed shape: one row per customer and account."""
    return lists.customer_accounts_flat(b, segment="gold")


@register("in_list_filter", """
WITH top AS (SELECT customer_id FROM customers ORDER BY name NULLS LAST, customer_id LIMIT 200)
SELECT a.account_number, a.account_type AS type, a.balance, a.status, a.customer_id
FROM accounts a WHERE a.customer_id IN (SELECT customer_id FROM top)""")
def _in_list_filter(b):
    return lists.in_list_filter(b)


@register("point_lookup", """
SELECT * FROM transactions WHERE transaction_id IN (SELECT transaction_id FROM fraud_alerts)""")
def _point_lookup(b):
    """Batch point lookup: the transactions named by fraud alerts."""
    return lists.point_lookup(b.transactions, b.fraud_alerts, "transaction_id")


@register("top_k", """
SELECT transaction_id, account_number, amount FROM transactions
ORDER BY amount DESC NULLS FIRST, transaction_id LIMIT 50""")
def _top_k(b):
    return lists.top_k(b.transactions, [F.col("amount").desc_nulls_first(), F.col("transaction_id")], 50) \
        .select("transaction_id", "account_number", "amount")


def flagship(spark, sf_dir):
    """The minimum slice: scan three tables, two left joins, top 10."""
    from ..sources.tables import Bank
    return lists.recent_activity(Bank(spark, sf_dir))


# ---------------------------------------------------------------- 2.4 aggregations
from ..operators import metrics  # noqa: E402
from .registry import AS_OF_EVENTS, AS_OF_TXN  # noqa: E402


@register("dashboard_summary", """
SELECT (SELECT COUNT(*) FROM customers) AS total_customers,
 (SELECT COUNT(*) FROM accounts) AS total_accounts,
 (SELECT COUNT(*) FROM transactions) AS total_transactions,
 (SELECT COUNT(*) FROM loans) AS total_loans,
 (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(38,2)) FROM transactions WHERE status = 'COMPLETED') AS total_revenue,
 (SELECT COUNT(*) FROM branch_performance) AS total_branches,
 (SELECT COUNT(*) FROM loans WHERE status = 'ACTIVE') AS active_loans,
 (SELECT COUNT(*) FROM transactions WHERE risk_factor = 'HIGH' AND status = 'COMPLETED') AS high_risk_transactions""")
def _dashboard_summary(b):
    return metrics.dashboard_summary(b)


@register("status_predicates", """
SELECT * FROM transactions WHERE risk_factor = 'HIGH' AND status = 'COMPLETED'""")
def _status_predicates(b):
    return b.transactions.filter((F.col("risk_factor") == "HIGH") & (F.col("status") == "COMPLETED"))


@register("daily_transactions", f"""
SELECT strftime(timestamp, '%Y-%m-%d') AS date, COUNT(*) AS count, CAST(COALESCE(SUM(amount), 0) AS DECIMAL(38,2)) AS amount
FROM transactions WHERE timestamp >= CAST(DATE '{AS_OF_TXN}' - INTERVAL 7 DAY AS TIMESTAMP)
GROUP BY 1 ORDER BY 1""")
def _daily_transactions(b):
    return metrics.daily_transactions(b, AS_OF_TXN)


@register("monthly_revenue", f"""
SELECT strftime(timestamp, '%Y-%m') AS month, CAST(COALESCE(SUM(amount), 0) AS DECIMAL(38,2)) AS revenue,
 COUNT(*) AS transactions
FROM transactions WHERE timestamp >= CAST(DATE '{AS_OF_TXN}' - INTERVAL 6 MONTH AS TIMESTAMP)
GROUP BY 1 ORDER BY 1""")
def _monthly_revenue(b):
    return metrics.monthly_revenue(b, AS_OF_TXN)


@register("relative_time_filter", f"""
SELECT * FROM transactions WHERE timestamp >= CAST(DATE '{AS_OF_TXN}' - INTERVAL 1 MONTH AS TIMESTAMP)""")
def _relative_time_filter(b):
    from ..functions.scalars import since
    return b.transactions.filter(since("timestamp", AS_OF_TXN, "month", 1))


DAILY_BRANCH_SQL = """
SELECT CAST(t.timestamp AS DATE) AS transaction_date, c.branch_name, COUNT(t.transaction_id) AS daily_count,
 CAST(SUM(t.amount) AS DECIMAL(38,2)) AS daily_amount
FROM transactions t JOIN accounts a ON t.account_number = a.account_number
JOIN customers c ON a.customer_id = c.customer_id GROUP BY 1, 2"""


@register("daily_branch_volume", DAILY_BRANCH_SQL)
def _daily_branch_volume(b):
    return metrics.daily_branch_volume(b)


@register("daily_branch_join", """
SELECT t.transaction_id, t.account_number, t.amount, t.timestamp, c.branch_name
FROM transactions t JOIN accounts a ON t.account_number = a.account_number
JOIN customers c ON a.customer_id = c.customer_id""")
def _daily_branch_join(b):
    return metrics.daily_branch_join(b)


@register("daily_amount", """
SELECT CAST(timestamp AS DATE) AS transaction_date, CAST(COALESCE(SUM(amount), 0) AS DECIMAL(38,2)) AS daily_amount
FROM transactions GROUP BY 1""")
def _daily_amount(b):
    return metrics.daily_amount(b)


@register("amount_by_type", """
SELECT CAST(SUM(amount) AS DECIMAL(38,2)) AS total_amount, transaction_type FROM transactions GROUP BY 2""")
def _amount_by_type(b):
    return metrics.amount_by_type(b)


@register("branch_deposit_task", """
SELECT 'BR-SV' AS branch_id, 'Silicon Valley Branch' AS branch_name, CAST(SUM(balance) AS DECIMAL(38,2)) AS total_deposits
FROM accounts WHERE status = 'ACTIVE'""")
def _branch_deposit_task(b):
    return metrics.branch_deposit_task(b)


@register("customer_deposit_totals", """
SELECT c.name, CAST(SUM(t.amount) AS DECIMAL(38,2)) AS total_deposits FROM customers c
JOIN accounts a ON c.customer_id = a.customer_id JOIN transactions t ON a.account_number = t.account_number
WHERE LOWER(c.name) LIKE '%customer#00000%' GROUP BY c.name ORDER BY total_deposits DESC""")
def _customer_deposit_totals(b):
    return metrics.customer_deposit_totals(b, "Customer#00000")


@register("credits_month", f"""
SELECT CAST(COALESCE(SUM(credits_used), 0) AS DECIMAL(38,4)) AS credit_usage_month FROM usage_log
WHERE start_time >= CAST(DATE '{AS_OF_EVENTS}' - INTERVAL 1 MONTH AS TIMESTAMP)""")
def _credits_month(b):
    return metrics.credits_month(b, AS_OF_EVENTS)


@register("storage_gb_week", f"""
SELECT CAST(CAST(COALESCE(SUM(bytes), 0) AS DECIMAL(38,0)) / 1073741824 AS DECIMAL(38,10)) AS storage_gb_used
FROM storage_log WHERE usage_date >= DATE '{AS_OF_EVENTS}' - INTERVAL 7 DAY""")
def _storage_gb_week(b):
    return metrics.storage_gb_week(b, AS_OF_EVENTS)


@register("loan_recovery", """
SELECT category, risk_rating, COUNT(*) AS loans, CAST(SUM(amount) AS DECIMAL(38,2)) AS total_amount,
 CAST(SUM(recovered_amount) AS DECIMAL(38,2)) AS total_recovered,
 CAST(SUM(remaining_balance) AS DECIMAL(38,2)) AS total_remaining,
 CAST(ROUND(CAST(SUM(recovered_amount) AS DOUBLE) / CAST(SUM(amount) AS DOUBLE), 6) AS DECIMAL(12,6)) AS recovery_rate
FROM loans GROUP BY 1, 2""")
def _loan_recovery(b):
    return metrics.loan_recovery(b)


@register("branch_kpi_rollup", f"""
WITH cpb AS (SELECT branch_name, COUNT(*) AS customer_count FROM customers GROUP BY 1),
lpb AS (SELECT c.branch_name, COUNT(*) AS active_loans FROM loans l JOIN customers c ON l.customer_id = c.customer_id
        WHERE l.status = 'ACTIVE' GROUP BY 1),
dpb AS (SELECT c.branch_name, SUM(a.balance) AS total_deposits FROM accounts a JOIN customers c ON a.customer_id = c.customer_id
        WHERE a.status = 'ACTIVE' GROUP BY 1),
tpb AS (SELECT c.branch_name, COUNT(*) AS transaction_count,
        SUM(CASE WHEN t.status = 'COMPLETED' THEN t.amount END) AS total_revenue,
        SUM(CASE WHEN t.status = 'COMPLETED' AND s >= 0 AND s < {90 * 86400} THEN t.amount END) AS rev_now,
        SUM(CASE WHEN t.status = 'COMPLETED' AND s >= {90 * 86400} AND s < {180 * 86400} THEN t.amount END) AS rev_then
        FROM (SELECT *, date_diff('second', timestamp, TIMESTAMP '{AS_OF_TXN}') AS s FROM transactions) t
        JOIN accounts a ON t.account_number = a.account_number
        JOIN customers c ON a.customer_id = c.customer_id GROUP BY 1)
SELECT b.branch_id, b.branch_name, b.city, b.manager,
 CAST(COALESCE(ROUND(100 * (CAST(COALESCE(rev_now, 0) AS DOUBLE) - CAST(rev_then AS DOUBLE)) / CAST(NULLIF(rev_then, 0) AS DOUBLE), 2), 0)
  AS DECIMAL(12,2)) AS growth_rate,
 CAST(COALESCE(cpb.customer_count, 0) AS BIGINT) AS customer_count,
 CAST(COALESCE(lpb.active_loans, 0) AS BIGINT) AS active_loans,
 CAST(COALESCE(dpb.total_deposits, 0) AS DECIMAL(38,2)) AS total_deposits,
 CAST(COALESCE(tpb.total_revenue, 0) AS DECIMAL(38,2)) AS total_revenue,
 CAST(COALESCE(tpb.transaction_count, 0) AS BIGINT) AS transaction_count
FROM branch_performance b LEFT JOIN cpb ON b.branch_name = cpb.branch_name
LEFT JOIN lpb ON b.branch_name = lpb.branch_name LEFT JOIN dpb ON b.branch_name = dpb.branch_name
LEFT JOIN tpb ON b.branch_name = tpb.branch_name""")
def _branch_kpi_rollup(b):
    return metrics.branch_kpi_rollup(b, AS_OF_TXN)


# ---------------------------------------------------------------- 2.6 grid
from ..operators import grid  # noqa: E402
from ..functions import scalars as S  # noqa: E402


@register("grid_sort", """
SELECT customer_id, name, segment FROM customers ORDER BY name DESC NULLS LAST, customer_id""")
def _grid_sort(b):
    return grid.grid_sort(b.customers.select("customer_id", "name", "segment"), "name", False, "customer_id")


@register("grid_page_after", """
SELECT alert_id, customer_id, alert_type, risk_score, status FROM fraud_alerts
WHERE risk_score < 50 OR (risk_score = 50 AND alert_id > 'AL2')
ORDER BY risk_score DESC NULLS LAST, alert_id LIMIT 6""")
def _grid_page_after(b):
    """The page behind a row, at any depth: no offset."""
    a = b.fraud_alerts.select("alert_id", "customer_id", "alert_type", "risk_score", "status")
    return grid.grid_page_after(a, "risk_score", False, "alert_id", 50, "AL2")


@register("grid_page", """
SELECT alert_id, customer_id, alert_type, risk_score, status FROM fraud_alerts
ORDER BY risk_score DESC NULLS LAST, alert_id LIMIT 6 OFFSET 12""")
def _grid_page(b):
    a = b.fraud_alerts.select("alert_id", "customer_id", "alert_type", "risk_score", "status")
    return grid.grid_page(a, "risk_score", False, 3, "alert_id")


@register("grid_page_last", """
SELECT customer_id, name, segment FROM customers ORDER BY name DESC NULLS LAST, customer_id
LIMIT 6 OFFSET (SELECT CAST((greatest(COUNT(*), 1) - 1) // 6 * 6 AS BIGINT) FROM customers)""")
def _grid_page_last(b):
    """The last page of a table, without an offset."""
    c = b.customers.select("customer_id", "name", "segment")
    return grid.grid_page(c, "name", False, grid.grid_page_count(c).first().pages, "customer_id")


@register("grid_page_count", """
SELECT COUNT(*) AS rows, CAST(greatest(ceil(COUNT(*) / 6), 1) AS BIGINT) AS pages
FROM loans WHERE UPPER(category) = 'AUTO'""")
def _grid_page_count(b):
    return grid.grid_page_count(b.loans.filter(F.upper("category") == "AUTO"))


@register("multi_key_sort", """
SELECT user_name, role_name, query_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time FROM query_log
ORDER BY user_name, role_name, query_id LIMIT 100""")
def _multi_key_sort(b):
    q = b.query_log.select("user_name", "role_name", "query_id", S.to_char("start_time", "YYYY-MM-DD HH24:MI:SS")
                           .alias("start_time"))
    return q.orderBy("user_name", "role_name", "query_id").limit(100)


# ---------------------------------------------------------------- 2.2 projections
@register("project_alias", """
SELECT customer_id AS id, name, email, phone, segment, lifetime_value, branch_name AS branch, risk_score,
 strftime(joined_date, '%Y-%m-%d') AS joined_date FROM customers""")
def _project_alias(b):
    from ..operators.lists import CUSTOMER_COLUMNS
    return b.customers.select(*CUSTOMER_COLUMNS())


# ---------------------------------------------------------------- 2.8 scalar functions
def _fn(name, sql_cols, table, spark_cols):
    register(name, f"SELECT {sql_cols} FROM {table}")(lambda b: b.table(table).select(*spark_cols()))


_fn("fn_coalesce", "transaction_id, COALESCE(merchant_name, 'Unknown') AS merchant", "transactions",
    lambda: ["transaction_id", F.coalesce("merchant_name", F.lit("Unknown")).alias("merchant")])
_fn("fn_upper_lower", "customer_id, UPPER(name) AS name_upper, LOWER(email) AS email_lower", "customers",
    lambda: ["customer_id", F.upper("name").alias("name_upper"), F.lower("email").alias("email_lower")])
_fn("fn_like", "customer_id, LOWER(email) LIKE '%.00000001_@%' AS matches", "customers",
    lambda: ["customer_id", F.lower("email").like("%.00000001_@%").alias("matches")])
_fn("fn_concat", "customer_id, name || ' / ' || phone AS contact, concat(name, ' <', email, '>') AS mailbox",
    "customers",
    lambda: ["customer_id", F.concat("name", F.lit(" / "), "phone").alias("contact"),
             F.concat("name", F.lit(" <"), "email", F.lit(">")).alias("mailbox")])
_fn("fn_right", "customer_id, right(phone, 4) AS last4, right(segment, 40) AS whole", "customers",
    lambda: ["customer_id", F.right("phone", F.lit(4)).alias("last4"), F.right("segment", F.lit(40)).alias("whole")])
_fn("fn_regexp_replace",
    "customer_id, regexp_replace(name, '^(.).*(.)$', '\\1*****\\2') AS masked_name, "
    "regexp_replace(email, '(?i)^[A-Z0-9._%+-]+@', '*****@') AS masked_email, "
    "regexp_replace(phone, '^[0-9]*([0-9]{4})$', '***-***-\\1') AS masked_phone", "customers",
    lambda: ["customer_id", S.mask_name("name").alias("masked_name"), S.mask_email("email").alias("masked_email"),
             S.mask_digits_keep_last4("phone").alias("masked_phone")])
_fn("fn_trim", "customer_id, trim('  ' || name || ' ') AS name", "customers",
    lambda: ["customer_id", F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("name")])
_fn("fn_digits_only",
    "customer_id, CASE WHEN regexp_replace('+1-' || phone, '[^0-9]', '', 'g') = '' THEN NULL "
    "ELSE regexp_replace('+1-' || phone, '[^0-9]', '', 'g') END AS phone_digits", "customers",
    lambda: ["customer_id", S.digits_only(F.concat(F.lit("+1-"), "phone")).alias("phone_digits")])
_fn("fn_to_char",
    "transaction_id, strftime(timestamp, '%Y-%m-%d') AS d, strftime(timestamp, '%Y-%m') AS m, "
    "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts", "transactions",
    lambda: ["transaction_id", S.to_char("timestamp", "YYYY-MM-DD").alias("d"),
             S.to_char("timestamp", "YYYY-MM").alias("m"),
             S.to_char("timestamp", "YYYY-MM-DD HH24:MI:SS").alias("ts")])
_fn("fn_to_date",
    "loan_id, CAST(strptime(strftime(next_due_date, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS due", "loans",
    lambda: ["loan_id", S.to_date_fmt(S.to_char("next_due_date", "YYYY-MM-DD"), "YYYY-MM-DD").alias("due")])
_fn("fn_dateadd",
    "transaction_id, CAST(CAST(timestamp AS DATE) + INTERVAL 7 DAY AS DATE) AS plus_week, "
    "CAST(CAST(timestamp AS DATE) - INTERVAL 6 MONTH AS DATE) AS minus_6_months, "
    "timestamp - INTERVAL 600 MINUTE AS minus_600_minutes", "transactions",
    lambda: ["transaction_id", S.dateadd("day", 7, F.to_date("timestamp")).alias("plus_week"),
             S.dateadd("month", -6, F.to_date("timestamp")).alias("minus_6_months"),
             S.dateadd("minute", -600, "timestamp").alias("minus_600_minutes")])
_fn("fn_trunc_day", "transaction_id, CAST(timestamp AS DATE) AS day", "transactions",
    lambda: ["transaction_id", S.trunc_day("timestamp").alias("day")])
_fn("fn_case",
    "query_id, CASE WHEN role_name IN ('BANKING_ADMIN', 'BANKING_DATA_ENGINEER') THEN 'FULL' ELSE 'MASKED' END AS access",
    "query_log",
    lambda: ["query_id", F.when(F.col("role_name").isin("BANKING_ADMIN", "BANKING_DATA_ENGINEER"), "FULL")
             .otherwise("MASKED").alias("access")])
_fn("fn_in", "customer_id, segment IN ('GOLD', 'PLATINUM') AS premium", "customers",
    lambda: ["customer_id", F.col("segment").isin("GOLD", "PLATINUM").alias("premium")])
_fn("fn_arith",
    "query_id, CAST(CAST(total_elapsed_time AS DECIMAL(20,3)) / 1000 AS DECIMAL(20,3)) AS elapsed_s", "query_log",
    lambda: ["query_id", (F.col("total_elapsed_time").cast("decimal(20,3)") / 1000).cast("decimal(20,3)")
             .alias("elapsed_s")])
_fn("fn_estimated_tax", "transaction_id, CAST(amount * 0.15 AS DECIMAL(20,4)) AS estimated_tax", "transactions",
    lambda: ["transaction_id", (F.col("amount") * F.lit(0.15).cast("decimal(3,2)")).cast("decimal(20,4)")
             .alias("estimated_tax")])
_fn("fn_cast_number", "loan_id, CAST(amount AS DOUBLE) AS amount, CAST(term_months AS DOUBLE) AS term", "loans",
    lambda: ["loan_id", F.col("amount").cast("double").alias("amount"), F.col("term_months").cast("double")
             .alias("term")])


def _usd_sql(x, d):
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN round({x}, {d}) < 0 "
            f"THEN '-$' || format('{{:,.{d}f}}', CAST(abs(round({x}, {d})) AS DOUBLE)) "
            f"ELSE '$' || format('{{:,.{d}f}}', CAST(abs(round({x}, {d})) AS DOUBLE)) END")


_fn("fn_format_usd", f"customer_id, {_usd_sql('lifetime_value', 0)} AS ltv_text, "
    f"{_usd_sql('lifetime_value', 2)} AS ltv_cents", "customers",
    lambda: ["customer_id", S.format_usd("lifetime_value", 0).alias("ltv_text"),
             S.format_usd("lifetime_value", 2).alias("ltv_cents")])
_fn("fn_signed_amount",
    "transaction_id, CASE WHEN transaction_type = 'DEPOSIT' THEN amount ELSE -amount END AS signed_amount",
    "transactions", lambda: ["transaction_id", S.signed_amount("amount", "transaction_type").alias("signed_amount")])
_fn("fn_risk_band_customer",
    "customer_id, CASE WHEN risk_score > 75 THEN 'HIGH' WHEN risk_score > 40 THEN 'MEDIUM' ELSE 'LOW' END AS band",
    "customers", lambda: ["customer_id", S.risk_band_customer("risk_score").alias("band")])
_fn("fn_risk_band_alert",
    "alert_id, CASE WHEN risk_score >= 75 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band",
    "fraud_alerts", lambda: ["alert_id", S.risk_band_alert("risk_score").alias("band")])
_fn("fn_growth_sign", "branch_id, CASE WHEN growth_rate >= 0 THEN 'UP' ELSE 'DOWN' END AS trend",
    "branch_performance", lambda: ["branch_id", S.growth_sign("growth_rate").alias("trend")])
_fn("fn_default",
    "transaction_id, COALESCE(NULLIF(merchant_name, ''), 'N/A') AS merchant, COALESCE(NULLIF(status, ''), 'COMPLETED') AS status",
    "transactions",
    lambda: ["transaction_id", S.default_if_blank("merchant_name", "N/A").alias("merchant"),
             S.default_if_blank("status", "COMPLETED").alias("status")])


@register("fn_now", """
SELECT id, true AS today_is_now, updated_at IS NOT NULL AS kept_stored, true AS default_is_now, created_at AS stored_wins FROM records""")
def _fn_now(b):
    """CURRENT_DATE / CURRENT_TIMESTAMP defaults, as facts that hold at any
    time: today is the date of now, a stored value is kept, a missing one
    becomes now."""
    now = F.localtimestamp()
    filled = F.coalesce("updated_at", now)
    return b.records.select(
        "id", (F.current_date() == F.to_date(now)).alias("today_is_now"), F.col("updated_at").isNotNull().alias("kept_stored"),
        F.when(F.col("updated_at").isNull(), filled == now).otherwise(filled == F.col("updated_at")).alias("default_is_now"),
        F.coalesce("created_at", now).alias("stored_wins"))


# ---------------------------------------------------------------- 2.11 governance
from ..operators import governance as G  # noqa: E402
from . import workspace as W  # noqa: E402


@register("secure_customer_view", """
SELECT customer_id, regexp_replace(name, '^(.).*(.)$', '\\1*****\\2') AS masked_name,
 regexp_replace(email, '(?i)^[A-Z0-9._%+-]+@', '*****@') AS masked_email, segment, lifetime_value, branch_name,
 risk_score, joined_date FROM customers""")
def _secure_customer_view(b):
    return G.secure_customer_view(b.customers)


@register("mask_phone", """
SELECT customer_id, name, '***-***-' || right(phone, 4) AS phone FROM customers""")
def _mask_phone(b):
    return G.apply_phone_mask(b.customers.select("customer_id", "name", "phone"), "BANKING_ANALYST")


@register("mask_ssn", """
SELECT customer_id, '***-**-' || right(phone, 4) AS phone FROM customers""")
def _mask_ssn(b):
    """SSN policy (prefix ***-**-, roles ADMIN/COMPLIANCE) on the only national
    number column of the data, for a role outside the list."""
    return G.apply_ssn_mask(b.customers.select("customer_id", "phone"), "BANKING_ANALYST", "phone")


USER_BRANCHES_SQL = """(SELECT DISTINCT q.user_name, c.branch_name FROM query_log q
  JOIN customers c ON c.customer_id = 'CUS' || substr(q.user_name, 2))"""


def _user_branches(b):
    """user -> branch: user u<k> works at the branch of customer CUS<k>."""
    users = b.query_log.select("user_name").distinct()
    c = b.customers.select("customer_id", "branch_name")
    return users.join(c, F.concat(F.lit("CUS"), F.substring("user_name", 2, 100)) == c.customer_id, "inner") \
        .select("user_name", "branch_name").distinct()


@register("row_policy", f"""
SELECT * FROM customers WHERE branch_name IN (SELECT branch_name FROM {USER_BRANCHES_SQL} ub WHERE user_name = 'u7')""")
def _row_policy(b):
    return G.row_policy(b.customers, "BANKING_ANALYST", "branch_name", user="u7", user_branches=_user_branches(b))


ROLE_CLOSURE_SQL = """
WITH RECURSIVE edges(child, parent) AS (VALUES ('BANKING_BUSINESS_USER', 'BANKING_ANALYST'),
  ('BANKING_ANALYST', 'BANKING_DATA_ENGINEER'), ('BANKING_DATA_ENGINEER', 'BANKING_ADMIN'), ('BANKING_ADMIN', 'SYSADMIN')),
closure(role, effective_role, depth) AS (
  SELECT child, child, 0 FROM edges UNION SELECT parent, parent, 0 FROM edges
  UNION ALL SELECT c.role, e.parent, c.depth + 1 FROM closure c JOIN edges e ON c.effective_role = e.child)
SELECT u.user_name, u.role_name, c.effective_role, c.depth
FROM (SELECT DISTINCT user_name, role_name FROM query_log) u JOIN closure c ON c.role = u.role_name"""


@register("role_closure", ROLE_CLOSURE_SQL)
def _role_closure(b):
    return G.effective_roles(b.query_log, G.role_closure(b.spark))


@register("roles_report", """
WITH parents(role, parent) AS (VALUES ('BANKING_BUSINESS_USER', 'BANKING_ANALYST'),
  ('BANKING_ANALYST', 'BANKING_DATA_ENGINEER'), ('BANKING_DATA_ENGINEER', 'BANKING_ADMIN'), ('BANKING_ADMIN', 'SYSADMIN'))
SELECT q.role_name AS role, p.parent, COUNT(DISTINCT q.user_name) AS users_count, COUNT(*) AS queries_count
FROM query_log q LEFT JOIN parents p ON p.role = q.role_name GROUP BY q.role_name, p.parent
ORDER BY role LIMIT 50""")
def _roles_report(b):
    return G.roles_report(b.query_log, b.spark)


@register("query_history", f"""
SELECT query_id AS id, query_text, user_name AS user, role_name AS role,
 strftime(start_time, '%Y-%m-%d %H:%M:%S') AS timestamp, total_elapsed_time AS duration_ms,
 CAST(CAST(total_elapsed_time AS DECIMAL(20,3)) / 1000 AS DECIMAL(20,3)) AS duration_s, execution_status AS status
FROM query_log WHERE start_time >= CAST(DATE '{AS_OF_EVENTS}' - INTERVAL 7 DAY AS TIMESTAMP)
ORDER BY start_time DESC NULLS FIRST, query_id LIMIT 20""")
def _query_history(b):
    return G.query_history(b.query_log, AS_OF_EVENTS)


GUARD_SQL = """CASE WHEN role_name = 'BANKING_BUSINESS_USER' THEN false
 WHEN role_name = 'BANKING_ANALYST' THEN
  (upper(trim(regexp_replace(trim(query_text), '^/\\*[\\s\\S]*?\\*/', ''))) LIKE 'SELECT%'
   OR upper(trim(regexp_replace(trim(query_text), '^/\\*[\\s\\S]*?\\*/', ''))) LIKE 'SHOW%')
 ELSE true END"""


@register("read_only_guard", f"""
SELECT query_id, role_name, query_text, {GUARD_SQL} AS allowed FROM query_log""")
def _read_only_guard(b):
    return b.query_log.select("query_id", "role_name", "query_text",
                              G.read_only_guard("role_name", "query_text").alias("allowed"))


@register("access_audit", f"""
WITH v AS (SELECT *, upper(regexp_extract(trim(regexp_replace(trim(query_text), '^/\\*[\\s\\S]*?\\*/', '')),
   '^([A-Za-z]+)', 1)) AS verb FROM query_log),
a AS (SELECT *, CASE verb WHEN 'SELECT' THEN 'read' WHEN 'SHOW' THEN 'read' WHEN 'INSERT' THEN 'create'
   WHEN 'UPDATE' THEN 'update' WHEN 'MERGE' THEN 'update' WHEN 'DELETE' THEN 'delete' ELSE 'update' END AS action FROM v)
SELECT role_name, action, 'sql' AS resource, query_id, user_name, query_text,
 CASE WHEN role_name = 'BANKING_ADMIN' THEN true
      WHEN role_name = 'BANKING_DATA_ENGINEER' THEN action <> 'delete'
      WHEN role_name = 'BANKING_ANALYST' THEN action = 'read'
      ELSE false END AS permitted,
 {GUARD_SQL} AS guard_allowed
FROM a""")
def _access_audit(b):
    return G.access_audit(b.query_log, b.spark)


@register("sql_workspace", """
SELECT transaction_type, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(38,2)) AS total FROM transactions
WHERE status = 'COMPLETED' AND amount > 1000 GROUP BY transaction_type""")
def _sql_workspace(b):
    return W.sql_workspace(b, "SELECT transaction_type, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(38,2)) AS total "
                              "FROM transactions WHERE status = ? AND amount > ? GROUP BY transaction_type;",
                           ["COMPLETED", 1000], role="BANKING_ANALYST")


@register("udf_estimated_tax", """
SELECT transaction_id, CAST(amount AS DOUBLE) * 0.15 AS estimated_tax FROM transactions""")
def _udf_estimated_tax(b):
    b = b.isolated()
    W.register_estimated_tax(b.spark)
    b.register_views(["transactions"])
    return b.spark.sql("SELECT transaction_id, calculate_estimated_tax(CAST(amount AS DOUBLE)) AS estimated_tax "
                       "FROM transactions")


@register("credit_risk", "SELECT customer_id, CAST(risk_score AS DOUBLE) * 1.25 AS credit_risk FROM customers")
def _credit_risk(b):
    return b.customers.select("customer_id", S.credit_risk("risk_score").alias("credit_risk"))


# ---------------------------------------------------------------- 2.9 mutations
from ..operators import changes as C  # noqa: E402
from ..sources import batches as B  # noqa: E402


def _req(*cols):
    return " AND ".join(f"{c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''" for c in cols)


def _hid(prefix, *exprs):
    parts = " || ".join(f"coalesce(CAST(length({e}) AS VARCHAR) || ':' || {e}, '-')" for e in exprs)
    return f"'{prefix}' || upper(sha256({parts}))"


CUSTOMERS_BATCH_SQL = """SELECT s_name AS name,
 CASE WHEN s_acctbal < 0 THEN NULL ELSE lower(replace(s_name, '#', '.')) || '@supplier.example.com' END AS email,
 '+1-555-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS phone, CASE WHEN s_acctbal > 5000 THEN 'GOLD' END AS segment,
 s_acctbal AS lifetime_value, CAST(NULL AS VARCHAR) AS branch_name, CAST(NULL AS INT) AS risk_score FROM supplier"""


@register("insert_customers", f"""
WITH v AS (SELECT * FROM ({CUSTOMERS_BATCH_SQL}) b WHERE {_req('name', 'email')})
SELECT * FROM customers UNION ALL
SELECT {_hid('CUS', 'name', 'email')}, name, email,
 CASE WHEN regexp_replace(phone, '[^0-9]', '', 'g') = '' THEN NULL ELSE regexp_replace(phone, '[^0-9]', '', 'g') END,
 COALESCE(NULLIF(segment, ''), 'BRONZE'), COALESCE(CAST(lifetime_value AS DECIMAL(15,2)), 0),
 COALESCE(NULLIF(branch_name, ''), 'Main Branch'), COALESCE(risk_score, 0), DATE '{AS_OF_TXN}' FROM v""")
def _insert_customers(b):
    return C.insert_customers(b.customers, B.customers_batch(b), AS_OF_TXN).next


@register("insert_customers_rejects", f"""
SELECT {_hid('CUS', 'name', 'email')} AS change_key, 'missing required field' AS reason
FROM ({CUSTOMERS_BATCH_SQL}) b WHERE NOT ({_req('name', 'email')})""")
def _insert_customers_rejects(b):
    return C.insert_customers(b.customers, B.customers_batch(b), AS_OF_TXN).rejects


@register("insert_accounts", f"""
WITH b AS (SELECT 'SUP' || CAST(s_suppkey AS VARCHAR) AS account_number, 'CUS' || CAST(s_suppkey * 20 AS VARCHAR) AS customer_id,
  CASE WHEN s_acctbal < 0 THEN NULL ELSE 'SAVINGS' END AS account_type, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS status
  FROM supplier),
v AS (SELECT * FROM b WHERE {_req('account_number', 'customer_id', 'account_type')}
      AND customer_id IN (SELECT customer_id FROM customers))
SELECT * FROM accounts UNION ALL
SELECT account_number, customer_id, account_type, COALESCE(CAST(balance AS DECIMAL(15,2)), 0),
 COALESCE(NULLIF(status, ''), 'ACTIVE') FROM v""")
def _insert_accounts(b):
    return C.insert_accounts(b.accounts, B.accounts_batch(b), b.customers).next


@register("insert_transactions", f"""
WITH b AS (SELECT 'EV' || CAST(event_id AS VARCHAR) AS source_id, 'ACC' || CAST(user_id AS VARCHAR) AS account_number,
  CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS transaction_type, value AS amount, ts FROM events),
v AS (SELECT * FROM b WHERE {_req('account_number', 'transaction_type', 'amount')}
      AND account_number IN (SELECT account_number FROM accounts))
SELECT * FROM transactions UNION ALL
SELECT {_hid('TX', 'source_id')}, account_number, CAST(amount AS DECIMAL(15,2)), transaction_type, 'USD', '', '', 'LOW',
 'COMPLETED', ts FROM v""")
def _insert_transactions(b):
    return C.insert_transactions(b.transactions, B.transactions_batch(b), b.accounts).next


@register("insert_loans", f"""
WITH v AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND 'CUS' || CAST(o_custkey AS VARCHAR) IN (SELECT customer_id FROM customers))
SELECT * FROM loans UNION ALL
SELECT {_hid('LOAN', "'P' || CAST(o_orderkey AS VARCHAR)")}, 'CUS' || CAST(o_custkey AS VARCHAR),
 CASE o_orderpriority WHEN '1-URGENT' THEN 'HOME' WHEN '2-HIGH' THEN 'AUTO' WHEN '3-MEDIUM' THEN 'PERSONAL'
  WHEN '4-NOT SPECIFIED' THEN 'BUSINESS' ELSE 'EDUCATION' END,
 CAST(o_totalprice AS DECIMAL(15,2)), CAST(5.5 AS DECIMAL(5,2)), 36, CAST(0 AS DECIMAL(15,2)),
 CAST(o_totalprice AS DECIMAL(15,2)), CAST(0 AS DECIMAL(15,2)), CAST(DATE '{AS_OF_TXN}' + 30 AS DATE), 'A', 'ACTIVE' FROM v""")
def _insert_loans(b):
    return C.insert_loans(b.loans, B.loans_batch(b), b.customers, AS_OF_TXN).next


@register("insert_branches", f"""
WITH b AS (SELECT s_name || ' Branch' AS branch_name, n_name AS city, 'Manager ' || CAST(s_suppkey AS VARCHAR) AS manager,
  s_acctbal AS total_deposits FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
v AS (SELECT * FROM b WHERE {_req('branch_name', 'city', 'manager')})
SELECT * FROM branch_performance UNION ALL
SELECT {_hid('BR', 'branch_name', 'city', 'manager')}, branch_name, city, manager, 0, 0,
 COALESCE(CAST(total_deposits AS DECIMAL(15,2)), 0), 0, 0, 0 FROM v""")
def _insert_branches(b):
    return C.insert_branches(b.branch_performance, B.branches_batch(b)).next


ALERTS_BATCH_SQL = """SELECT 'EV' || CAST(event_id AS VARCHAR) AS source_id, 'TX' || CAST(event_id AS VARCHAR) AS transaction_id,
 'CUS' || CAST(user_id * 11 AS VARCHAR) AS customer_id, value AS amount, ts FROM events WHERE event_type = 'purchase'"""


@register("insert_fraud_alerts", f"""
WITH v AS (SELECT * FROM ({ALERTS_BATCH_SQL}) b WHERE customer_id IN (SELECT customer_id FROM customers))
SELECT * FROM fraud_alerts UNION ALL
SELECT {_hid('AL', 'source_id')}, transaction_id, customer_id, CAST(amount AS DECIMAL(15,2)), 'HIGH_VALUE', ts, 50, 'OPEN', ''
FROM v""")
def _insert_fraud_alerts(b):
    return C.insert_fraud_alerts(b.fraud_alerts, B.alerts_batch(b), b.customers).next


@register("fk_exists", f"""
SELECT {_hid('AL', 'source_id')} AS change_key, 'parent not found: customer_id' AS reason
FROM ({ALERTS_BATCH_SQL}) b WHERE customer_id NOT IN (SELECT customer_id FROM customers)""")
def _fk_exists(b):
    """Rejected side of the parent check (left anti join) of an alert batch."""
    return C.insert_fraud_alerts(b.fraud_alerts, B.alerts_batch(b), b.customers).rejects


NOW_TS = "2024-02-01 09:30:00"


@register("upsert_records", f"""
WITH b AS (
  SELECT 'rec-' || CAST(page_id AS VARCHAR) AS id, url AS name, 'page' || CAST(page_id AS VARCHAR) || '@example.com' AS email,
   'en' AS details FROM pages WHERE contains(url, '/en/')
  UNION ALL
  SELECT 'rec-b' || CAST(item_id AS VARCHAR), 'item ' || CAST(item_id AS VARCHAR), 'item' || CAST(item_id AS VARCHAR) || '@example.com',
   CAST(NULL AS VARCHAR) FROM benchmark),
v AS (SELECT * FROM b WHERE {_req('name', 'email')})
SELECT * FROM records WHERE id NOT IN (SELECT id FROM v)
UNION ALL
SELECT v.id, v.name, v.email, COALESCE(v.details, ''), COALESCE(r.created_at, TIMESTAMP '{NOW_TS}'), TIMESTAMP '{NOW_TS}'
FROM v LEFT JOIN records r ON r.id = v.id""")
def _upsert_records(b):
    return C.upsert_records(b.records, B.records_batch(b), NOW_TS).next


@register("update_by_key", f"""
WITH c AS (SELECT 'TX' || CAST(event_id AS VARCHAR) AS transaction_id, 'ACC' || CAST(user_id AS VARCHAR) AS account_number,
  CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS transaction_type, value AS amount,
  CASE WHEN event_type = 'purchase' THEN 'PENDING' END AS status FROM events),
f AS (SELECT c.*, t.timestamp AS old_ts FROM c JOIN transactions t ON t.transaction_id = c.transaction_id
      WHERE {_req('c.account_number', 'c.transaction_type', 'c.amount')}
      AND c.account_number IN (SELECT account_number FROM accounts))
SELECT * FROM transactions WHERE transaction_id NOT IN (SELECT transaction_id FROM f)
UNION ALL
SELECT transaction_id, account_number, CAST(amount AS DECIMAL(15,2)), transaction_type, 'EUR', '', '', 'LOW',
 COALESCE(NULLIF(status, ''), 'COMPLETED'), old_ts FROM f""")
def _update_by_key(b):
    return C.update_transactions(b.transactions, B.transaction_changes(b), b.accounts).next


def _latest_sql(changes, key):
    return f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY _seq DESC) AS rn
  FROM ({changes}) x) y WHERE rn = 1)"""


ACCOUNT_CHANGES_SQL = """SELECT 'ACC' || CAST(user_id AS VARCHAR) AS account_number, event_id AS _seq,
 'CUS' || CAST(user_id AS VARCHAR) AS customer_id, CASE WHEN event_id % 3 <> 0 THEN 'CHECKING' END AS account_type,
 value AS balance, CASE WHEN value < 10 THEN 'DORMANT' END AS status FROM events WHERE event_type = 'click'"""


def _reason_sql(required, fks):
    """The first failed rule of a change, NULL for a valid one."""
    miss = f"WHEN NOT coalesce({_req(*required)}, false) THEN 'missing required field'" if required else ""
    parents = " ".join(f"WHEN {c} NOT IN (SELECT {k} FROM {t}) THEN 'parent not found: {c}'" for c, t, k in fks)
    return f"CASE {miss} {parents} END"


def _valid_sql(changes, rules):
    return f"SELECT * FROM ({changes}) c0 WHERE {_reason_sql(*rules)} IS NULL"


def _rejects_sql(changes, rules, key, base=None):
    """Every invalid change, and every valid one whose key is not stored."""
    sql = f"SELECT {key} AS change_key, {_reason_sql(*rules)} AS reason FROM ({changes}) c0 WHERE {_reason_sql(*rules)} IS NOT NULL"
    if base:
        sql += (f" UNION ALL SELECT {key}, 'not found' FROM ({_valid_sql(changes, rules)}) c1 "
                f"WHERE {key} NOT IN (SELECT {key} FROM {base})")
    return sql


_ACCOUNT_RULES = (["customer_id", "account_type"], [("customer_id", "customers", "customer_id")])
_CUSTOMER_RULES = (["name", "email"], [])
_BRANCH_RULES = (["branch_name", "city", "manager"], [])
_ALERT_RULES = (["transaction_id", "customer_id", "amount", "alert_type"], [("customer_id", "customers", "customer_id")])
_TX_RULES = (["account_number", "transaction_type", "amount"], [("account_number", "accounts", "account_number")])


@register("update_by_key_accounts", f"""
WITH l AS {_latest_sql(_valid_sql(ACCOUNT_CHANGES_SQL, _ACCOUNT_RULES), 'account_number')},
f AS (SELECT l.* FROM l JOIN accounts a ON a.account_number = l.account_number)
SELECT * FROM accounts WHERE account_number NOT IN (SELECT account_number FROM f)
UNION ALL
SELECT account_number, customer_id, account_type, CAST(balance AS DECIMAL(15,2)), COALESCE(NULLIF(status, ''), 'ACTIVE')
FROM f""")
def _update_by_key_accounts(b):
    """Account handler's update as a bulk job: latest change per key,
    parent check, 'not found' for unknown accounts."""
    return C.update_accounts(b.accounts, B.account_changes(b), b.customers).next


CUSTOMER_CHANGES_SQL = """SELECT 'CUS' || CAST(user_id AS VARCHAR) AS customer_id, event_id AS _seq,
 'User ' || CAST(user_id AS VARCHAR) AS name,
 CASE WHEN event_id % 4 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) || '@example.com' END AS email,
 CASE WHEN value > 50 THEN 'GOLD' END AS segment, value AS lifetime_value FROM events WHERE event_type = 'signup'"""


@register("update_by_key_customers", f"""
WITH l AS {_latest_sql(_valid_sql(CUSTOMER_CHANGES_SQL, _CUSTOMER_RULES), 'customer_id')},
f AS (SELECT l.*, cu.joined_date AS old_jd FROM l JOIN customers cu ON cu.customer_id = l.customer_id)
SELECT * FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM f)
UNION ALL
SELECT customer_id, name, email, CAST(NULL AS VARCHAR), COALESCE(NULLIF(segment, ''), 'BRONZE'),
 CAST(lifetime_value AS DECIMAL(15,2)), 'Main Branch', 0, old_jd FROM f""")
def _update_by_key_customers(b):
    """Customer handler's update as a bulk job: defaults as on insert, the
    stored joined date kept."""
    return C.update_customers(b.customers, B.customer_changes(b)).next


@register("update_accounts_rejects", _rejects_sql(ACCOUNT_CHANGES_SQL, _ACCOUNT_RULES, "account_number", "accounts"))
def _update_accounts_rejects(b):
    """Every account change that was refused, with the first failed rule."""
    return C.update_accounts(b.accounts, B.account_changes(b), b.customers).rejects


@register("update_customers_rejects", _rejects_sql(CUSTOMER_CHANGES_SQL, _CUSTOMER_RULES, "customer_id", "customers"))
def _update_customers_rejects(b):
    return C.update_customers(b.customers, B.customer_changes(b)).rejects


TX_CHANGES_SQL = """SELECT 'TX' || CAST(event_id AS VARCHAR) AS transaction_id, 'ACC' || CAST(user_id AS VARCHAR) AS account_number,
 CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS transaction_type, value AS amount FROM events"""


@register("update_transactions_rejects", _rejects_sql(TX_CHANGES_SQL, _TX_RULES, "transaction_id", "transactions"))
def _update_transactions_rejects(b):
    return C.update_transactions(b.transactions, B.transaction_changes(b), b.accounts).rejects


BRANCH_CHANGES_SQL = """SELECT 'BR' || CAST(s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 0 END AS VARCHAR) AS branch_id,
 s_suppkey AS _seq, s_name || ' Branch' AS branch_name, 'City ' || CAST(s_nationkey AS VARCHAR) AS city,
 CASE WHEN s_acctbal >= 0 THEN 'Manager ' || CAST(s_suppkey AS VARCHAR) END AS manager, s_acctbal AS total_deposits FROM supplier"""


@register("update_branches", f"""
WITH l AS {_latest_sql(_valid_sql(BRANCH_CHANGES_SQL, _BRANCH_RULES), 'branch_id')},
f AS (SELECT l.* FROM l JOIN branch_performance p ON p.branch_id = l.branch_id)
SELECT * FROM branch_performance WHERE branch_id NOT IN (SELECT branch_id FROM f)
UNION ALL
SELECT branch_id, branch_name, city, manager, 0, 7, CAST(total_deposits AS DECIMAL(15,2)), 0, 0, 0 FROM f""")
def _update_branches(b):
    """Branch handler's update as a bulk job: several changes per branch,
    some of them invalid after a valid one."""
    return C.update_branches(b.branch_performance, B.branch_changes(b)).next


@register("update_branches_rejects", _rejects_sql(BRANCH_CHANGES_SQL, _BRANCH_RULES, "branch_id", "branch_performance"))
def _update_branches_rejects(b):
    return C.update_branches(b.branch_performance, B.branch_changes(b)).rejects


ALERT_CHANGES_SQL = """SELECT 'AL' || CAST(event_id AS VARCHAR) AS alert_id, event_id * 2 + turn AS _seq,
 'TX' || CAST(event_id AS VARCHAR) AS transaction_id,
 CASE WHEN turn = 1 AND event_id % 5 = 0 THEN 'CUS-NOPE' ELSE 'CUS' || CAST(user_id * 11 AS VARCHAR) END AS customer_id,
 CASE WHEN turn = 0 OR event_id % 2 = 0 THEN value + turn END AS amount, 'HIGH_VALUE' AS alert_type,
 CASE WHEN turn = 0 THEN 'CONFIRMED' END AS status
 FROM events, (SELECT unnest([0, 1]) AS turn) t WHERE event_type IN ('error', 'view')"""


@register("update_fraud_alerts", f"""
WITH l AS {_latest_sql(_valid_sql(ALERT_CHANGES_SQL, _ALERT_RULES), 'alert_id')},
f AS (SELECT l.*, a.timestamp AS old_ts FROM l JOIN fraud_alerts a ON a.alert_id = l.alert_id)
SELECT * FROM fraud_alerts WHERE alert_id NOT IN (SELECT alert_id FROM f)
UNION ALL
SELECT alert_id, transaction_id, customer_id, CAST(amount AS DECIMAL(15,2)), alert_type, old_ts, 50,
 COALESCE(NULLIF(status, ''), 'OPEN'), '' FROM f""")
def _update_fraud_alerts(b):
    """Alert handler's update as a bulk job; the stored time is kept."""
    return C.update_fraud_alerts(b.fraud_alerts, B.alert_changes(b), b.customers).next


@register("update_fraud_alerts_rejects", _rejects_sql(ALERT_CHANGES_SQL, _ALERT_RULES, "alert_id", "fraud_alerts"))
def _update_fraud_alerts_rejects(b):
    return C.update_fraud_alerts(b.fraud_alerts, B.alert_changes(b), b.customers).rejects


@register("insert_accounts_rejects", _rejects_sql("""SELECT 'SUP' || CAST(s_suppkey AS VARCHAR) AS account_number,
 'CUS' || CAST(s_suppkey * 20 AS VARCHAR) AS customer_id, CASE WHEN s_acctbal < 0 THEN NULL ELSE 'SAVINGS' END AS account_type
 FROM supplier""", (["account_number", "customer_id", "account_type"], [("customer_id", "customers", "customer_id")]),
    "account_number"))
def _insert_accounts_rejects(b):
    return C.insert_accounts(b.accounts, B.accounts_batch(b), b.customers).rejects


@register("insert_accounts_twice_rejects", _rejects_sql("""SELECT 'SUP' || CAST(s_suppkey AS VARCHAR) AS account_number,
 'CUS' || CAST(s_suppkey * 20 AS VARCHAR) AS customer_id, CASE WHEN s_acctbal < 0 THEN NULL ELSE 'SAVINGS' END AS account_type
 FROM supplier""", (["account_number", "customer_id", "account_type"], [("customer_id", "customers", "customer_id")]),
    "account_number") + """
UNION ALL SELECT 'SUP' || CAST(s_suppkey AS VARCHAR), 'duplicate key' FROM supplier
WHERE s_acctbal >= 0 AND 'CUS' || CAST(s_suppkey * 20 AS VARCHAR) IN (SELECT customer_id FROM customers)""")
def _insert_accounts_twice_rejects(b):
    """The same batch applied again: every row it added is a duplicate now."""
    once = C.insert_accounts(b.accounts, B.accounts_batch(b), b.customers).next
    return C.insert_accounts(once, B.accounts_batch(b), b.customers).rejects


@register("update_loans_keep_due", f"""
WITH c AS (SELECT 'LOAN' || CAST(o_orderkey AS VARCHAR) AS loan_id, o_totalprice AS amount,
  CASE WHEN o_orderstatus = 'O' THEN strftime(CAST(o_orderdate AS DATE) + 400, '%Y-%m-%d')
       WHEN o_orderstatus = 'F' THEN 'null' END AS next_due_date FROM orders),
r AS (SELECT c.*, l.customer_id, l.next_due_date AS old_due FROM c JOIN loans l ON l.loan_id = c.loan_id
      WHERE l.customer_id IN (SELECT customer_id FROM customers))
SELECT * FROM loans WHERE loan_id NOT IN (SELECT loan_id FROM r)
UNION ALL
SELECT loan_id, customer_id, 'PERSONAL', CAST(amount AS DECIMAL(15,2)), CAST(7.25 AS DECIMAL(5,2)), 48, CAST(0 AS DECIMAL(15,2)),
 CAST(amount AS DECIMAL(15,2)), CAST(0 AS DECIMAL(15,2)),
 CASE WHEN next_due_date IS NOT NULL AND trim(next_due_date) <> '' AND trim(next_due_date) <> 'null'
  THEN CAST(strptime(trim(next_due_date), '%Y-%m-%d') AS DATE) ELSE old_due END, 'A', 'ACTIVE' FROM r""")
def _update_loans_keep_due(b):
    return C.update_loans(b.loans, B.loan_changes(b), b.customers).next


_DELETE_KEYS = {
    "accounts": ("account_number", "status = 'FROZEN'"), "transactions": ("transaction_id", "status = 'FAILED'"),
    "customers": ("customer_id", "risk_score > 95"), "loans": ("loan_id", "status = 'FULLY_PAID'"),
    "branch_performance": ("branch_id", "city = 'ASIA'"), "fraud_alerts": ("alert_id", "status = 'DISMISSED'"),
    "records": ("id", "name LIKE '%/en/%'"),
}


def _deleted(table, out):
    """``out`` after the rows of ``table`` that match its condition, and their direct children, are gone."""
    def run(b):
        tables = {n: b.table(n) for n in _DELETE_KEYS}
        pk, cond = _DELETE_KEYS[table]
        return C.delete_cascade(tables, table, tables[table].filter(cond).select(pk))[out]
    run.__doc__ = f"Delete from {table}; what is left of {out}."
    return run


def _deleted_sql(table, out, child_key=None):
    pk, cond = _DELETE_KEYS[table]
    return f"SELECT * FROM {out} WHERE {child_key or pk} NOT IN (SELECT {pk} FROM {table} WHERE {cond})"


for _name, _table, _out in [
        ("delete_cascade", "accounts", "transactions"), ("delete_cascade_transactions", "transactions", "fraud_alerts"),
        ("delete_cascade_customers", "customers", "accounts"), ("delete_accounts", "accounts", "accounts"),
        ("delete_transactions", "transactions", "transactions"), ("delete_customers", "customers", "customers"),
        ("delete_loans", "loans", "loans"), ("delete_branches", "branch_performance", "branch_performance"),
        ("delete_fraud_alerts", "fraud_alerts", "fraud_alerts"), ("delete_records", "records", "records")]:
    register(_name, _deleted_sql(_table, _out))(_deleted(_table, _out))


@register("orphan_report", """
SELECT 'accounts' AS child_table, 'customer_id' AS column, 'customers' AS parent_table,
  (SELECT COUNT(*) FROM accounts WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers)) AS orphans
UNION ALL SELECT 'transactions', 'account_number', 'accounts',
  (SELECT COUNT(*) FROM transactions WHERE account_number IS NOT NULL AND account_number NOT IN (SELECT account_number FROM accounts))
UNION ALL SELECT 'loans', 'customer_id', 'customers',
  (SELECT COUNT(*) FROM loans WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers))
UNION ALL SELECT 'fraud_alerts', 'transaction_id', 'transactions',
  (SELECT COUNT(*) FROM fraud_alerts WHERE transaction_id IS NOT NULL AND transaction_id NOT IN (SELECT transaction_id FROM transactions))
UNION ALL SELECT 'fraud_alerts', 'customer_id', 'customers',
  (SELECT COUNT(*) FROM fraud_alerts WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers))""")
def _orphan_report(b):
    return C.orphan_report({n: b.table(n) for n in ("customers", "accounts", "transactions", "loans", "fraud_alerts")})


def _pk_sql(table, col, kind):
    dup = (f"(SELECT COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {table} WHERE {col} IS NOT NULL "
           f"GROUP BY {col} HAVING COUNT(*) > 1))")
    nulls = f"(SELECT COUNT(*) FROM {table} WHERE {col} IS NULL)"
    v = {"primary_key": f"{dup} + {nulls}", "unique": dup, "not_null": nulls}[kind]
    return f"SELECT '{table}' AS table_name, '{kind}' AS check_kind, '{col}' AS column, CAST({v} AS BIGINT) AS violations"


_KEY_CHECKS = [("customers", "customer_id", "primary_key"), ("accounts", "account_number", "primary_key"),
               ("transactions", "transaction_id", "primary_key"), ("loans", "loan_id", "primary_key"),
               ("records", "id", "primary_key"), ("branch_performance", "branch_id", "primary_key"),
               ("fraud_alerts", "alert_id", "primary_key"), ("customers", "email", "unique"),
               ("branch_performance", "branch_name", "unique"), ("customers", "name", "not_null"),
               ("transactions", "amount", "not_null"), ("records", "name", "not_null"), ("records", "email", "not_null"),
               ("loans", "amount", "not_null"), ("loans", "interest_rate", "not_null"), ("loans", "term_months", "not_null"),
               ("loans", "emi", "not_null"), ("loans", "remaining_balance", "not_null")]


@register("key_constraints_report", "\nUNION ALL\n".join(_pk_sql(*c) for c in _KEY_CHECKS))
def _key_constraints_report(b):
    return C.key_constraints_report({n: b.table(n) for n in ("customers", "accounts", "transactions", "loans",
                                                             "records", "branch_performance", "fraud_alerts")})


@register("promo_upgrade", """
SELECT customer_id, name, email, phone, CASE WHEN lifetime_value > 9000 THEN 'PLATINUM' ELSE segment END AS segment,
 CAST(CASE WHEN lifetime_value > 9000 THEN lifetime_value + 100000 ELSE lifetime_value END AS DECIMAL(15,2)) AS lifetime_value,
 branch_name, risk_score, joined_date FROM customers""")
def _promo_upgrade(b):
    ids = b.customers.filter(F.col("lifetime_value") > 9000).select("customer_id")
    return C.promo_upgrade(b.customers, ids)
