"""DuckDB views of the banking tables, for the SQL oracle.

The driver registers the raw parquet tables as views; every oracle query is
prefixed with these CTEs so it names the same banking tables the Spark
queries use. The rules are the fixed mapping of FIXTURES.md (DuckDB spelling:
``DATE d + n`` for date_add, ``TIMESTAMP`` for TIMESTAMP_NTZ).
"""

from __future__ import annotations

import datetime as dt
import decimal

# Mapping of the driver's tables to the banking tables.
VIEWS = {
    "customers": """
SELECT concat('CUS', CAST(c.c_custkey AS VARCHAR)) AS customer_id, c.c_name AS name,
 concat(lower(replace(c.c_name,'#','.')),'@example.com') AS email,
 CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE concat('555', lpad(CAST(c.c_custkey AS VARCHAR),7,'0')) END AS phone,
 CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'PLATINUM' WHEN 'BUILDING' THEN 'GOLD' WHEN 'FURNITURE' THEN 'SILVER' ELSE 'BRONZE' END AS segment,
 CAST(c.c_acctbal AS DECIMAL(15,2)) AS lifetime_value, n.n_name AS branch_name,
 CAST(c.c_custkey % 101 AS INT) AS risk_score, CAST(DATE '2020-01-01' + CAST(c.c_custkey % 1000 AS INT) AS DATE) AS joined_date
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "accounts": """
SELECT concat('ACC', CAST(c_custkey AS VARCHAR)) AS account_number, concat('CUS', CAST(c_custkey AS VARCHAR)) AS customer_id,
 CASE c_custkey % 3 WHEN 0 THEN 'CHECKING' WHEN 1 THEN 'LOAN' ELSE 'CREDIT' END AS account_type, CAST(c_acctbal AS DECIMAL(15,2)) AS balance,
 CASE WHEN c_acctbal < 0 THEN 'FROZEN' WHEN c_acctbal < 1000 THEN 'DORMANT' ELSE 'ACTIVE' END AS status
FROM customer WHERE c_custkey % 10 <> 9
UNION ALL
SELECT concat('SAV', CAST(c_custkey AS VARCHAR)), concat('CUS', CAST(c_custkey AS VARCHAR)), 'SAVINGS', CAST(1000 + c_custkey AS DECIMAL(15,2)), 'ACTIVE'
FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 3 = 0""",
    "transactions": """
SELECT concat('TX', CAST(o_orderkey AS VARCHAR)) AS transaction_id, concat('ACC', CAST(o_custkey AS VARCHAR)) AS account_number,
 CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CREDIT_CARD' WHEN '3-MEDIUM' THEN 'WITHDRAWAL' WHEN '4-NOT SPECIFIED' THEN 'ONLINE' ELSE 'DEPOSIT' END AS transaction_type,
 'USD' AS currency, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Merchant ', CAST(o_orderkey % 40 AS VARCHAR)) END AS merchant_name,
 concat('City ', CAST(o_orderkey % 5 AS VARCHAR)) AS location,
 CASE WHEN o_totalprice > 400000 THEN 'HIGH' WHEN o_totalprice > 200000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_factor,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status, o_orderdate AS timestamp
FROM orders""",
    "loans": """
SELECT concat('LOAN', CAST(l.l_orderkey AS VARCHAR)) AS loan_id, concat('CUS', CAST(max(o.o_custkey) AS VARCHAR)) AS customer_id,
 CASE l.l_orderkey % 5 WHEN 0 THEN 'HOME' WHEN 1 THEN 'AUTO' WHEN 2 THEN 'PERSONAL' WHEN 3 THEN 'BUSINESS' ELSE 'EDUCATION' END AS category,
 CAST(sum(CAST(l.l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS amount, CAST(max(l.l_discount) * 100 AS DECIMAL(5,2)) AS interest_rate,
 CAST(12 + 12 * (l.l_orderkey % 5) AS INT) AS term_months,
 CAST(min(CAST(l.l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS emi,
 CAST(sum(CAST(l.l_extendedprice AS DECIMAL(15,2))) - max(CAST(l.l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS remaining_balance,
 CAST(max(CAST(l.l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS recovered_amount,
 CASE WHEN l.l_orderkey % 17 = 0 THEN NULL ELSE CAST(max(l.l_shipdate) AS DATE) END AS next_due_date,
 CASE l.l_orderkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS risk_rating,
 CASE l.l_orderkey % 4 WHEN 0 THEN 'DELINQUENT' WHEN 1 THEN 'FULLY_PAID' ELSE 'ACTIVE' END AS status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey""",
    "branch_performance": """
SELECT concat('BR', CAST(n_nationkey AS VARCHAR)) AS branch_id, n_name AS branch_name, r_name AS city,
 concat('Manager ', CAST(n_nationkey AS VARCHAR)) AS manager, CAST(n_nationkey * 11 AS BIGINT) AS customer_count, CAST(n_nationkey * 3 AS BIGINT) AS active_loans,
 CAST(n_nationkey * 10000 AS DECIMAL(15,2)) AS total_deposits, CAST(n_nationkey * 2500 AS DECIMAL(15,2)) AS total_revenue,
 CAST(n_nationkey * 40 AS BIGINT) AS transaction_count, CAST((n_nationkey * 7) % 31 - 10 AS DECIMAL(5,2)) AS growth_rate
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "fraud_alerts": """
SELECT concat('AL', CAST(event_id AS VARCHAR)) AS alert_id, concat('TX', CAST(event_id AS VARCHAR)) AS transaction_id,
 concat('CUS', CAST(user_id AS VARCHAR)) AS customer_id, CAST(value AS DECIMAL(15,2)) AS amount,
 CASE event_id % 4 WHEN 0 THEN 'VELOCITY_LIMIT' WHEN 1 THEN 'HIGH_VALUE' WHEN 2 THEN 'GEOGRAPHIC_ANOMALY' ELSE 'DUPLICATE_TX' END AS alert_type,
 ts AS timestamp, CAST(event_id % 101 AS INT) AS risk_score,
 CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'DISMISSED' ELSE 'CONFIRMED' END AS status, props AS details
FROM events WHERE event_type = 'error'""",
    "records": """
SELECT concat('rec-', CAST(page_id AS VARCHAR)) AS id, url AS name, concat('page', CAST(page_id AS VARCHAR), '@example.com') AS email,
 CAST(NULL AS VARCHAR) AS details, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS TIMESTAMP) AS created_at,
 CAST(NULL AS TIMESTAMP) AS updated_at FROM pages""",
    "query_log": """
SELECT CAST(event_id AS VARCHAR) AS query_id, concat('u', CAST(user_id AS VARCHAR)) AS user_name,
 CASE user_id % 4 WHEN 0 THEN 'BANKING_ADMIN' WHEN 1 THEN 'BANKING_DATA_ENGINEER' WHEN 2 THEN 'BANKING_ANALYST' ELSE 'BANKING_BUSINESS_USER' END AS role_name,
 CASE event_type WHEN 'view' THEN 'SELECT * FROM CUSTOMERS' WHEN 'click' THEN '/* ui */ select 1' WHEN 'signup' THEN 'INSERT INTO CUSTOMERS VALUES (1)' WHEN 'purchase' THEN 'UPDATE CUSTOMERS SET name = NULL' ELSE 'SHOW TABLES' END AS query_text,
 ts AS start_time, CAST(round(value * 100) AS BIGINT) AS total_elapsed_time, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status
FROM events""",
    "event_transactions": """
SELECT concat('TX', CAST(event_id AS VARCHAR)) AS transaction_id, concat('ACC', CAST(user_id AS VARCHAR)) AS account_number,
 CAST(value AS DECIMAL(15,2)) AS amount, upper(event_type) AS transaction_type,
 concat('Merchant ', CAST(CAST(json_extract_string(props, '$.k') AS INT) % 40 AS VARCHAR)) AS merchant_name,
 concat('City ', CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR)) AS location,
 ts AS timestamp
FROM events""",
    "usage_log": """
SELECT ts AS start_time, CAST(CAST(value AS DECIMAL(18,2)) / 100 AS DECIMAL(18,4)) AS credits_used FROM events""",
    "storage_log": """
SELECT CAST(ts AS DATE) AS usage_date, CAST(event_id * 1048576 AS BIGINT) AS bytes FROM events""",
}


def with_views(body: str) -> str:
    """Prefix an oracle query with the banking views as CTEs."""
    ctes = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in VIEWS.items())
    body = body.strip().rstrip(";")
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        # merge a query's own CTEs after the views
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# -- comparing a Spark result with the oracle's ---------------------------

def duckdb_tables(sf_dir: str):
    """A DuckDB connection with the driver's raw tables as views."""
    import duckdb

    from ..sources.tables import RAW_TABLES
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral() else format(v.normalize(), "f")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
