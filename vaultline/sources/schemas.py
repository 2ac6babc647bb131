"""Fixed schemas of the banking tables (the DDL of the workload).

VARCHAR(n) becomes StringType (length not enforced), NUMBER(p,2) stays a
decimal, NUMBER(p,0) becomes an integer type, TIMESTAMP_NTZ stays NTZ.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DateType(), T.IntegerType(), T.LongType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(15, 2)
RATE = T.DecimalType(5, 2)


def _schema(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _schema(
    ("customer_id", S, False), ("name", S, False), ("email", S, True),
    ("phone", S, True), ("segment", S, True), ("lifetime_value", MONEY, True),
    ("branch_name", S, True), ("risk_score", I, True), ("joined_date", D, True))

ACCOUNTS = _schema(
    ("account_number", S, False), ("customer_id", S, True),
    ("account_type", S, True), ("balance", MONEY, True), ("status", S, True))

TRANSACTIONS = _schema(
    ("transaction_id", S, False), ("account_number", S, True),
    ("amount", MONEY, False), ("transaction_type", S, True),
    ("currency", S, True), ("merchant_name", S, True), ("location", S, True),
    ("risk_factor", S, True), ("status", S, True), ("timestamp", TS, True))

LOANS = _schema(
    ("loan_id", S, False), ("customer_id", S, True), ("category", S, True),
    ("amount", MONEY, False), ("interest_rate", RATE, False),
    ("term_months", I, False), ("emi", MONEY, False),
    ("remaining_balance", MONEY, False), ("recovered_amount", MONEY, True),
    ("next_due_date", D, True), ("risk_rating", S, True), ("status", S, True))

RECORDS = _schema(
    ("id", S, False), ("name", S, False), ("email", S, False),
    ("details", S, True), ("created_at", TS, True), ("updated_at", TS, True))

BRANCH_PERFORMANCE = _schema(
    ("branch_id", S, False), ("branch_name", S, True), ("city", S, True),
    ("manager", S, True), ("customer_count", L, True), ("active_loans", L, True),
    ("total_deposits", MONEY, True), ("total_revenue", MONEY, True),
    ("transaction_count", L, True), ("growth_rate", RATE, True))

FRAUD_ALERTS = _schema(
    ("alert_id", S, False), ("transaction_id", S, True), ("customer_id", S, True),
    ("amount", MONEY, True), ("alert_type", S, True), ("timestamp", TS, True),
    ("risk_score", I, True), ("status", S, True), ("details", S, True))

QUERY_LOG = _schema(
    ("query_id", S, False), ("user_name", S, True), ("role_name", S, True),
    ("query_text", S, True), ("start_time", TS, True),
    ("total_elapsed_time", L, True), ("execution_status", S, True))

BY_NAME = {
    "customers": CUSTOMERS, "accounts": ACCOUNTS, "transactions": TRANSACTIONS,
    "loans": LOANS, "records": RECORDS, "branch_performance": BRANCH_PERFORMANCE,
    "fraud_alerts": FRAUD_ALERTS, "query_log": QUERY_LOG,
}

# Primary keys declared by the DDL.
PRIMARY_KEYS = {
    "customers": "customer_id", "accounts": "account_number",
    "transactions": "transaction_id", "loans": "loan_id", "records": "id",
    "branch_performance": "branch_id", "fraud_alerts": "alert_id",
}

# Foreign keys declared by the DDL: (child table, child column, parent table).
FOREIGN_KEYS = [
    ("accounts", "customer_id", "customers"),
    ("transactions", "account_number", "accounts"),
    ("loans", "customer_id", "customers"),
    ("fraud_alerts", "transaction_id", "transactions"),
    ("fraud_alerts", "customer_id", "customers"),
]
