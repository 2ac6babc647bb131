"""Registered queries, part two: fraud rules, table versions, loads, sinks,
streams and the remaining governance reports.

The streaming entries run their job to completion with
``trigger(availableNow=True)`` over the events file (read in place as a file
stream), checkpointed under the shared checkpoint root, and return the sink
read back; their oracle is the batch SQL of the same rule.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import constraints as CN
from ..operators import feeds
from ..operators import fraud as FR
from ..operators import governance as G
from ..operators import grid, lists
from ..operators import stored_changes as SC
from ..operators import versions as V
from ..operators.joins import account_branch_map
from ..session import scratch_path
from ..sources import batches as B
from ..sources import ingest as I
from ..sources import sinks as SK
from ..sources import stored as ST
from ..sources.buckets import BucketTable
from ..sources.history import History
from ..sources.search_index import SearchIndex
from ..sources.tables import Bank
from ..streaming import jobs as J
from ..streaming import views as VW
from .catalog import CUST_SQL_COLS, DAILY_BRANCH_SQL, NOW_TS, TXN_SQL_COLS, TXN_SQL_FROM
from .registry import AS_OF_TXN, register

# Parameters of the registered forms (ours: the reference names the rules
# but fixes no threshold).
HIGH_VALUE = 250
VELOCITY = dict(window="1 hour", slide="10 minutes", max_count=2)
GEO_MINUTES = 60
DUP_MINUTES, DUP_SCALE = 1440, 0
AS_OF_1, AS_OF_2 = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
LOAD_NOW = "2001-08-01 00:00:00"
RUN_HOUR = "2024-01-30 00:00:00"

# ---------------------------------------------------------------- 2.12 fraud rules (batch)

HIGH_VALUE_SQL = f"""
SELECT transaction_id, account_number, amount, timestamp, 'HIGH_VALUE' AS alert_type
FROM event_transactions WHERE amount >= {HIGH_VALUE}"""

VELOCITY_SQL = """
WITH w AS (SELECT account_number, amount,
   time_bucket(INTERVAL 10 MINUTE, timestamp) - to_minutes(CAST(k * 10 AS BIGINT)) AS window_start
 FROM event_transactions, range(0, 6) r(k))
SELECT account_number, window_start, window_start + INTERVAL 1 HOUR AS window_end, COUNT(*) AS tx_count,
 CAST(SUM(amount) AS DECIMAL(38,2)) AS total_amount, 'VELOCITY_LIMIT' AS alert_type
FROM w GROUP BY account_number, window_start HAVING COUNT(*) > 2"""

SECONDS = "CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT)"

GEO_SQL = f"""
WITH s AS (SELECT *, {SECONDS} AS sec FROM event_transactions),
l AS (SELECT *, lag(sec) OVER w AS psec, lag(location) OVER w AS ploc, lag(transaction_id) OVER w AS pid FROM s
 WINDOW w AS (PARTITION BY account_number ORDER BY timestamp, transaction_id))
SELECT transaction_id, account_number, location, ploc AS previous_location, pid AS previous_transaction_id,
 sec - psec AS gap_seconds, 'GEOGRAPHIC_ANOMALY' AS alert_type
FROM l WHERE psec IS NOT NULL AND sec - psec <= {GEO_MINUTES * 60} AND location <> ploc"""

DUP_SQL = f"""
WITH s AS (SELECT *, {SECONDS} AS sec FROM event_transactions),
l AS (SELECT *, lag(sec) OVER w AS psec, lag(transaction_id) OVER w AS pid FROM s
 WINDOW w AS (PARTITION BY account_number, round(amount, {DUP_SCALE}), merchant_name ORDER BY timestamp, transaction_id))
SELECT transaction_id, account_number, amount, merchant_name, pid AS duplicate_of, sec - psec AS gap_seconds,
 'DUPLICATE_TX' AS alert_type
FROM l WHERE psec IS NOT NULL AND sec - psec <= {DUP_MINUTES * 60}"""


@register("fraud_high_value", HIGH_VALUE_SQL)
def _fraud_high_value(b):
    return FR.fraud_high_value(b.event_transactions, HIGH_VALUE)


@register("fraud_velocity", VELOCITY_SQL)
def _fraud_velocity(b):
    return FR.fraud_velocity(b.event_transactions, **VELOCITY)


@register("fraud_geographic", GEO_SQL)
def _fraud_geographic(b):
    return FR.fraud_geographic(b.event_transactions, GEO_MINUTES)


@register("fraud_duplicate", DUP_SQL)
def _fraud_duplicate(b):
    return FR.fraud_duplicate(b.event_transactions, DUP_MINUTES, DUP_SCALE)


# ---------------------------------------------------------------- 2.10 streaming

def _events(b):
    return J.event_stream(b.spark, b.sf_dir)


def _account_branch(b):
    """The account -> branch map (joined once, when a rollup is read)."""
    return account_branch_map(b.accounts, b.customers)


@register("fraud_velocity_stream", VELOCITY_SQL)
def _fraud_velocity_stream(b):
    return J.fraud_velocity_stream(b.spark, _events(b), **VELOCITY)


@register("fraud_geographic_stream", GEO_SQL)
def _fraud_geographic_stream(b):
    return J.fraud_geographic_stream(b.spark, _events(b), GEO_MINUTES)[0]


@register("fraud_duplicate_stream", DUP_SQL)
def _fraud_duplicate_stream(b):
    return J.fraud_duplicate_stream(b.spark, _events(b), DUP_MINUTES, DUP_SCALE)[0]


@register("high_risk_stream", """
SELECT f.transaction_id, COALESCE(c.name, 'Unknown') AS customer_name, f.amount, f.risk_score
FROM fraud_alerts f LEFT JOIN customers c ON f.customer_id = c.customer_id WHERE f.risk_score > 80""")
def _high_risk_stream(b):
    return J.high_risk_stream(b.spark, _events(b), b.customers, 80)


TX_BRANCH_FROM = """FROM event_transactions t JOIN accounts a ON t.account_number = a.account_number
 JOIN customers c ON a.customer_id = c.customer_id"""


@register("live_daily_branch", f"""
SELECT CAST(t.timestamp AS DATE) AS transaction_date, c.branch_name, COUNT(*) AS daily_count,
 CAST(SUM(t.amount) AS DECIMAL(38,2)) AS daily_amount {TX_BRANCH_FROM} GROUP BY 1, 2""")
def _live_daily_branch(b):
    return J.live_daily_branch(b.spark, _events(b), _account_branch(b))


@register("hourly_consolidate", f"""
SELECT c.branch_name, date_trunc('hour', t.timestamp) AS hour_start, COUNT(*) AS transaction_count,
 CAST(SUM(t.amount) AS DECIMAL(38,2)) AS total_amount {TX_BRANCH_FROM} GROUP BY 1, 2""")
def _hourly_consolidate(b):
    return J.hourly_consolidate(b.spark, _events(b), _account_branch(b))


# The same views after a log of inserts, updates and deletes of all three tables.
CHANGED_FROM = """FROM (SELECT transaction_id, account_number, timestamp, amount * CASE WHEN transaction_type = 'SIGNUP' THEN 2 ELSE 1 END AS amount
  FROM event_transactions WHERE transaction_type <> 'ERROR') t
 JOIN (SELECT * FROM accounts WHERE status <> 'DORMANT') a ON t.account_number = a.account_number
 JOIN (SELECT customer_id, CASE WHEN segment = 'GOLD' THEN 'HEAD OFFICE' ELSE branch_name END AS branch_name FROM customers) c
  ON a.customer_id = c.customer_id"""


def _changed_view(b, make, name, count_name, sum_name):
    """Load accounts and customers, follow the transactions' change stream, then close and move some."""
    root = scratch_path(b.spark, name)
    view = make(b.spark, f"{root}/view")
    view.apply(0, accounts=B.account_opening(b), customers=B.customer_opening(b))
    free = VW.follow(view, B.transaction_changes_from(_events(b)), root, first_batch=1)
    view.apply(free, accounts=B.account_closing(b), customers=B.customer_moves(b))
    return view.read(count_name, sum_name)


@register("live_daily_branch_dml", f"""
SELECT CAST(t.timestamp AS DATE) AS transaction_date, c.branch_name, COUNT(*) AS daily_count,
 CAST(SUM(t.amount) AS DECIMAL(38,2)) AS daily_amount {CHANGED_FROM} GROUP BY 1, 2""")
def _live_daily_branch_dml(b):
    return _changed_view(b, VW.daily_view, "live_daily_branch_dml", "daily_count", "daily_amount")


@register("hourly_consolidate_dml", f"""
SELECT c.branch_name, date_trunc('hour', t.timestamp) AS hour_start, COUNT(*) AS transaction_count,
 CAST(SUM(t.amount) AS DECIMAL(38,2)) AS total_amount {CHANGED_FROM} GROUP BY 1, 2""")
def _hourly_consolidate_dml(b):
    return _changed_view(b, VW.hourly_view, "hourly_consolidate_dml", "transaction_count", "total_amount")


# ---------------------------------------------------------------- bulk changes on bucketed tables

def _bucketed(b, job, *names):
    root, tables = scratch_path(b.spark, job), []
    for name in names:
        tables.append(BucketTable(b.spark, f"{root}/{name}", name))
        tables[-1].replace(b.table(name))
    return tables


@register("update_by_key_stored", same_as="update_by_key")
def _update_by_key_stored(b):
    """The update on tables in key buckets: only the buckets of the batch's keys are read and written."""
    tx, accounts = _bucketed(b, "update_by_key", "transactions", "accounts")
    return SC.apply(tx, B.transaction_changes(b), "transaction_id", C.update_transactions, [(accounts, "account_number")]).next


@register("update_loans_stored", same_as="update_loans_keep_due")
def _update_loans_stored(b):
    loans, customers = _bucketed(b, "update_loans", "loans", "customers")
    return SC.apply(loans, B.loan_changes(b), "loan_id", C.update_loans, [(customers, SC.loan_customers)]).next


@register("upsert_records_stored", same_as="upsert_records")
def _upsert_records_stored(b):
    records, = _bucketed(b, "upsert_records", "records")
    return SC.apply(records, B.records_batch(b), "id", lambda rows, batch: C.upsert_records(rows, batch, NOW_TS)).next


@register("insert_loans_stored", same_as="insert_loans")
def _insert_loans_stored(b):
    loans, customers = _bucketed(b, "insert_loans", "loans", "customers")
    return SC.apply(loans, B.loans_batch(b), C.hash_id("LOAN", "source_id"),
                    lambda rows, batch, c: C.insert_loans(rows, batch, c, AS_OF_TXN), [(customers, "customer_id")]).next


# ---------------------------------------------------------------- maintained constraints

@lru_cache(8)
def _constraint_root(application: str, sf_dir: str) -> str:
    """All rows of all tables in two batches; the second also takes some rows
    out and puts them back."""
    spark = SparkSession.getActiveSession()
    root, b = scratch_path(spark, "constraints"), Bank(spark, sf_dir)
    tables = {t: b.table(t) for t in CN.schemas.PRIMARY_KEYS}

    def late(t):
        return F.pmod(F.xxhash64(CN.schemas.PRIMARY_KEYS[t]), F.lit(10)) == 3
    state = CN.ConstraintState(spark, root)
    state.apply({t: CN.images(df.filter(~late(t))) for t, df in tables.items()}, 0)
    accounts = tables["accounts"].filter(~late("accounts") & (F.col("status") == "ACTIVE"))
    second = {t: CN.images(df.filter(late(t))) for t, df in tables.items()}
    state.apply(second | {"accounts": second["accounts"].unionByName(CN.images(accounts, -1))}, 1)
    state.apply({"accounts": CN.images(accounts)}, 2)
    return root


def _constraints(b):
    return CN.ConstraintState(b.spark, _constraint_root(b.spark.sparkContext.applicationId, b.sf_dir))


@register("key_constraints_kept", same_as="key_constraints_report")
def _key_constraints_kept(b):
    """The key report from sums per batch: no table is read for it."""
    return _constraints(b).report().filter("check_kind <> 'foreign_key'").drop("parent_table")


@register("orphan_report_kept", same_as="orphan_report")
def _orphan_report_kept(b):
    return _constraints(b).report().filter("check_kind = 'foreign_key'").select(
        F.col("table_name").alias("child_table"), "column", "parent_table", F.col("violations").alias("orphans"))


@register("fk_exists_kept", same_as="fk_exists")
def _fk_exists_kept(b):
    """Alerts of a batch without a customer, from the parts of its keys."""
    check = next(c for c in CN.CHECKS if (c.table, c.column, c.kind) == ("fraud_alerts", "customer_id", "foreign_key"))
    return _constraints(b).missing_parents(check, B.alerts_batch(b)).select(
        C.hash_id("AL", "source_id").alias("change_key"), F.lit("parent not found: customer_id").alias("reason"))


# ---------------------------------------------------------------- 2.12 table versions

CHANGE_LOG_SQL = """SELECT concat('ACC', CAST(user_id AS VARCHAR)) AS account_number,
 CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
 CAST(value AS DECIMAL(15,2)) AS balance, ts AS change_ts, event_id AS _seq FROM events"""


def _as_of_sql(as_of):
    return f"""SELECT account_number, balance, change_ts AS last_change_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY change_ts DESC, _seq DESC) AS rn
  FROM ({CHANGE_LOG_SQL}) log WHERE change_ts <= TIMESTAMP '{as_of}') r WHERE rn = 1 AND op <> 'DELETE'"""


NOW = "2024-01-24 00:00:00"


def _as_of(b, as_of):
    return V.table_as_of(B.account_change_log(b), "account_number", as_of, now=NOW)


@register("hourly_deposits", f"""
WITH cur AS ({_as_of_sql("9999-12-31 00:00:00")})
SELECT c.branch_name, CAST(SUM(cur.balance) AS DECIMAL(38,2)) AS total_deposits, COUNT(*) AS accounts
FROM cur JOIN accounts a ON cur.account_number = a.account_number
 JOIN customers c ON a.customer_id = c.customer_id GROUP BY 1""")
def _hourly_deposits(b):
    """The hourly deposit task: live balances per branch, keyed by run hour."""
    log = B.account_changes_from(_events(b))
    return J.hourly_deposits(b.spark, log, _account_branch(b), "account_number", RUN_HOUR,
                             scratch_path(b.spark, "hourly_deposits"))


@register("table_as_of", _as_of_sql(AS_OF_2))
def _table_as_of(b):
    return _as_of(b, AS_OF_2)


@register("cdc_changes", f"""
WITH o AS ({_as_of_sql(AS_OF_1)}), n AS ({_as_of_sql(AS_OF_2)})
SELECT COALESCE(o.account_number, n.account_number) AS account_number,
 CASE WHEN o.account_number IS NULL THEN 'INSERT' WHEN n.account_number IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
 o.balance AS old_balance, o.last_change_ts AS old_last_change_ts, n.balance AS new_balance,
 n.last_change_ts AS new_last_change_ts
FROM o FULL OUTER JOIN n ON o.account_number = n.account_number
WHERE o.account_number IS NULL OR n.account_number IS NULL OR o.balance IS DISTINCT FROM n.balance
 OR o.last_change_ts IS DISTINCT FROM n.last_change_ts""")
def _cdc_changes(b):
    return V.cdc_changes(_as_of(b, AS_OF_1), _as_of(b, AS_OF_2), "account_number", ["balance", "last_change_ts"])


@register("cdc_net_changes", same_as="cdc_changes")
def _cdc_net_changes(b):
    """The same diff from the log's interval alone, by a consumer whose position is the first time."""
    reader = V.ChangeReader(b.spark, scratch_path(b.spark, "net_changes"), "account_number", ["balance", "last_change_ts"])
    reader.commit(AS_OF_1)
    return reader.read(B.account_change_log(b), AS_OF_2)


@lru_cache(8)
def _history_root(application: str, sf_dir: str) -> str:
    """The change log in three appends, the last one with late changes, and
    snapshots made before, between and after them."""
    spark = SparkSession.getActiveSession()
    root = scratch_path(spark, "history")
    b = Bank(spark, sf_dir)
    log, history = B.account_change_log(b), _history_of(b, root)
    late, early = F.pmod(F.col("_seq"), F.lit(10)) == 3, F.col("change_ts") < F.lit(AS_OF_1).cast("timestamp_ntz")
    history.append(log.filter(~late & early))
    history.snapshot("2024-01-05 00:00:00")
    history.append(log.filter(~late & ~early))
    history.snapshot("2024-01-15 00:00:00")
    history.append(log.filter(late))
    history.snapshot("2024-01-08 00:00:00")
    return root


def _history_of(b, root):
    return History(b.spark, root, B.account_change_log(b).schema, "account_number")


def _history(b):
    return _history_of(b, _history_root(b.spark.sparkContext.applicationId, b.sf_dir))


@register("table_as_of_stored", same_as="table_as_of")
def _table_as_of_stored(b):
    """The version from the nearest snapshot, the later days and late appends."""
    return _history(b).as_of(AS_OF_2)


@register("table_as_of_stored_early", _as_of_sql("2024-01-03 12:00:00"))
def _table_as_of_stored_early(b):
    """Before every snapshot: replayed from the first days of the log."""
    return _history(b).as_of("2024-01-03 12:00:00")


@register("cdc_changes_stored", same_as="cdc_changes")
def _cdc_changes_stored(b):
    return V.cdc_changes(_history(b).as_of(AS_OF_1), _history(b).as_of(AS_OF_2), "account_number", ["balance", "last_change_ts"])


@register("cdc_stream", _as_of_sql("9999-12-31 00:00:00"))
def _cdc_stream(b):
    """The change log consumed as a stream; the current table is the last
    change per key over all compacted batches, deletes dropped."""
    log = B.account_changes_from(_events(b))
    data = J.run_cdc(b.spark, log, "cdc_accounts", "account_number")
    compacted = b.spark.read.schema(log.schema).parquet(data).drop("_batch")
    return V.table_as_of(compacted, "account_number", "9999-12-31 00:00:00")


@register("clone_table", _as_of_sql(AS_OF_2))
def _clone_table(b):
    return V.clone_table(_as_of(b, AS_OF_2), scratch_path(b.spark, "clone_accounts"))


# ---------------------------------------------------------------- 2.1 / 2.2 sinks and shapes

@register("camel_case_columns", """
SELECT transaction_id AS "transactionId", account_number AS "accountNumber", amount,
 transaction_type AS "transactionType", currency, merchant_name AS "merchantName", location,
 risk_factor AS "riskFactor", status, timestamp FROM transactions""")
def _camel_case_columns(b):
    return SK.camel_case_columns(b.transactions)


@register("json_rows", """
SELECT CAST(json_object('customerId', customer_id, 'name', name, 'email', email, 'phone', phone,
 'segment', segment, 'lifetimeValue', CAST(lifetime_value AS DOUBLE), 'branchName', branch_name,
 'riskScore', risk_score, 'joinedDate', joined_date) AS VARCHAR) AS json FROM customers""")
def _json_rows(b):
    c = b.customers.withColumn("lifetime_value", F.col("lifetime_value").cast("double"))
    return SK.json_rows(c)


@register("refresh_daily_branch", DAILY_BRANCH_SQL)
def _refresh_daily_branch(b):
    return SK.refresh_daily_branch(b, scratch_path(b.spark, "daily_branch"))


# ---------------------------------------------------------------- 2.1 file loads

FILE_ROWS = 1000  # customer numbers of a staged file


def _stage_files(b, *names):
    """Customers written by Spark as the files of a load, ``FILE_ROWS`` customer
    numbers to a file: CSV of two kinds with different column orders and some
    malformed amounts, JSON (one row of one file with a foreign key), PARQUET,
    and CSV with a foreign column."""
    root = scratch_path(b.spark, "stage")
    c = b.customers
    number = F.substring("customer_id", 4, 20).cast("bigint")
    file = F.floor(number / FILE_ROWS).cast("int")
    n = (c.agg(F.max(file)).first()[0] or 0) + 1
    c = c.repartitionById(n, file).persist()  # dealt to the files once, for all folders
    text = c.select(*[F.col(x).cast("string").alias(x) for x in c.columns]).withColumn(
        "lifetime_value", F.when(number % 50 == 0, F.lit("n/a")).otherwise(F.col("lifetime_value")))

    write = {
        "customers_csv/a": lambda p: text.filter(number % 2 == 0).write.option("header", True).csv(p),
        "customers_csv/b": lambda p: text.filter(number % 2 == 1).select(*reversed(text.columns)).write.option("header", True).csv(p),
        "customers_json": lambda p: c.write.json(p),
        "customers_late_json": lambda p: c.withColumn("nickname", F.when(number == 1490, F.col("name"))).write.json(p),
        "customers_parquet": lambda p: c.write.parquet(p),
        "customers_extra_csv": lambda p: text.withColumn("nickname", F.col("name")).write.option("header", True).csv(p),
    }
    sources = []
    for name in names:
        write[name](f"{root}/{name}")
        sources.append((f"{root}/{name}", "CSV" if "csv" in name else "JSON" if "json" in name else "PARQUET"))
    c.unpersist()
    return root, sources


def _copy(b, *names, skip_header=1):
    """COPY the named files into a table that holds the frozen customers already."""
    root, sources = _stage_files(b, *names)
    table, history = f"{root}/_table", f"{root}/_history"
    b.customers.filter(F.col("risk_score") > 95).write.parquet(table)
    return I.copy_into(b.spark, sources, b.customers.schema, root, table, history, now=LOAD_NOW, skip_header=skip_header)


GOOD_CSV = "CAST(substr(customer_id, 4) AS BIGINT) % 50 <> 0"
ODD = "CAST(substr(customer_id, 4) AS BIGINT) % 2"
FILE = f"CAST(substr(customer_id, 4) AS BIGINT) // {FILE_ROWS}"
HELD = "SELECT * FROM customers WHERE risk_score > 95"


@register("copy_into", f"{HELD} UNION ALL SELECT * FROM customers WHERE {GOOD_CSV}")
def _copy_into(b):
    """Two files with different column orders, appended to what the table holds."""
    return _copy(b, "customers_csv/a", "customers_csv/b")[0]


@register("copy_into_schema_check", f"""
{HELD} UNION ALL SELECT * FROM customers WHERE {GOOD_CSV} UNION ALL SELECT * FROM customers UNION ALL SELECT * FROM customers
UNION ALL SELECT * FROM customers WHERE {FILE} NOT IN (SELECT {FILE} FROM customers WHERE customer_id = 'CUS1490')""")
def _copy_into_schema_check(b):
    """All files; the CSV with a foreign column and the JSON with a foreign
    key in a late row load nothing."""
    return _copy(b, "customers_csv/a", "customers_csv/b", "customers_json", "customers_late_json", "customers_parquet",
                 "customers_extra_csv")[0]


def _log_sql(folder, fmt, where="true", rows="n", errors="0", refused="false"):
    """The log rows of a folder's files; ``rows``, ``errors`` and ``refused`` are of (n, good, late)."""
    return f"""SELECT file_name, '{fmt}' AS file_format, '@BANKING_STAGE' AS stage,
 CASE WHEN {refused} THEN 'FAILED' ELSE 'LOADED' END AS status,
 CAST(CASE WHEN {refused} THEN 0 ELSE {rows} END AS BIGINT) AS rows_loaded,
 CAST(CASE WHEN {refused} THEN 0 ELSE {errors} END AS BIGINT) AS errors,
 CASE WHEN {refused} THEN 'field nickname not found in destination' END AS message,
 'LD-' || upper(sha256(concat_ws('|', file_name, '{fmt}', '{LOAD_NOW}'))) AS load_id, TIMESTAMP '{LOAD_NOW}' AS loaded_at
FROM (SELECT '{folder}/part-' || lpad(CAST({FILE} AS VARCHAR), 5, '0') AS file_name, COUNT(*) AS n,
 COUNT(*) FILTER (WHERE {GOOD_CSV}) AS good, COUNT(*) FILTER (WHERE customer_id = 'CUS1490') > 0 AS late
 FROM customers WHERE {where} GROUP BY {FILE}) g"""


@register("load_history", "\nUNION ALL\n".join([
    *[_log_sql(f"customers_csv/{f}", "CSV", f"{ODD} = {k}", "good", "n - good") for k, f in enumerate("ab")],
    _log_sql("customers_json", "JSON"), _log_sql("customers_late_json", "JSON", refused="late"),
    _log_sql("customers_parquet", "PARQUET"), _log_sql("customers_extra_csv", "CSV", refused="true")]))
def _load_history(b):
    """The stored log, one row per file."""
    return _copy(b, "customers_csv/a", "customers_csv/b", "customers_json", "customers_late_json", "customers_parquet",
                 "customers_extra_csv")[1].drop("fingerprint")


# ---------------------------------------------------------------- 2.11 governance reports

OBSERVED_GRANTS_SQL = """SELECT DISTINCT upper(regexp_extract(trim(regexp_replace(trim(query_text), '^/\\*[\\s\\S]*?\\*/', '')),
   '^([A-Za-z]+)', 1)) AS privilege, 'TABLE' AS object_type,
 upper(regexp_extract(query_text, '(?i)(FROM|INTO|UPDATE)\\s+([A-Za-z_]+)', 2)) AS object_name, role_name AS grantee
FROM query_log WHERE regexp_extract(query_text, '(?i)(FROM|INTO|UPDATE)\\s+([A-Za-z_]+)', 2) <> ''"""


def _grants_values_sql():
    rows = ", ".join(f"('{p}', '{t}', '{n}', '{g}')" for p, t, n, g in G.setup_grant_rows())
    return f"SELECT * FROM (VALUES {rows}) v(privilege, object_type, object_name, grantee)"


@register("grants_report", f"""
SELECT * FROM ({_grants_values_sql()} UNION {OBSERVED_GRANTS_SQL}) g
ORDER BY grantee, object_type, privilege, object_name LIMIT 100""")
def _grants_report(b):
    grants = G.setup_grants(b.spark).unionByName(G.observed_grants(b.query_log)).distinct()
    return G.grants_report(grants)


_ACTION_SQL = """CASE upper(regexp_extract(trim(regexp_replace(trim(query_text), '^/\\*[\\s\\S]*?\\*/', '')), '^([A-Za-z]+)', 1))
   WHEN 'SELECT' THEN 'read' WHEN 'SHOW' THEN 'read' WHEN 'INSERT' THEN 'create'
   WHEN 'UPDATE' THEN 'update' WHEN 'MERGE' THEN 'update' WHEN 'DELETE' THEN 'delete' ELSE 'update' END"""


@register("permission_matrix", f"""
WITH a AS (SELECT role_name, {_ACTION_SQL} AS action,
  CASE upper(regexp_extract(query_text, '(?i)(FROM|INTO|UPDATE)\\s+([A-Za-z_]+)', 2)) WHEN 'CUSTOMERS' THEN 'customers'
   WHEN 'ACCOUNTS' THEN 'accounts' WHEN 'TRANSACTIONS' THEN 'transactions' WHEN 'LOANS' THEN 'loans'
   WHEN 'BRANCH_PERFORMANCE' THEN 'branches' WHEN 'FRAUD_ALERTS' THEN 'fraud' WHEN 'QUERY_HISTORY' THEN 'query-history'
   ELSE 'sql' END AS resource FROM query_log)
SELECT role_name AS role, action, resource,
 CASE WHEN role_name = 'BANKING_ADMIN' THEN true
      WHEN role_name = 'BANKING_DATA_ENGINEER' THEN action <> 'delete' AND resource <> 'security'
      WHEN role_name = 'BANKING_ANALYST' THEN action = 'read' AND resource NOT IN ('security', 'monitoring', 'upload', 'recovery')
      ELSE resource = 'dashboard' AND action = 'read' END AS allowed,
 COUNT(*) AS attempts
FROM a GROUP BY 1, 2, 3, 4""")
def _permission_matrix(b):
    return G.permission_usage(b.query_log)


# ---------------------------------------------------------------- 2.1 stored layout

@lru_cache(8)
def _stored_root(application: str, sf_dir: str) -> str:
    """Written once per application and data folder, shared by the queries that read it."""
    spark = SparkSession.getActiveSession()
    root, b = scratch_path(spark, "stored"), Bank(spark, sf_dir)
    ST.write_tables(b, root, ("accounts", "customers"))
    feeds.write_transactions(b.transactions, root)
    return root


def _stored(b):
    """The banking tables in the stored layout (fixed schemas, transactions
    partitioned by day, with their day counts)."""
    return ST.StoredBank(b.spark, _stored_root(b.spark.sparkContext.applicationId, b.sf_dir))


@register("scan_stored_table", "SELECT *, CAST(timestamp AS DATE) AS transaction_date FROM transactions")
def _scan_stored_table(b):
    """scan(name): the stored table read with its fixed schema."""
    return _stored(b).transactions


@register("daily_transactions_stored", f"""
SELECT strftime(timestamp, '%Y-%m-%d') AS date, COUNT(*) AS count, CAST(COALESCE(SUM(amount), 0) AS DECIMAL(38,2)) AS amount
FROM transactions WHERE timestamp >= CAST(DATE '{AS_OF_TXN}' - INTERVAL 7 DAY AS TIMESTAMP)
GROUP BY 1 ORDER BY 1""")
def _daily_transactions_stored(b):
    """The dashboard's 7-day series on the stored layout: the window becomes
    a partition filter, so only the last days' folders are read."""
    from ..operators import metrics
    return metrics.daily_transactions(_stored(b), AS_OF_TXN)


# ---------------------------------------------------------------- 2.3 feeds of the stored layout

@register("recent_activity_stored", same_as="recent_activity")
def _recent_activity_stored(b):
    """The dashboard feed from the newest days only."""
    return feeds.recent_activity(_stored(b))


@register("txn_enriched_stored", same_as="txn_enriched")
def _txn_enriched_stored(b):
    return feeds.txn_enriched(_stored(b), tx_type="deposit", risk="ALL")


@register("optional_filter_stored", same_as="optional_filter")
def _optional_filter_stored(b):
    return feeds.txn_enriched(_stored(b), tx_type=" transfer ", risk="high")


@register("grid_search_stored", same_as="grid_search")
def _grid_search_stored(b):
    """A search reads days backwards, in growing steps, until k rows are found."""
    return feeds.txn_enriched(_stored(b), search="Merchant 1")


# ---------------------------------------------------------------- 2.3 indexed search

@lru_cache(8)
def _index_root(application: str, sf_dir: str, name: str) -> str:
    """Built once per application and data folder, shared by the searches."""
    spark = SparkSession.getActiveSession()
    root = scratch_path(spark, f"search-{name}")
    rows, order, index = _searched(Bank(spark, sf_dir), name, root)
    index.add(rows, order)
    return root


def _searched(b, name, root):
    """Rows, sort order and index of a searched table."""
    if name == "customers":
        rows, key, columns, order = b.customers, "customer_id", ["name", "email"], ["name", "customer_id"]
    else:
        rows, key = lists.enrich_all_customer_names(b.transactions, b), "transaction_id"
        columns, order = grid.GRID_SEARCH_COLUMNS["transactions"], ["merchant_name", "transaction_id"]
    return rows, order, SearchIndex(b.spark, root, rows.schema, key, columns)


def _index(b, name):
    return _searched(b, name, _index_root(b.spark.sparkContext.applicationId, b.sf_dir, name))[2]


@register("customer_search_indexed", same_as="customer_search")
def _customer_search_indexed(b):
    """The customer search by trigram postings: candidate segments only."""
    return lists.customer_search_indexed(_index(b, "customers"), "eR#0000001")


@register("customer_search_short", f"""
SELECT {CUST_SQL_COLS} FROM customers
WHERE LOWER(name) LIKE '%07%' OR LOWER(email) LIKE '%07%' ORDER BY name NULLS LAST, customer_id LIMIT 200""")
def _customer_search_short(b):
    """Two characters: looked up as the beginning of pieces."""
    return lists.customer_search_indexed(_index(b, "customers"), "07")


@register("customer_search_wildcard", f"""
SELECT {CUST_SQL_COLS} FROM customers
WHERE LOWER(name) LIKE '%r#%_12%' OR LOWER(email) LIKE '%r#%_12%' ORDER BY name NULLS LAST, customer_id LIMIT 200""")
def _customer_search_wildcard(b):
    return lists.customer_search_indexed(_index(b, "customers"), "r#%_12")


@register("grid_search_indexed", same_as="grid_search")
def _grid_search_indexed(b):
    """The transactions grid's search by trigram postings."""
    return lists.txn_search_indexed(_index(b, "transactions"), "Merchant 1")


@register("grid_search_id", f"""
SELECT {TXN_SQL_COLS} {TXN_SQL_FROM}
WHERE contains(lower(COALESCE(t.transaction_id, '')), '777')
   OR contains(lower(COALESCE(t.account_number, '')), '777')
   OR contains(lower(COALESCE(c.name, 'Unknown')), '777')
   OR contains(lower(COALESCE(t.merchant_name, '')), '777')
ORDER BY t.timestamp DESC NULLS FIRST, t.transaction_id LIMIT 200""")
def _grid_search_id(b):
    return lists.txn_search_indexed(_index(b, "transactions"), "777")
