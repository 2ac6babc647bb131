"""Bulk change application: the single-row write handlers as batch jobs.

``apply(base, batch, parents) -> Changed(next, rejects)``. The rules
(required fields, defaults, parent checks, "not found") are the handlers'
rules, applied to a whole DataFrame of changes at once:

* required fields missing -> reject ``missing required field``
* parent key absent       -> reject ``parent not found`` (left join flag)
* insert of a stored or repeated key -> reject ``duplicate key``
* update of an absent key -> reject ``not found``
* several changes of one key -> the latest valid one (largest ``_seq``) wins,
  picked with a ``max(struct(_seq, ...))`` aggregate. Its partial step
  combines a hot key inside each task before the shuffle, so the key never
  lands in one task whole.

Plain parquet has no MERGE, so the next version comes from one full outer
join of the base with the changes; callers write it to a new path, never
over the one being read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import default_if_blank, digits_only
from ..sources import schemas


@dataclass
class Changed:
    next: DataFrame
    rejects: DataFrame
    accepted: DataFrame


def hash_id(prefix: str, *cols) -> Column:
    """Deterministic id from source columns (replaces the random ids): the
    full digest over length-prefixed parts, so no two part lists join alike."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    txt = F.concat(*[F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.sha2(txt, 256)))


def _missing(c: str) -> Column:
    col = F.col(c)
    return col.isNull() | (col.cast("string") == "")


def _reject(df: DataFrame, reason, key: str) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(F.col(key).cast("string").alias("change_key"), reason.alias("reason"))


def validate(batch: DataFrame, key: str, required=(), fks=()) -> tuple[DataFrame, DataFrame]:
    """Split a batch into (valid rows, rejects(change_key, reason)).

    Every parent is read once: a left join flags the match, and both outputs
    come from the flagged rows. The first failed rule names the reason."""
    columns, flagged, reason = batch.columns, batch, F.lit(None).cast("string")
    for i, (col, parent, parent_key) in reversed(list(enumerate(fks))):
        keys = parent.select(F.col(parent_key).alias(f"_p{i}")).distinct()
        flagged = flagged.join(keys, F.col(col) == F.col(f"_p{i}"), "left")
        reason = F.when(F.col(f"_p{i}").isNull(), F.lit(f"parent not found: {col}")).otherwise(reason)
    if required:
        miss = reduce(lambda a, b: a | b, [_missing(c) for c in required])
        reason = F.when(miss, F.lit("missing required field")).otherwise(reason)
    flagged = flagged.withColumn("_reason", reason)
    return (flagged.filter(F.col("_reason").isNull()).select(*columns),
            _reject(flagged.filter(F.col("_reason").isNotNull()), F.col("_reason"), key))


def latest_per_key(changes: DataFrame, key: str, seq: str = "_seq", count: str | None = None) -> DataFrame:
    """Keep the change with the largest ``seq`` for every key (without a
    sequence, the largest row); ``count`` names a column for how many there were."""
    others = [c for c in changes.columns if c not in (key, seq)]
    order = [seq] if seq in changes.columns else []
    n = [F.count(F.lit(1)).alias(count)] if count else []
    packed = changes.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_w"), *n)
    return packed.select(key, *[F.col(f"_w.{c}").alias(c) for c in order + others], *([count] if count else []))


def _conform(df: DataFrame, table: str) -> DataFrame:
    schema = schemas.BY_NAME[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _insert(base: DataFrame, shaped: DataFrame, rejects: DataFrame, table: str) -> Changed:
    """Add rows whose key is new. A key that is stored already, or that comes
    several times in the batch, is rejected (of equal keys in the batch one
    row is taken), so a batch applied twice adds nothing the second time."""
    pk = schemas.PRIMARY_KEYS[table]
    one = latest_per_key(_conform(shaped, table), pk, count="_n")
    stored = base.select(F.col(pk).cast(schemas.BY_NAME[table][pk].dataType).alias("_stored")).distinct()
    j = one.join(stored, F.col(pk) == F.col("_stored"), "left")
    fresh = _conform(j.filter(F.col("_stored").isNull()), table)
    again = F.col("_n") - F.when(F.col("_stored").isNull(), 1).otherwise(0)
    dups = _reject(j.select(pk, F.explode(F.array_repeat(F.lit("duplicate key"), again.cast("int"))).alias("_r")), F.col("_r"), pk)
    return Changed(_conform(base, table).unionByName(fresh), rejects.unionByName(dups), fresh)


def _merge(base: DataFrame, latest: DataFrame, table: str, key: str) -> DataFrame:
    """One full outer join of the base with one change per key, the shape of
    a MERGE: the base is read and shuffled once. ``_old`` and ``_new`` are
    the two rows as structs, null where a side has none."""
    change_cols = [c for c in latest.columns if c != key]
    base_c = _conform(base, table)
    return (base_c.select(F.col(key).alias("_k"), F.struct(*base_c.columns).alias("_old"))
            .join(latest.select(F.col(key).alias("_k"), F.struct(*change_cols).alias("_new")), "_k", "full_outer"))


def _update(base: DataFrame, changes: DataFrame, table: str, key: str, shape, keep=(),
            required=(), fks=()) -> Changed:
    """Whole-row replace of matched keys; ``shape(df)`` maps a validated change
    (with the stored ``keep`` columns, prefixed ``old_``) to table rows.

    Changes apply in sequence: an invalid one is rejected and leaves the row
    as the valid ones before it made it. So all changes are validated first,
    the last valid one per key wins, and every invalid change is rejected, as
    is every change of a key that is not stored ("not found").
    """
    valid, rejects = validate(changes, key, required, fks)
    schema = schemas.BY_NAME[table]
    j = _merge(base, latest_per_key(valid, key, count="_n"), table, key)
    hit = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    flat = j.filter(hit).select(F.col("_k").alias(key), "_new.*", *[F.col(f"_old.{c}").alias(f"old_{c}") for c in keep])
    change_cols = [c for c in valid.columns if c != key]
    wide = j.filter(F.col("_old").isNotNull()).select(
        F.struct(F.col("_k").alias("k"), F.col("_old").alias("old"), hit.alias("hit")).alias(key),
        *[F.col(f"_new.{c}").alias(c) for c in change_cols], *[F.col(f"_old.{c}").alias(f"old_{c}") for c in keep])
    row, shaped = F.col(key), shape(wide)
    nxt = shaped.select(*[
        row["k"].cast(f.dataType).alias(f.name) if f.name == key else
        F.when(row["hit"], F.col(f.name).cast(f.dataType)).otherwise(row["old"][f.name]).alias(f.name)
        for f in schema.fields])
    unknown = j.filter(F.col("_old").isNull()).select(
        "_k", F.explode(F.array_repeat(F.lit("not found"), F.col("_new._n").cast("int"))).alias("_r"))
    return Changed(nxt, rejects.unionByName(_reject(unknown, F.col("_r"), "_k")), _conform(shape(flat), table))


# -- customers ------------------------------------------------------------

def _customer_rows(df: DataFrame, as_of: str, id_col: Column) -> DataFrame:
    return df.select(
        id_col.alias("customer_id"), "name", "email", digits_only("phone").alias("phone"),
        default_if_blank("segment", "BRONZE").alias("segment"),
        F.coalesce(F.col("lifetime_value").cast("decimal(15,2)"), F.lit(0)).alias("lifetime_value"),
        default_if_blank("branch_name", "Main Branch").alias("branch_name"),
        F.coalesce(F.col("risk_score").cast("int"), F.lit(0)).alias("risk_score"),
        (F.col("old_joined_date") if "old_joined_date" in df.columns
         else F.lit(as_of).cast("date")).alias("joined_date"))


def insert_customers(base: DataFrame, batch: DataFrame, as_of: str) -> Changed:
    """Need name and email; id CUS+hash; BRONZE, 'Main Branch', 0 defaults;
    phone digits only; joined today (``as_of``)."""
    valid, rejects = validate(batch.withColumn("_k", hash_id("CUS", "name", "email")), "_k", ["name", "email"])
    return _insert(base, _customer_rows(valid, as_of, F.col("_k")), rejects, "customers")


def update_customers(base: DataFrame, changes: DataFrame) -> Changed:
    return _update(base, changes, "customers", "customer_id",
                   lambda d: _customer_rows(d, "", F.col("customer_id")), keep=["joined_date"],
                   required=["name", "email"])


# -- accounts -------------------------------------------------------------

def _account_rows(df: DataFrame) -> DataFrame:
    return df.select("account_number", "customer_id", "account_type",
                     F.coalesce(F.col("balance").cast("decimal(15,2)"), F.lit(0)).alias("balance"),
                     default_if_blank("status", "ACTIVE").alias("status"))


def insert_accounts(base: DataFrame, batch: DataFrame, customers: DataFrame) -> Changed:
    valid, rejects = validate(batch, "account_number", ["account_number", "customer_id", "account_type"],
                              [("customer_id", customers, "customer_id")])
    return _insert(base, _account_rows(valid), rejects, "accounts")


def update_accounts(base: DataFrame, changes: DataFrame, customers: DataFrame) -> Changed:
    return _update(base, changes, "accounts", "account_number", _account_rows,
                   required=["customer_id", "account_type"], fks=[("customer_id", customers, "customer_id")])


# -- transactions ---------------------------------------------------------

def _transaction_rows(df: DataFrame, id_col: Column, ts: Column) -> DataFrame:
    return df.select(
        id_col.alias("transaction_id"), "account_number",
        F.col("amount").cast("decimal(15,2)").alias("amount"), "transaction_type",
        default_if_blank("currency", "USD").alias("currency"),
        F.coalesce(F.col("merchant_name"), F.lit("")).alias("merchant_name"),
        F.coalesce(F.col("location"), F.lit("")).alias("location"),
        default_if_blank("risk_factor", "LOW").alias("risk_factor"),
        default_if_blank("status", "COMPLETED").alias("status"), ts.alias("timestamp"))


def insert_transactions(base: DataFrame, batch: DataFrame, accounts: DataFrame) -> Changed:
    """Need account, type, amount; account must exist; USD / COMPLETED /
    LOW / '' defaults; the change time is the row time."""
    b = batch.withColumn("_k", hash_id("TX", "source_id"))
    valid, rejects = validate(b, "_k", ["account_number", "transaction_type", "amount"],
                              [("account_number", accounts, "account_number")])
    return _insert(base, _transaction_rows(valid, F.col("_k"), F.col("change_ts")), rejects, "transactions")


def update_transactions(base: DataFrame, changes: DataFrame, accounts: DataFrame) -> Changed:
    """Whole-row replace; the stored timestamp is kept."""
    return _update(base, changes, "transactions", "transaction_id",
                   lambda d: _transaction_rows(d, F.col("transaction_id"), F.col("old_timestamp")),
                   keep=["timestamp"], required=["account_number", "transaction_type", "amount"],
                   fks=[("account_number", accounts, "account_number")])


# -- loans ----------------------------------------------------------------

def _loan_rows(df: DataFrame, id_col: Column, due: Column) -> DataFrame:
    amount = F.col("amount").cast("decimal(15,2)")
    return df.select(
        id_col.alias("loan_id"), "customer_id", "category", amount.alias("amount"),
        F.col("interest_rate").cast("decimal(5,2)").alias("interest_rate"),
        F.col("term_months").cast("int").alias("term_months"),
        F.coalesce(F.col("emi").cast("decimal(15,2)"), F.lit(0)).alias("emi"),
        F.coalesce(F.col("remaining_balance").cast("decimal(15,2)"), amount).alias("remaining_balance"),
        F.coalesce(F.col("recovered_amount").cast("decimal(15,2)"), F.lit(0)).alias("recovered_amount"),
        due.alias("next_due_date"),
        default_if_blank("risk_rating", "A").alias("risk_rating"),
        default_if_blank("status", "ACTIVE").alias("status"))


LOAN_REQUIRED = ["category", "amount", "interest_rate", "term_months"]


def insert_loans(base: DataFrame, batch: DataFrame, customers: DataFrame, as_of: str,
                 due_days: int = 30) -> Changed:
    """Need customer, category, amount, rate, term; customer must exist;
    emi 0, remaining = amount, ACTIVE, A, recovered 0; due date defaults to
    today + 30 days (the entry form's default)."""
    b = batch.withColumn("_k", hash_id("LOAN", "source_id"))
    valid, rejects = validate(b, "_k", ["customer_id"] + LOAN_REQUIRED, [("customer_id", customers, "customer_id")])
    due = F.coalesce(F.col("next_due_date").cast("date"), F.date_add(F.lit(as_of).cast("date"), due_days))
    return _insert(base, _loan_rows(valid, F.col("_k"), due), rejects, "loans")


def update_loans(base: DataFrame, changes: DataFrame, customers: DataFrame) -> Changed:
    """Loan update: a missing customer id comes from the stored row; a
    missing, blank or 'null' due date keeps the stored date."""
    stored = base.select("loan_id", F.col("customer_id").alias("_old_c"))
    # resolve the customer before validation; unknown loans without a
    # customer id are "not found" in the reference, as here (old is NULL)
    resolved = (changes.join(stored, "loan_id", "left")
                .withColumn("customer_id", F.coalesce(F.nullif(F.col("customer_id"), F.lit("")), F.col("_old_c")))
                .drop("_old_c"))
    missing_cust = resolved.filter(F.col("customer_id").isNull())
    resolved = resolved.filter(F.col("customer_id").isNotNull())
    due_txt = F.trim(F.col("next_due_date").cast("string"))
    has_due = F.col("next_due_date").isNotNull() & (due_txt != "") & (due_txt != "null")
    res = _update(base, resolved.withColumn("_has_due", has_due), "loans", "loan_id",
                  lambda d: _loan_rows(d, F.col("loan_id"),
                                       F.when(F.col("_has_due"), F.to_date(due_txt, "yyyy-MM-dd"))
                                        .otherwise(F.col("old_next_due_date"))),
                  keep=["next_due_date"], required=LOAN_REQUIRED,
                  fks=[("customer_id", customers, "customer_id")])
    return Changed(res.next, res.rejects.unionByName(_reject(missing_cust, "not found", "loan_id")), res.accepted)


# -- branches -------------------------------------------------------------

def _branch_rows(df: DataFrame, id_col: Column) -> DataFrame:
    def z(c, t):
        return F.coalesce(F.col(c).cast(t), F.lit(0)).alias(c)
    return df.select(id_col.alias("branch_id"), "branch_name", "city", "manager",
                     z("customer_count", "bigint"), z("active_loans", "bigint"),
                     z("total_deposits", "decimal(15,2)"), z("total_revenue", "decimal(15,2)"),
                     z("transaction_count", "bigint"), z("growth_rate", "decimal(5,2)"))


def insert_branches(base: DataFrame, batch: DataFrame) -> Changed:
    b = batch.withColumn("_k", hash_id("BR", "branch_name", "city", "manager"))
    valid, rejects = validate(b, "_k", ["branch_name", "city", "manager"])
    return _insert(base, _branch_rows(valid, F.col("_k")), rejects, "branch_performance")


def update_branches(base: DataFrame, changes: DataFrame) -> Changed:
    return _update(base, changes, "branch_performance", "branch_id",
                   lambda d: _branch_rows(d, F.col("branch_id")), required=["branch_name", "city", "manager"])


# -- fraud alerts ---------------------------------------------------------

def _alert_rows(df: DataFrame, id_col: Column, ts: Column) -> DataFrame:
    return df.select(
        id_col.alias("alert_id"), "transaction_id", "customer_id",
        F.col("amount").cast("decimal(15,2)").alias("amount"), "alert_type", ts.alias("timestamp"),
        F.coalesce(F.col("risk_score").cast("int"), F.lit(50)).alias("risk_score"),
        default_if_blank("status", "OPEN").alias("status"),
        F.coalesce(F.col("details"), F.lit("")).alias("details"))


def insert_fraud_alerts(base: DataFrame, batch: DataFrame, customers: DataFrame) -> Changed:
    """Need transaction, customer, amount, type; only the customer is
    checked (the transaction id is not, as in the reference)."""
    b = batch.withColumn("_k", hash_id("AL", "source_id"))
    valid, rejects = validate(b, "_k", ["transaction_id", "customer_id", "amount", "alert_type"],
                              [("customer_id", customers, "customer_id")])
    return _insert(base, _alert_rows(valid, F.col("_k"), F.col("change_ts")), rejects, "fraud_alerts")


def update_fraud_alerts(base: DataFrame, changes: DataFrame, customers: DataFrame) -> Changed:
    return _update(base, changes, "fraud_alerts", "alert_id",
                   lambda d: _alert_rows(d, F.col("alert_id"), F.col("old_timestamp")), keep=["timestamp"],
                   required=["transaction_id", "customer_id", "amount", "alert_type"],
                   fks=[("customer_id", customers, "customer_id")])


# -- records (upsert) -----------------------------------------------------

def upsert_records(base: DataFrame, batch: DataFrame, now: str) -> Changed:
    """Need name and email; details ''; updated_at = now on insert and
    update; created_at = now for new ids, kept for existing ones."""
    valid, rejects = validate(batch, "id", ["name", "email"])
    j = _merge(base, latest_per_key(valid, "id"), "records", "id")
    ts = F.lit(now).cast("timestamp_ntz")
    new = {"id": F.col("_k"), "name": F.col("_new.name"), "email": F.col("_new.email"),
           "details": F.coalesce(F.col("_new.details"), F.lit("")),
           "created_at": F.coalesce(F.col("_old.created_at"), ts), "updated_at": ts}
    changed = F.col("_new").isNotNull()
    nxt = j.select(*[F.when(changed, v).otherwise(F.col(f"_old.{c}")).alias(c) for c, v in new.items()])
    rows = j.filter(changed).select(*[v.alias(c) for c, v in new.items()])
    return Changed(_conform(nxt, "records"), rejects, _conform(rows, "records"))


# -- deletes --------------------------------------------------------------

# Which child rows a delete removes (one level only).
CASCADE = {
    "accounts": [("transactions", "account_number")],
    "transactions": [("fraud_alerts", "transaction_id")],
    "customers": [("accounts", "customer_id")],
    "loans": [], "branch_performance": [], "fraud_alerts": [], "records": [],
}


def delete_cascade(tables: dict, table: str, keys: DataFrame) -> dict:
    """Delete ``keys`` (one column, the primary key) from ``table`` and the
    direct children the handlers delete. Deeper descendants stay as orphans,
    as in the reference (they show as 'Unknown' in the enriched lists)."""
    pk = schemas.PRIMARY_KEYS[table]
    k = keys.select(F.col(keys.columns[0]).alias(pk))
    out = dict(tables)
    out[table] = tables[table].join(k, pk, "left_anti")
    for child, col in CASCADE[table]:
        out[child] = tables[child].join(k.select(F.col(pk).alias(col)), col, "left_anti")
    return out


# -- data quality ---------------------------------------------------------

def orphan_report(tables: dict) -> DataFrame:
    """Rows whose foreign key names no parent, per declared foreign key.

    Child rows are first counted per key value (partial aggregation: a hot
    key collapses inside each task), so the anti join against the parent
    keys sees each distinct value once instead of every child row. All
    children of a parent meet its keys in one join, so a parent is read once."""
    by_parent: dict[str, list[tuple[str, str]]] = {}
    for child, col, parent in schemas.FOREIGN_KEYS:
        by_parent.setdefault(parent, []).append((child, col))
    parts = []
    for parent, children in by_parent.items():
        counted = reduce(DataFrame.unionByName, [
            tables[child].filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_key"))
            .agg(F.count(F.lit(1)).alias("_n")).withColumn("_fk", F.lit(i)) for i, (child, col) in enumerate(children)])
        keys = tables[parent].select(F.col(schemas.PRIMARY_KEYS[parent]).alias("_key"))
        sums = counted.join(keys, "_key", "left_anti").agg(*[
            F.coalesce(F.sum(F.when(F.col("_fk") == i, F.col("_n"))), F.lit(0)).cast("bigint").alias(f"_{i}")
            for i in range(len(children))])
        parts.append(sums.select(F.inline(F.array(*[F.struct(
            F.lit(child).alias("child_table"), F.lit(col).alias("column"), F.lit(parent).alias("parent_table"),
            F.col(f"_{i}").alias("orphans")) for i, (child, col) in enumerate(children)]))))
    return reduce(DataFrame.unionByName, parts)


def key_constraints_report(tables: dict) -> DataFrame:
    """Primary key duplicates and NULL keys, unique and NOT NULL columns.

    One hash aggregate per key column: ``groupBy(col).count()`` gives the
    duplicated keys and, in its NULL group, the NULL keys. The NULL counts of
    a table's other columns ride in the aggregate of its primary key, so each
    key column costs one read of its table and nothing else does.
    """
    checks = [(t, "primary_key", pk) for t, pk in schemas.PRIMARY_KEYS.items()]
    checks += [("customers", "unique", "email"), ("branch_performance", "unique", "branch_name")]
    parts = []
    for table, kind, col in checks:
        others = [f.name for f in schemas.BY_NAME[table].fields if not f.nullable and f.name != col] if kind == "primary_key" else []
        g = tables[table].groupBy(col).agg(F.count(F.lit(1)).alias("n"),
                                           *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{c}") for c in others])
        dup = F.when(F.col(col).isNotNull() & (F.col("n") > 1), F.col("n"))
        bad = dup if kind == "unique" else F.when(F.col(col).isNull(), F.col("n")).otherwise(dup)
        found = g.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("_bad"),
                      *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(f"_null_{c}") for c in others])
        rows = [(kind, col, F.col("_bad"))] + [("not_null", c, F.col(f"_null_{c}")) for c in others]
        parts.append(found.select(F.inline(F.array(*[F.struct(
            F.lit(table).alias("table_name"), F.lit(k).alias("check_kind"), F.lit(c).alias("column"),
            v.cast("bigint").alias("violations")) for k, c, v in rows]))))
    return reduce(DataFrame.unionByName, parts)


def promo_upgrade(customers: DataFrame, ids: DataFrame, bonus: int = 100000) -> DataFrame:
    """Set segment PLATINUM and add ``bonus`` to lifetime value for the
    given customers (set-based form of the per-customer procedure)."""
    sel = ids.select(F.col(ids.columns[0]).alias("customer_id")).distinct().withColumn("_promo", F.lit(True))
    j = customers.join(sel, "customer_id", "left")
    hit = F.col("_promo").isNotNull()
    return j.select(
        "customer_id", "name", "email", "phone",
        F.when(hit, F.lit("PLATINUM")).otherwise(F.col("segment")).alias("segment"),
        F.when(hit, F.col("lifetime_value") + F.lit(bonus)).otherwise(F.col("lifetime_value"))
         .cast("decimal(15,2)").alias("lifetime_value"),
        "branch_name", "risk_score", "joined_date")
