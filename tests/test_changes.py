"""Bulk change application with the payloads of the reference's HTTP
scripts (FIXTURES.md section 1) as change batches."""

from __future__ import annotations

import datetime as dt
import decimal

from pyspark.sql import functions as F

from vaultline.operators import changes as C

CUST_BATCH = ("name string, email string, phone string, segment string, lifetime_value double, "
              "branch_name string, risk_score int")


def test_insert_customers_defaults_and_rejects(spark, bank):
    batch = spark.createDataFrame([
        ("E2E Test User", "e2e@example.com", "9876543210", "GOLD", 50000.0, "Main Branch", 15),
        ("RBAC User", "rbac@example.com", "+1-555-8888", "SILVER", 12000.0, None, 25),
        ("Blank Segment", "blank@example.com", "", "", None, "", None),
        ("No Email", None, "1", "GOLD", 1.0, None, 1),
    ], CUST_BATCH)
    res = C.insert_customers(bank.customers, batch, "2024-01-30")
    got = {r.name: r for r in res.accepted.collect()}
    assert got["E2E Test User"].phone == "9876543210" and got["E2E Test User"].segment == "GOLD"
    assert got["RBAC User"].phone == "15558888" and got["RBAC User"].branch_name == "Main Branch"
    b = got["Blank Segment"]
    assert (b.phone, b.segment, b.lifetime_value, b.branch_name, b.risk_score) == \
        (None, "BRONZE", decimal.Decimal("0.00"), "Main Branch", 0)
    assert all(r.joined_date == dt.date(2024, 1, 30) for r in got.values())
    assert all(r.customer_id.startswith("CUS") for r in got.values())
    assert [r.reason for r in res.rejects.collect()] == ["missing required field"]
    assert res.next.count() == bank.customers.count() + 3


def test_ids_are_deterministic(spark, bank):
    batch = spark.createDataFrame([("A", "a@x", None, None, None, None, None)], CUST_BATCH)
    a = C.insert_customers(bank.customers, batch, "2024-01-01").accepted.first().customer_id
    b = C.insert_customers(bank.customers, batch, "2024-01-01").accepted.first().customer_id
    assert a == b


def test_accounts_fk_and_update(spark, bank):
    batch = spark.createDataFrame([("E2E-ACC-1", "CUS1", "SAVINGS", 1000.0, "ACTIVE"),
                                   ("E2E-ACC-2", "CUS-NOPE", "SAVINGS", 1.0, None)],
                                  "account_number string, customer_id string, account_type string, "
                                  "balance double, status string")
    res = C.insert_accounts(bank.accounts, batch, bank.customers)
    assert [r.account_number for r in res.accepted.collect()] == ["E2E-ACC-1"]
    assert [r.reason for r in res.rejects.collect()] == ["parent not found: customer_id"]
    upd = spark.createDataFrame([("E2E-ACC-1", 1, "CUS1", "SAVINGS", 2000.0, "ACTIVE"),
                                 ("E2E-ACC-1", 2, "CUS1", "SAVINGS", 2500.0, "ACTIVE"),
                                 ("GHOST", 1, "CUS1", "SAVINGS", 1.0, "ACTIVE")],
                                "account_number string, _seq long, customer_id string, account_type string, "
                                "balance double, status string")
    nxt = C.update_accounts(res.next, upd, bank.customers)
    row = nxt.next.filter(F.col("account_number") == "E2E-ACC-1").collect()
    assert len(row) == 1 and row[0].balance == decimal.Decimal("2500.00")  # latest change wins
    assert [(r.change_key, r.reason) for r in nxt.rejects.collect()] == [("GHOST", "not found")]


def test_transactions_defaults(spark, bank):
    batch = spark.createDataFrame(
        [("s1", "ACC1", "DEPOSIT", 500.0, None, None, None, None, None, dt.datetime(2024, 1, 2))],
        "source_id string, account_number string, transaction_type string, amount double, currency string, "
        "merchant_name string, location string, risk_factor string, status string, change_ts timestamp_ntz")
    r = C.insert_transactions(bank.transactions, batch, bank.accounts).accepted.first()
    assert (r.currency, r.status, r.risk_factor, r.merchant_name, r.location) == ("USD", "COMPLETED", "LOW", "", "")
    assert r.amount == decimal.Decimal("500.00")


def test_loan_update_without_customer_keeps_due_date(spark, bank):
    base = bank.loans
    one = base.filter(F.col("next_due_date").isNotNull()).orderBy("loan_id").first()
    chg = spark.createDataFrame(
        [(one.loan_id, 1, None, "PERSONAL", 10000.0, 5.5, 36, 300.0, 8000.0, "null", None, None, None),
         ("LOAN-NOPE", 1, None, "PERSONAL", 1.0, 1.0, 1, None, None, None, None, None, None)],
        "loan_id string, _seq long, customer_id string, category string, amount double, interest_rate double, "
        "term_months int, emi double, remaining_balance double, next_due_date string, status string, "
        "risk_rating string, recovered_amount double")
    res = C.update_loans(base, chg, bank.customers)
    row = res.next.filter(F.col("loan_id") == one.loan_id).first()
    assert row.customer_id == one.customer_id and row.next_due_date == one.next_due_date
    assert row.amount == decimal.Decimal("10000.00") and row.emi == decimal.Decimal("300.00")
    assert [(r.change_key, r.reason) for r in res.rejects.collect()] == [("LOAN-NOPE", "not found")]


def test_upsert_records(spark, bank):
    rec = bank.records
    first = rec.orderBy("id").first()
    batch = spark.createDataFrame([(first.id, "New Name", "n@x", None), ("rec-new", "Brand", "b@x", "d"),
                                   ("rec-bad", "No mail", None, None)],
                                  "id string, name string, email string, details string")
    res = C.upsert_records(rec, batch, "2024-02-01 10:00:00")
    got = {r.id: r for r in res.next.filter(F.col("id").isin(first.id, "rec-new")).collect()}
    assert got[first.id].name == "New Name" and got[first.id].created_at == first.created_at
    assert got[first.id].details == "" and got["rec-new"].created_at == dt.datetime(2024, 2, 1, 10)
    assert res.next.count() == rec.count() + 1
    assert res.rejects.count() == 1


def test_delete_cascade_is_one_level(bank):
    tables = {n: bank.table(n) for n in ("customers", "accounts", "transactions", "fraud_alerts")}
    keys = bank.customers.filter(F.col("customer_id") == "CUS1").select("customer_id")
    out = C.delete_cascade(tables, "customers", keys)
    assert out["customers"].filter(F.col("customer_id") == "CUS1").count() == 0
    assert out["accounts"].filter(F.col("customer_id") == "CUS1").count() == 0
    # the customer's transactions stay (orphans), as in the reference
    assert out["transactions"].filter(F.col("account_number") == "ACC1").count() == \
        bank.transactions.filter(F.col("account_number") == "ACC1").count()


def test_latest_per_key_hot_key(spark):
    rows = [("K1", i, f"v{i}") for i in range(3000)] + [("K2", 1, "a")]
    df = spark.createDataFrame(rows, "k string, _seq long, v string").repartition(8)
    got = {r.k: r.v for r in C.latest_per_key(df, "k").collect()}
    assert got == {"K1": "v2999", "K2": "a"}


ACCOUNT_CHANGES = ("account_number string, _seq long, customer_id string, account_type string, balance double, "
                   "status string")


def test_invalid_change_after_a_valid_one_does_not_undo_it(spark, bank):
    """The handlers' sequence: the first change applies, the second and third are refused."""
    upd = spark.createDataFrame([("ACC1", 1, "CUS1", "SAVINGS", 111.0, None), ("ACC1", 2, "CUS1", None, 222.0, None),
                                 ("ACC1", 3, "CUS-NOPE", "SAVINGS", 333.0, None), ("GHOST", 1, "CUS1", "SAVINGS", 1.0, None),
                                 ("GHOST", 2, "CUS1", "SAVINGS", 2.0, None)], ACCOUNT_CHANGES)
    res = C.update_accounts(bank.accounts, upd, bank.customers)
    assert res.next.filter("account_number = 'ACC1'").first().balance == decimal.Decimal("111.00")
    assert sorted(r.reason for r in res.rejects.collect()) == [
        "missing required field", "not found", "not found", "parent not found: customer_id"]
    assert [r.account_number for r in res.accepted.collect()] == ["ACC1"]
    assert res.next.count() == bank.accounts.count()


def test_insert_twice_adds_once(spark, bank):
    batch = spark.createDataFrame([("NEW-1", "CUS1", "SAVINGS", 1.0, None), ("NEW-1", "CUS1", "SAVINGS", 1.0, None),
                                   ("NEW-2", "CUS1", "SAVINGS", 2.0, None), ("ACC1", "CUS1", "SAVINGS", 2.0, None)],
                                  "account_number string, customer_id string, account_type string, balance double, status string")
    one = C.insert_accounts(bank.accounts, batch, bank.customers)
    assert sorted(r.account_number for r in one.accepted.collect()) == ["NEW-1", "NEW-2"]
    assert sorted((r.change_key, r.reason) for r in one.rejects.collect()) == [("ACC1", "duplicate key"), ("NEW-1", "duplicate key")]
    two = C.insert_accounts(one.next, batch, bank.customers)
    assert two.next.count() == one.next.count() and two.rejects.count() == 4 and two.accepted.count() == 0


def test_ids_do_not_join_parts_alike(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None)], "x string, y string")
    ids = [r[0] for r in df.select(C.hash_id("T", "x", "y")).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 65 for i in ids)
