"""List operators on skewed and edge-case inputs."""

from __future__ import annotations

import datetime as dt
import decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vaultline.operators import lists


def _bank(spark):
    cust = spark.createDataFrame(
        [(f"CUS{i}", f"Name {i:03d}", f"n{i}@x", None, "GOLD", decimal.Decimal("1.00"), "B", 1, dt.date(2020, 1, 1))
         for i in range(5)],
        "customer_id string, name string, email string, phone string, segment string, "
        "lifetime_value decimal(15,2), branch_name string, risk_score int, joined_date date")
    # CUS0 holds most accounts (the hot key); CUS4 has none
    rows = [(f"A{j:05d}", "CUS0", "SAVINGS", decimal.Decimal("1.00"), "ACTIVE") for j in range(2500)]
    rows += [(f"B{i}", f"CUS{i}", "CHECKING", decimal.Decimal("2.00"), "ACTIVE") for i in (1, 2, 3)]
    acc = spark.createDataFrame(rows, "account_number string, customer_id string, account_type string, "
                                      "balance decimal(15,2), status string")
    return SimpleNamespace(customers=cust, accounts=acc, spark=spark)


def test_nested_and_flat_accounts_have_one_shape(spark):
    b = _bank(spark)
    out = {r.id: r for r in lists.customer_accounts_nested(b, k=200).collect()}
    assert len(out) == 5  # one row per customer, also for the one with 2500 accounts
    assert [a.account_number for a in out["CUS0"].accounts] == [f"A{j:05d}" for j in range(2500)]
    assert [a.account_number for a in out["CUS1"].accounts] == ["B1"] and out["CUS4"].accounts == []
    flat = lists.customer_accounts_flat(b, k=200).collect()
    assert len(flat) == 2500 + 3 + 1 and [r.account_number for r in flat if r.id == "CUS4"] == [None]


def test_nested_accounts_top_k_first(spark):
    out = lists.customer_accounts_nested(_bank(spark), k=2)
    assert [r.id for r in out.collect()] == ["CUS0", "CUS1"]


def test_lookup_by_keys_same_rows_whatever_the_bound(spark):
    from vaultline.operators.joins import lookup_by_keys, pin
    b = _bank(spark)
    keys = pin(b.customers.select("customer_id").limit(3))
    small = lookup_by_keys(b.accounts, keys, "customer_id", 3)
    big = lookup_by_keys(b.accounts, keys, "customer_id", 10**9)
    assert sorted(small.collect()) == sorted(big.collect())
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in big._jdf.queryExecution().analyzed().toString().lower()


def test_grid_sort_compares_like_a_person(spark):
    from vaultline.operators import grid
    names = ["bob", "Alice", "alice", "Bob", "\u00c9mile", "emil", None, "Zo\u00eb", "zoe"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = [r.name for r in grid.grid_sort(df, "name", True, "id").collect()]
    assert got == ["alice", "Alice", "bob", "Bob", "emil", "\u00c9mile", "zoe", "Zo\u00eb", None]
    page, seen = [], None
    while True:  # paging by the last row seen gives the same order
        rows = (grid.grid_page_after(df, "name", True, "id", seen.name, seen.id, 2) if seen else
                grid.grid_page(df, "name", True, 1, "id", 2)).collect()
        if not rows:
            break
        page += [r.name for r in rows]
        seen = rows[-1]
    assert page == got


def test_deep_pages_are_not_a_large_limit(bank):
    from vaultline.operators import grid
    assert grid.grid_page(bank.fraud_alerts, "risk_score", False, 1_000_000, "alert_id").count() == 0
    for page in (grid.grid_page(bank.fraud_alerts, "risk_score", False, 5, "alert_id"),
                 grid.grid_page_after(bank.fraud_alerts, "risk_score", False, "alert_id", 3, "AL9")):
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "limit=6" in plan or "LIMIT 6" in plan.upper()
        assert "offset" not in plan.lower()


@pytest.mark.parametrize("column, ascending", [("name", True), ("name", False), ("amount", True), ("at", False), ("score", True),
                                               ("id", False)])
def test_any_page_equals_the_slice_of_the_whole_sort(spark, column, ascending):
    from vaultline.operators import grid
    df = spark.range(700).selectExpr(
        "CAST(id * 7919 % 700 AS INT) AS id",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN 'Zo\u00eb' WHEN id % 3 = 1 THEN concat('alice', id % 20) ELSE concat('Bob', id % 7) END AS name",
        "CAST(id % 13 AS DECIMAL(12,2)) / 4 AS amount",
        "CASE WHEN id % 5 > 0 THEN timestamp_seconds(1700000000 + (id * 31) % 97) END AS at",
        "CASE WHEN id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (id % 19) / 7.0 END AS score")
    order = [r.id for r in grid.grid_sort(df, column, ascending, "id").collect()]
    for n in (0, 1, 99, 350, 641, 699):
        place = grid.place_of(df, column, ascending, "id", n, sample=40, step=8)
        page = grid.grid_sort(df.filter(~grid.stands_before(df, column, ascending, "id", place)), column, ascending, "id").limit(6)
        assert [r.id for r in page.collect()] == order[n:n + 6]
    assert grid.place_of(df, column, ascending, "id", 700, sample=40, step=8) is None
    assert [r.id for r in grid.grid_page(df, column, ascending, 117, "id").collect()] == order[696:]


def test_a_key_that_repeats_too_often_is_named(spark):
    from vaultline.operators import grid
    df = spark.range(500).selectExpr("1 AS id", "'x' AS name")
    with pytest.raises(ValueError, match="not unique"):
        grid.place_of(df, "name", True, "id", 300, sample=40, step=8)


def test_status_is_a_filter_not_a_search(bank):
    assert lists.management_grid(bank, "fraud_alerts", "open").count() == 0
    want = bank.fraud_alerts.filter("status = 'OPEN'").count()
    assert lists.management_grid(bank, "fraud_alerts", None, "OPEN").count() == want > 0


def test_search_by_matching_accounts_equals_whole_table_enrichment(bank):
    from vaultline.functions.scalars import contains_any
    cols = ["transaction_id", "account_number", "customer_name", "merchant_name"]
    for text in ["er#00000012", "Customer#0000001", "merchant 3", "acc12", "nk", "zzz"]:
        fast = lists.txn_enriched(bank, search=text, k=50).collect()
        full = lists.enrich_all_customer_names(bank.transactions, bank).filter(contains_any(cols, text))
        want = lists._txn_out(lists.top_k(full, lists.NEWEST_FIRST(), 50), lists.TXN_COLUMNS()).collect()
        assert sorted(fast) == sorted(want), text


def test_enriched_lists_come_back_in_order_by_order(bank):
    ra = lists.recent_activity(bank, 10).collect()
    for a, b in zip(ra, ra[1:]):
        assert a.timestamp > b.timestamp or (a.timestamp == b.timestamp and a.id < b.id)
    ln = lists.loans_list(bank, k=50).collect()
    dues = [r.next_due_date for r in ln]
    present = [d for d in dues if d is not None]
    assert present == sorted(present) and dues[:len(present)] == present
