"""Aggregations on a fact table where one account holds a third of the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import random
from types import SimpleNamespace


from vaultline.operators import metrics as M


def _bank(spark, n=3000):
    rnd = random.Random(3)
    tx = []
    for i in range(n):
        acc = "ACC0" if i % 3 == 0 else f"ACC{rnd.randint(1, 40)}"
        tx.append((f"TX{i}", acc, decimal.Decimal(rnd.randint(1, 10000)) / 100, "DEPOSIT", "USD", None, "City 1",
                   "LOW", rnd.choice(["COMPLETED", "PENDING"]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 200)))
    t = spark.createDataFrame(tx, "transaction_id string, account_number string, amount decimal(15,2), "
                                  "transaction_type string, currency string, merchant_name string, location string, "
                                  "risk_factor string, status string, timestamp timestamp_ntz")
    acc = spark.createDataFrame([(f"ACC{i}", f"CUS{i % 7}", "SAVINGS", decimal.Decimal("5.00"), "ACTIVE")
                                 for i in range(0, 35)],  # ACC35..40 have no account row
                                "account_number string, customer_id string, account_type string, "
                                "balance decimal(15,2), status string")
    cust = spark.createDataFrame([(f"CUS{i}", f"Branch {i % 3}") for i in range(7)],
                                 "customer_id string, branch_name string")
    return SimpleNamespace(transactions=t, accounts=acc, customers=cust, spark=spark), tx


def test_daily_branch_volume_with_hot_account(spark):
    b, tx = _bank(spark)
    branch = {f"ACC{i}": f"Branch {(i % 7) % 3}" for i in range(35)}
    want = {}
    for _, acc, amt, *_rest, ts in tx:
        if acc in branch:
            k = (ts.date(), branch[acc])
            n, s = want.get(k, (0, decimal.Decimal(0)))
            want[k] = (n + 1, s + amt)
    got = {(r.transaction_date, r.branch_name): (r.daily_count, r.daily_amount)
           for r in M.daily_branch_volume(b).collect()}
    assert got == want


def test_daily_branch_volume_aggregates_before_the_join(spark):
    b, _ = _bank(spark)
    plan = M.daily_branch_volume(b)._jdf.queryExecution().optimizedPlan().toString()
    # the first aggregate (per account and day) sits below the join
    join_at = plan.index("Join")
    assert plan.find("Aggregate", join_at) > join_at
