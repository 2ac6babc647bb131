"""Masks, row policy, role closure and the SQL workspace guard."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vaultline.functions import scalars as S
from vaultline.operators import governance as G
from vaultline.plans import workspace as W


def test_mask_name_and_email(spark):
    df = spark.createDataFrame([("Alice", "alice@bank.com"), ("A", "x@y"), ("Bo", None)], "n string, e string")
    got = df.select(S.mask_name("n").alias("n"), S.mask_email("e").alias("e")).collect()
    assert [tuple(r) for r in got] == [("A*****e", "*****@bank.com"), ("A", "*****@y"), ("B*****o", None)]


def test_phone_mask_by_role(spark):
    df = spark.createDataFrame([("5550001234",), ("12",)], "phone string")
    analyst = [r.phone for r in G.apply_phone_mask(df, "BANKING_ANALYST").collect()]
    admin = [r.phone for r in G.apply_phone_mask(df, "BANKING_ADMIN").collect()]
    assert analyst == ["***-***-1234", "***-***-12"] and admin == ["5550001234", "12"]


def test_role_closure(spark):
    got = {(r.role, r.effective_role) for r in G.role_closure(spark).collect()}
    assert ("BANKING_BUSINESS_USER", "SYSADMIN") in got
    assert ("BANKING_ADMIN", "BANKING_ANALYST") not in got
    assert len([1 for r, e in got if r == "BANKING_BUSINESS_USER"]) == 5


@pytest.mark.parametrize("role,text,ok", [
    ("BANKING_ANALYST", "SELECT 1;", True),
    ("BANKING_ANALYST", "  /* note */ show tables", True),
    ("BANKING_ANALYST", "UPDATE CUSTOMERS SET name = NULL", False),
    ("BANKING_ANALYST", "DELETE FROM CUSTOMERS", False),
    ("BANKING_ANALYST", "WITH x AS (SELECT 1) SELECT * FROM x", False),
    ("BANKING_BUSINESS_USER", "SELECT 1", False),
    ("BANKING_ADMIN", "DELETE FROM CUSTOMERS", True),
])
def test_read_only_guard(spark, role, text, ok):
    df = spark.createDataFrame([(role, text)], "r string, t string")
    assert df.select(G.read_only_guard("r", "t")).first()[0] is ok


def test_workspace_refuses_writes_for_analysts(bank):
    with pytest.raises(PermissionError):
        W.sql_workspace(bank, "UPDATE CUSTOMERS SET name = NULL", role="BANKING_ANALYST")
    df = W.sql_workspace(bank, "SELECT * FROM customers WHERE customer_id = ?", ["CUS1"], role="BANKING_ANALYST")
    assert df.count() == 1


def test_row_policy_default_branch(bank):
    df = G.row_policy(bank.customers, "BANKING_ANALYST", "branch_name")
    assert df.filter(F.col("branch_name") != G.DEFAULT_POLICY_BRANCH).count() == 0
    assert G.row_policy(bank.customers, "BANKING_ADMIN", "branch_name").count() == bank.customers.count()


def test_role_closure_on_cycles_and_diamonds(spark):
    """One row for each reachable role, with the least depth; cycles end and are named."""
    from vaultline.operators import governance as G

    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("c", "e"), ("d", "f"), ("e", "f"), ("f", "g"), ("c", "g"),
                                   ("c", "g"), (None, "x")], "child string, parent string")
    closure = G.role_closure(spark, edges)
    got = {(r.role, r.effective_role): r.depth for r in closure.collect()}
    want = {(x, x): 0 for x in "abcdefg"} | {("a", "b"): 1, ("b", "a"): 1, ("c", "d"): 1, ("c", "e"): 1, ("c", "f"): 2, ("c", "g"): 1,
                                            ("d", "f"): 1, ("d", "g"): 2, ("e", "f"): 1, ("e", "g"): 2, ("f", "g"): 1}
    assert got == want and closure.count() == len(want)
    assert sorted(r.role for r in G.role_cycles(closure, edges).collect()) == ["a", "b"]
