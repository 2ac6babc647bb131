"""Scalar column functions: the dialect traps of SURVEY 7.4 and 2.8."""

from __future__ import annotations

import datetime as dt
import decimal

from vaultline.functions import scalars as S
from vaultline.operators import grid


def _one(spark, col, value, ddl):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(col("x")).first()[0]


def test_format_usd_rounds_half_up_and_puts_sign_first(spark):
    df = spark.createDataFrame([(decimal.Decimal("2.5"),), (decimal.Decimal("-1234.5"),), (None,),
                                (decimal.Decimal("1234567.125"),)], "x decimal(15,3)")
    got = [r[0] for r in df.select(S.format_usd("x", 0)).collect()]
    assert got == ["$3", "-$1,235", None, "$1,234,567"]
    got2 = [r[0] for r in df.select(S.format_usd("x", 2)).collect()]
    assert got2 == ["$2.50", "-$1,234.50", None, "$1,234,567.13"]


def test_right_keeps_short_input_and_mask_keeps_null(spark):
    assert _one(spark, lambda c: S.mask_phone(c, "BANKING_ANALYST"), "12", "string") == "***-***-12"
    assert _one(spark, lambda c: S.mask_phone(c, "BANKING_ANALYST"), None, "string") is None
    assert _one(spark, S.mask_digits_keep_last4, "1234567890", "string") == "***-***-7890"


def test_digits_only_and_defaults(spark):
    assert _one(spark, S.digits_only, "+1-555-8888", "string") == "15558888"
    assert _one(spark, S.digits_only, "n/a", "string") is None
    assert _one(spark, lambda c: S.default_if_blank(c, "ACTIVE"), "", "string") == "ACTIVE"
    assert _one(spark, lambda c: S.default_if_blank(c, "ACTIVE"), "CLOSED", "string") == "CLOSED"


def test_risk_bands_differ_at_the_boundaries(spark):
    df = spark.createDataFrame([(75,), (40,), (76,), (39,)], "s int")
    cust = [r[0] for r in df.select(S.risk_band_customer("s")).collect()]
    alert = [r[0] for r in df.select(S.risk_band_alert("s")).collect()]
    assert cust == ["MEDIUM", "LOW", "HIGH", "LOW"]
    assert alert == ["HIGH", "MEDIUM", "HIGH", "LOW"]


def test_signed_amount_and_dates(spark):
    df = spark.createDataFrame([("DEPOSIT", 5), ("ONLINE", 5)], "t string, a int")
    assert [r[0] for r in df.select(S.signed_amount("a", "t")).collect()] == [5, -5]
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert _one(spark, lambda c: S.to_char(c, "YYYY-MM-DD HH24:MI:SS"), ts, "timestamp_ntz") == "2024-01-02 03:04:05"
    assert _one(spark, lambda c: S.to_char(c, "YYYY-MM"), ts, "timestamp_ntz") == "2024-01"
    assert _one(spark, S.trunc_day, ts, "timestamp_ntz") == dt.date(2024, 1, 2)


def test_grid_sort_is_case_insensitive_like_locale_compare(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("A",)], "name string")
    got = [r.name for r in grid.grid_sort(df, "name", True).collect()]
    assert [x.lower() for x in got] == ["a", "a", "b", "b"]


def test_grid_page_count_of_empty_is_one(spark):
    df = spark.createDataFrame([], "name string")
    assert grid.grid_page_count(df).first().pages == 1
