"""SQL workspace: run SQL text with ``?`` bindings over the banking views.

The text goes to ``spark.sql`` unchanged (Catalyst plans it like any other
query); only the workspace guard of the reference runs first. The result is
a lazy DataFrame, never collected here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators.governance import LEADING_COMMENT

_LEADING_COMMENT = re.compile(LEADING_COMMENT)


class WorkspaceDenied(PermissionError):
    pass


def check_guard(role: str, text: str) -> None:
    """Business users are refused; analysts may run SELECT/SHOW only."""
    if role in ("BANKING_BUSINESS_USER", "BUSINESS_USER"):
        raise WorkspaceDenied(f"role {role} has no SQL workspace")
    if role in ("BANKING_ANALYST", "ANALYST"):
        body = _LEADING_COMMENT.sub("", text.strip()).strip().upper()
        if not (body.startswith("SELECT") or body.startswith("SHOW")):
            raise WorkspaceDenied(f"role {role} may only run SELECT and SHOW")


def sql_workspace(bank, text: str, args=None, role: str = "BANKING_ADMIN") -> DataFrame:
    if not text or not text.strip():
        raise ValueError("empty statement")
    check_guard(role, text)
    bank = bank.isolated()
    bank.register_views()
    return bank.spark.sql(text.strip().rstrip(";"), args=list(args) if args is not None else None)


def register_estimated_tax(spark) -> None:
    """The scalar SQL function of the setup script, as a session function."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION calculate_estimated_tax(amount DOUBLE) "
              "RETURNS DOUBLE RETURN amount * 0.15")
