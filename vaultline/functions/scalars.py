"""Column functions of the workload (column in, column out).

All are compositions of built-in ``pyspark.sql.functions`` so they stay in
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Warehouse TO_CHAR formats used by the workload and their
# Spark datetime patterns.
TO_CHAR_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "YYYY-MM": "yyyy-MM",
    "YYYY-MM-DD HH24:MI:SS": "yyyy-MM-dd HH:mm:ss",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_char(c, fmt: str) -> Column:
    """TO_CHAR(ts, 'YYYY-MM-DD ...') -> string."""
    return F.date_format(_c(c), TO_CHAR_FORMATS.get(fmt, fmt))


def to_date_fmt(c, fmt: str = "YYYY-MM-DD") -> Column:
    """TO_DATE(text, 'YYYY-MM-DD'); unparsable text gives NULL."""
    return F.try_to_timestamp(_c(c), F.lit(TO_CHAR_FORMATS.get(fmt, fmt))).cast("date")


def trunc_day(c) -> Column:
    """TRUNC(timestamp) meant as the day."""
    return F.to_date(_c(c))


def dateadd(unit: str, n, c) -> Column:
    """DATEADD(unit, n, c) for day, month and minute."""
    c = _c(c)
    unit = unit.lower()
    if unit == "day":
        return F.date_add(c, n)
    if unit == "month":
        return F.add_months(c, n)
    if unit == "minute":
        return F.timestamp_add("MINUTE", F.lit(n), c)
    raise ValueError(f"unsupported unit {unit}")


def since(c, as_of, unit: str, n: int) -> Column:
    """``c >= DATEADD(unit, -n, as_of)`` with ``as_of`` an explicit date.

    The comparison happens against midnight of the start day, which is how
    a timestamp compares with a date in the warehouse.
    """
    start = dateadd(unit, -n, F.lit(as_of).cast("date"))
    return _c(c) >= start.cast("timestamp_ntz")


def norm_param(v, upper: bool = True):
    """Trim an optional filter argument; empty or 'ALL' means no filter."""
    if v is None:
        return None
    v = str(v).strip()
    if upper:
        v = v.upper()
    return None if v == "" or v == "ALL" else v


def optional_eq(c, value, upper: bool = True) -> Column | None:
    """UPPER(c) = UPPER(value) when the argument is set, else no predicate."""
    v = norm_param(value, upper)
    if v is None:
        return None
    return (F.upper(_c(c)) if upper else _c(c)) == F.lit(v)


def all_of(*preds) -> Column | None:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def like_any(cols, text: str) -> Column:
    """LOWER(c) LIKE '%text%' OR ... (``%`` and ``_`` in text stay wildcards)."""
    pat = f"%{text.lower()}%"
    return reduce(lambda a, b: a | b, [F.lower(_c(c)).like(pat) for c in cols])


def contains_any(cols, text: str) -> Column:
    """Null-safe, case-insensitive literal substring over several columns."""
    t = F.lit(text.lower())
    return reduce(lambda a, b: a | b,
                  [F.contains(F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))), t) for c in cols])


def digits_only(c) -> Column:
    """Phone cleanup: keep digits; empty result becomes NULL."""
    d = F.regexp_replace(_c(c), r"\D", "")
    return F.when(d == "", F.lit(None).cast("string")).otherwise(d)


def default_if_blank(c, default) -> Column:
    """``x || 'default'`` style: NULL and '' both take the default."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def format_usd(c, decimals: int) -> Column:
    """en-US currency text: ``$1,234`` / ``-$1,234.50``.

    Values are rounded half away from zero first (``round``), because
    ``format_number`` alone rounds half-even.
    """
    v = F.round(_c(c).cast("decimal(38,4)"), decimals)
    body = F.format_number(F.abs(v), decimals)
    return F.when(v.isNull(), F.lit(None)).when(v < 0, F.concat(F.lit("-$"), body)) \
        .otherwise(F.concat(F.lit("$"), body))


def signed_amount(amount, tx_type) -> Column:
    """+amount for DEPOSIT, -amount for every other type."""
    return F.when(_c(tx_type) == "DEPOSIT", _c(amount)).otherwise(-_c(amount))


def risk_band_customer(score) -> Column:
    """Customer grid band: >75 high, >40 medium, else low (strict)."""
    s = _c(score)
    return F.when(s > 75, "HIGH").when(s > 40, "MEDIUM").otherwise("LOW")


def risk_band_alert(score) -> Column:
    """Alert grid band: >=75 high, >=40 medium, else low (inclusive)."""
    s = _c(score)
    return F.when(s >= 75, "HIGH").when(s >= 40, "MEDIUM").otherwise("LOW")


def growth_sign(rate) -> Column:
    """Growth badge: 'UP' when rate >= 0 else 'DOWN'."""
    return F.when(_c(rate) >= 0, "UP").otherwise("DOWN")


def credit_risk(score) -> Column:
    """Credit risk procedure as a column: risk_score * 1.25 (float)."""
    return _c(score).cast("double") * F.lit(1.25)


def mask_by_role(c, role: str, full_roles, prefix: str, keep: int = 4) -> Column:
    """Masking policy: full value for privileged roles, else prefix + last
    ``keep`` characters. NULL stays NULL (``||`` with NULL)."""
    if role in set(full_roles):
        return _c(c)
    return F.concat(F.lit(prefix), F.right(_c(c), F.lit(keep)))


# Fixed values of the two masking policies.
PHONE_MASK_ROLES = ("BANKING_ADMIN", "BANKING_DATA_ENGINEER")
PHONE_MASK_PREFIX = "***-***-"
SSN_MASK_ROLES = ("ADMIN", "COMPLIANCE")
SSN_MASK_PREFIX = "***-**-"


def mask_phone(c, role: str) -> Column:
    return mask_by_role(c, role, PHONE_MASK_ROLES, PHONE_MASK_PREFIX)


def mask_ssn(c, role: str) -> Column:
    return mask_by_role(c, role, SSN_MASK_ROLES, SSN_MASK_PREFIX)


def mask_name(c) -> Column:
    """First and last letter kept, five stars between; a one-letter name
    does not match the pattern and stays as is."""
    return F.regexp_replace(_c(c), r"^(.).*(.)$", "$1*****$2")


def mask_email(c) -> Column:
    """Local part of the address replaced by five stars."""
    return F.regexp_replace(_c(c), r"(?i)^[A-Z0-9._%+-]+@", "*****@")


def mask_digits_keep_last4(c) -> Column:
    """Digit mask of the UI sample: ``1234567890`` -> ``***-***-7890``."""
    return F.regexp_replace(_c(c), r"^\d*(\d{4})$", "***-***-$1")
