"""Grid operators of the management screens: search, sort, page.

The reference runs these in the browser on at most 200 rows; here they are
DataFrame steps, so the search runs over the whole table before any limit
and a page is a filter from its first row, found by exact counts between
cut points or known as the last row seen, plus a top-(page size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import contains_any

PAGE_SIZE = 6

# Searchable columns and default sort of each grid.
GRID_SEARCH_COLUMNS = {
    "transactions": ["transaction_id", "account_number", "customer_name", "merchant_name"],
    "loans": ["loan_id", "customer_name", "category"],
    "fraud_alerts": ["alert_id", "transaction_id", "customer_name", "alert_type", "details"],
    "branches": ["branch_name", "city", "manager", "branch_id"],
    "accounts": ["account_number", "customer_id", "customer_name"],
}
GRID_STATUS_FILTER = ("accounts", "fraud_alerts")
GRID_KEY = {"transactions": "transaction_id", "loans": "loan_id", "fraud_alerts": "alert_id", "branches": "branch_id",
            "accounts": "account_number"}
GRID_DEFAULT_SORT = {
    "customers": ("name", True), "accounts": ("account_number", True),
    "transactions": ("timestamp", False), "loans": ("loan_id", True),
    "branches": ("branch_name", True), "fraud_alerts": ("risk_score", False),
}


def grid_search(df: DataFrame, text: str | None, cols) -> DataFrame:
    """Case-insensitive literal substring over ``cols``, OR-ed, null-safe."""
    t = (text or "").strip()
    return df if not t else df.filter(contains_any(cols, t))


def sort_key(df: DataFrame, column: str, ascending: bool = True, collation: str = "UNICODE"):
    """Sort expression of one grid column: strings compare with a Unicode
    collation (like ``localeCompare``), other types by value."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.collate(c, collation)
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def grid_sort(df: DataFrame, column: str, ascending: bool = True, key: str | None = None) -> DataFrame:
    order = [sort_key(df, column, ascending)]
    if key:
        order.append(F.col(key).asc())
    return df.orderBy(*order)


def status_filter(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """The grid's status choice: an exact match, 'ALL' (or none) for any."""
    return df if status in (None, "ALL") else df.filter(F.col(column) == status)


# Rows of least key hash taken from a range in one pass, and how many of them lie between two cut points.
SAMPLE = 1_024
STEP = 16


def _packed(df: DataFrame, column: str):
    """A value as something that comes back from the driver unchanged."""
    c = F.col(column)
    return F.unix_micros(c) if isinstance(df.schema[column].dataType, T.TimestampType) else c.cast("string")


def _unpacked(df: DataFrame, column: str, value):
    dtype = df.schema[column].dataType
    return F.timestamp_micros(F.lit(value)) if isinstance(dtype, T.TimestampType) else F.lit(value).cast(dtype)


def stands_before(df: DataFrame, column: str, ascending: bool, key: str, place) -> Column:
    """Whether a row comes before ``place`` (packed value and key) under the grid sort."""
    value, key_value = place
    earlier_key = F.col(key) < _unpacked(df, key, key_value)
    if value is None:  # nulls sort last
        return F.col(column).isNotNull() | earlier_key
    c, v = F.col(column), _unpacked(df, column, value)
    if isinstance(df.schema[column].dataType, T.StringType):
        c, v = F.collate(c, "UNICODE"), F.collate(v, "UNICODE")
    beyond = (c < v) if ascending else (c > v)
    return F.coalesce(beyond | ((c == v) & earlier_key), F.lit(False))


def place_of(df: DataFrame, column: str, ascending: bool, key: str, n: int, sample: int = SAMPLE, step: int = STEP):
    """Value and key (packed) of the row that ``n`` rows stand before, or None
    if there are not so many.

    Selection by cut points: the ``sample`` rows of least key hash in the
    current range, in grid order, give a cut at every ``step``-th row; one
    aggregate counts exactly how many rows stand before each cut, and the
    range between the two cuts around ``n`` is the next one. A pass divides
    the range by about ``sample / step``, so 10^12 rows take five or six; each
    reads the two columns, moves only counts, and brings at most ``sample``
    values to the driver. ``key`` must be unique and not null."""
    places = df.select(*dict.fromkeys([column, key]))
    low = high = None
    skipped = 0
    while True:
        rows = places
        if low is not None:
            rows = rows.filter(~stands_before(places, column, ascending, key, low))
        if high is not None:
            rows = rows.filter(stands_before(places, column, ascending, key, high))
        drawn = rows.orderBy(F.xxhash64(key), key).limit(sample)
        listed = [tuple(r) for r in grid_sort(drawn, column, ascending, key).select(
            _packed(df, column).alias("value"), _packed(df, key).alias("key")).collect()]
        if len(listed) < sample:  # the whole range
            return listed[n - skipped] if n - skipped < len(listed) else None
        cuts = listed[step::step]
        before = rows.agg(*[F.count_if(stands_before(places, column, ascending, key, cut)).alias(f"n{i}")
                            for i, cut in enumerate(cuts)]).first()
        i = sum(skipped + x <= n for x in before)
        last = (low, high)
        if i < len(cuts):
            high = cuts[i]
        if i:
            low, skipped = cuts[i - 1], skipped + before[i - 1]
        if (low, high) == last:
            raise ValueError(f"{key} is not unique: more than {sample} rows share one value and key")


def grid_page(df: DataFrame, column: str, ascending: bool, page: int, key: str,
              size: int = PAGE_SIZE) -> DataFrame:
    """Rows of page ``page`` (1-based) under the grid sort, however deep. The
    page's first row is found by ``place_of``; the page is a filter from there
    and a top-``size``, without an offset. A page beyond the last is empty.
    Whoever knows the last row seen saves the selection: ``grid_page_after``."""
    skip = (max(int(page), 1) - 1) * size
    if skip:
        place = place_of(df, column, ascending, key, skip)
        if place is None:
            return df.limit(0)
        df = df.filter(~stands_before(df, column, ascending, key, place))
    return grid_sort(df, column, ascending, key).limit(size)


def grid_page_after(df: DataFrame, column: str, ascending: bool, key: str, last_value, last_key,
                    size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows the row (``last_value``, ``last_key``): a filter
    and a top-``size``, however deep the page is. Nulls sort last."""
    c, v = F.col(column), F.lit(last_value)
    if isinstance(df.schema[column].dataType, T.StringType):
        c, v = F.collate(c, "UNICODE"), F.collate(v.cast("string"), "UNICODE")
    next_key = F.col(key) > F.lit(last_key)
    if last_value is None:
        rest = F.col(column).isNull() & next_key
    else:
        beyond = (c > v) if ascending else (c < v)
        rest = beyond | ((c == v) & next_key) | F.col(column).isNull()
    return grid_sort(df.filter(rest), column, ascending, key).limit(size)


def grid_page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``ceil(n / size)``, at least 1, plus the row count."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("bigint").alias("pages"))
