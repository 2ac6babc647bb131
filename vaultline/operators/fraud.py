"""Rule-based fraud detection in batch form (the alert types of the schema).

Thresholds and windows are parameters (the reference names the alert
types but computes none of them).

The "previous transaction of the same account within m minutes" rules
need, per key, the previous row in time. Partitioning by account alone
would put a hot account in one task, so accounts with more rows than a
budget are cut into segments of about equal row count (see
``previous_within``); all others need one exchange.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def _seconds(ts) -> F.Column:
    """Seconds since the epoch of an NTZ timestamp (time-zone free)."""
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts))


def fraud_high_value(tx: DataFrame, threshold: float = 45.0) -> DataFrame:
    """Transactions at or above ``threshold``."""
    return (tx.filter(F.col("amount") >= F.lit(threshold))
            .select("transaction_id", "account_number", "amount", "timestamp",
                    F.lit("HIGH_VALUE").alias("alert_type")))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def duration_seconds(text: str) -> int:
    """Seconds of a duration such as "10 minutes"."""
    n, unit = text.split()
    return int(n) * _UNIT_SECONDS[unit.rstrip("s")]


def pane(ts: str, window: str, slide: str) -> F.Column:
    """Start of the pane of a row: the longest stretch that every sliding window holds whole or not at all."""
    return F.window(ts, f"{gcd(duration_seconds(window), duration_seconds(slide))} seconds")["start"]


def velocity_alerts(panes: DataFrame, window: str, slide: str, max_count: int) -> DataFrame:
    """Windows with more than ``max_count`` rows from ``panes``
    (account_number, pane, tx_count, total_amount), one row per account and pane.

    A pane goes to the (account, block of time) groups of the windows that hold
    it, mostly one and two at a block's edge, and the windows are summed there.
    So a hot account is spread over its blocks, and no row is sent once per window."""
    size, step = duration_seconds(window), duration_seconds(slide)
    if step > size:
        raise ValueError("the slide is longer than the window")
    block = step * max(1, max(size, 86400) // step)
    at = _seconds("pane")
    # windows start at multiples of the slide; the pane lies in those that start in (at - size, at]
    first, last = F.floor((at - size) / step) + 1, F.floor(at / step)
    blocks = F.sequence(F.floor(first * step / block), F.floor(last * step / block))
    near = panes.select("*", at.alias("_at"), first.alias("_first"), last.alias("_last"), F.explode(blocks).alias("_block")) \
        .repartition("account_number", "_block")
    each = near.select("*", F.explode(F.sequence("_first", "_last")).alias("_k")).filter(F.floor(F.col("_k") * step / block) == F.col("_block"))
    start = F.timestamp_add("SECOND", (F.col("_k") * step - F.col("_at")).cast("int"), F.col("pane"))
    g = each.groupBy("account_number", "_block", start.alias("window_start")).agg(
        F.sum("tx_count").alias("tx_count"), F.sum("total_amount").cast("decimal(38,2)").alias("total_amount"))
    return g.filter(F.col("tx_count") > max_count).select(
        "account_number", "window_start", F.timestamp_add("SECOND", F.lit(size), F.col("window_start")).alias("window_end"),
        "tx_count", "total_amount", F.lit("VELOCITY_LIMIT").alias("alert_type"))


def fraud_velocity(tx: DataFrame, window: str = "1 hour", slide: str = "10 minutes",
                   max_count: int = 2) -> DataFrame:
    """Accounts with more than ``max_count`` transactions in a sliding window.
    Rows are summed per (account, pane) first, combined in every task before
    the shuffle; the windows are then built from panes."""
    panes = tx.select("account_number", "amount", pane("timestamp", window, slide).alias("pane")).groupBy("account_number", "pane").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("amount").cast("decimal(38,2)").alias("total_amount"))
    return velocity_alerts(panes, window, slide, max_count)


# Most rows one (key, segment) group should hold.
ROWS_PER_GROUP = 2_000_000


def _hot_cuts(base: DataFrame, key: str, budget: int) -> DataFrame | None:
    """(_hot, _cuts) for every value of ``key`` with more than ``budget`` rows,
    or None if there is none. ``_cuts`` are times that part its rows into
    slices of about half the budget by row count (quantile sketches, merged
    from partial ones), however the rows lie in time. The table is pinned, so
    all branches of a plan see the same cuts; it has at most rows / budget
    values, and its arrays together at most about 2 * rows / budget cuts per value."""
    from .joins import pin
    sizes = pin(base.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > budget)
                .select(F.col(key).alias("_hot"), "_n"))
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    slices = -(-2 * most // budget)
    hot = base.join(sizes, F.col(key).eqNullSafe(F.col("_hot")))
    cuts = F.percentile_approx("_us", [i / slices for i in range(1, slices)], 100 * slices)
    return pin(hot.groupBy("_hot").agg(cuts.alias("_cuts")))


def previous_within(tx: DataFrame, keys, minutes: int, carry, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Each row with the values ``carry`` of the previous row of the same
    ``keys`` when that row is at most ``minutes`` earlier (else NULL), plus
    ``gap_seconds``. Ordering is (timestamp, transaction_id). Exact for any input.

    The first key (the account) decides what is hot: a rule's whole key is at
    least as fine. Without a hot account there is one exchange, the window's.
    With some, their rows are numbered by segment, the previous row is found
    within (keys, segment), and the first row of a segment takes the keys'
    last row from the segment before, from a table of hot rows alone. Only
    rows that share one timestamp can't be parted.
    """
    width, order = minutes * 60, ["timestamp", "transaction_id"]
    base = tx.withColumn("_sec", _seconds("timestamp")).withColumn(
        "_us", F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("timestamp")))
    hot = _hot_cuts(base, keys[0], rows_per_group)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        j = base.withColumn("_p", F.lag(F.struct("_sec", *carry)).over(w))
    else:
        seg = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_us"))), F.lit(0))
        r = base.join(hot, F.col(keys[0]).eqNullSafe(F.col("_hot")), "left").withColumn("_seg", seg)
        r = r.withColumn("_is_hot", F.col("_cuts").isNotNull()).drop("_hot", "_cuts")
        inner = r.withColumn("_prev", F.lag(F.struct("_sec", *carry)).over(Window.partitionBy(*keys, "_seg").orderBy(*order)))
        last = r.filter("_is_hot").groupBy(*keys, "_seg").agg(F.max(F.struct(
            *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], "_sec", *carry)).alias("_last"))
        before = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_seg").alias("_k_seg"),
                             F.lag("_last").over(Window.partitionBy(*keys).orderBy("_seg")).alias("_before"))
        cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_seg") == F.col("_k_seg")]
        j = inner.join(before, cond, "left").withColumn("_p", F.coalesce(F.col("_prev"), F.struct(
            *[F.col(f"_before.{c}").alias(c) for c in ["_sec", *carry]])))
    near = (F.col("_sec") - F.col("_p._sec")) <= width
    return j.select(*tx.columns,
                    *[F.when(near, F.col(f"_p.{c}")).alias(f"prev_{c}") for c in carry],
                    F.when(near, F.col("_sec") - F.col("_p._sec")).alias("gap_seconds"))


def geographic_alerts(previous: DataFrame) -> DataFrame:
    """Alerts from rows with ``prev_location``: the location changed."""
    hit = previous.filter(F.col("prev_location").isNotNull() & (F.col("location") != F.col("prev_location")))
    return hit.select("transaction_id", "account_number", "location",
                      F.col("prev_location").alias("previous_location"),
                      F.col("prev_transaction_id").alias("previous_transaction_id"), "gap_seconds",
                      F.lit("GEOGRAPHIC_ANOMALY").alias("alert_type"))


def duplicate_alerts(previous: DataFrame) -> DataFrame:
    hit = previous.filter(F.col("prev_transaction_id").isNotNull())
    return hit.select("transaction_id", "account_number", "amount", "merchant_name",
                      F.col("prev_transaction_id").alias("duplicate_of"), "gap_seconds",
                      F.lit("DUPLICATE_TX").alias("alert_type"))


def with_amount_key(tx: DataFrame, amount_scale: int) -> DataFrame:
    return tx.withColumn("_amount_key", F.round("amount", amount_scale))


GEOGRAPHIC_KEYS, GEOGRAPHIC_CARRY = ["account_number"], ["location", "transaction_id"]
DUPLICATE_KEYS, DUPLICATE_CARRY = ["account_number", "_amount_key", "merchant_name"], ["transaction_id"]


def fraud_geographic(tx: DataFrame, minutes: int = 60) -> DataFrame:
    """Location differs from the account's previous transaction within
    ``minutes``."""
    return geographic_alerts(previous_within(tx, GEOGRAPHIC_KEYS, minutes, GEOGRAPHIC_CARRY))


def fraud_duplicate(tx: DataFrame, minutes: int = 30, amount_scale: int = 2) -> DataFrame:
    """Same account, amount and merchant as a transaction at most
    ``minutes`` earlier. Amounts are compared rounded to ``amount_scale``
    decimals (2 = exact cents; 0 = whole currency units)."""
    return duplicate_alerts(previous_within(with_amount_key(tx, amount_scale), DUPLICATE_KEYS, minutes, DUPLICATE_CARRY))
