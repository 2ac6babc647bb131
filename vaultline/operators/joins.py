"""Join helpers shared by the list and report operators.

The list endpoints of the workload are "enrich, then keep the newest k".
Because every enrichment is a left join on the parent's primary key, the
join neither adds nor removes child rows, so the top-k can be taken first
and only the k winners are enriched. The big parent tables are then read
once through a broadcast semi join against at most k keys (a bound set by
the limit itself), instead of being shuffled against the whole child table.

The top-k feeds several branches of such a plan (the semi joins and the
final join). Spark does not reuse a ``TakeOrderedAndProject`` across
branches, so each would scan and sort the fact table again; ``pin`` runs it
once and keeps its k rows in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def pin(bounded: DataFrame) -> DataFrame:
    """Compute a result bounded by construction (a top-k, a limit) once and
    keep it as a checkpoint in the cluster's shared checkpoint folder. Later
    plans read its rows instead of recomputing it, and the lineage is cut,
    so a lost executor does not rerun the scan."""
    ensure_checkpoint_dir(bounded.sparkSession)
    return bounded.checkpoint(eager=True)


# Most rows a caller may ask to have broadcast as a top-k.
BROADCAST_MAX_KEYS = 100_000


def bounded(df: DataFrame, k: int) -> DataFrame:
    """``df`` has at most ``k`` rows by construction (a top-k): hint Spark to
    broadcast it while ``k`` is small; a larger one is left to the planner."""
    return F.broadcast(df) if k <= BROADCAST_MAX_KEYS else df


def lookup_by_keys(parent: DataFrame, keys: DataFrame, key: str, k: int, parent_key: str | None = None) -> DataFrame:
    """Rows of ``parent`` whose key occurs in ``keys``, a frame of at most
    ``k`` rows. The parent is scanned with a hash probe and no shuffle."""
    parent_key = parent_key or key
    return parent.join(bounded(keys.select(F.col(key).alias(parent_key)).dropna().distinct(), k), parent_key, "left_semi")


def customer_names_for_accounts(accounts: DataFrame, customers: DataFrame, top: DataFrame, k: int,
                                account_col: str = "account_number") -> DataFrame:
    """``account_number -> customer name`` for the accounts used by ``top``.

    At most one account per key of ``top`` (k rows), so the customers are
    probed with these few account rows; both parents are scanned once."""
    acc = lookup_by_keys(accounts.select("account_number", "customer_id"), top, account_col, k, "account_number")
    return (customers.select("customer_id", F.col("name").alias("_customer_name"))
            .join(bounded(acc, k), "customer_id").select("account_number", "_customer_name"))


def enrich_customer_name(top: DataFrame, accounts: DataFrame, customers: DataFrame, k: int,
                         account_col: str = "account_number", default: str = "Unknown") -> DataFrame:
    """top LEFT JOIN accounts LEFT JOIN customers, COALESCE(name, default)."""
    names = customer_names_for_accounts(accounts, customers, top, k, account_col)
    if account_col != "account_number":
        names = names.withColumnRenamed("account_number", account_col)
    return (top.join(bounded(names, k), account_col, "left")
            .withColumn("customer_name", F.coalesce(F.col("_customer_name"), F.lit(default)))
            .drop("_customer_name"))


def enrich_customer_name_direct(top: DataFrame, customers: DataFrame, k: int, customer_col: str = "customer_id",
                                default: str = "Unknown", out: str = "customer_name") -> DataFrame:
    """top LEFT JOIN customers ON customer id, COALESCE(name, default)."""
    cust = lookup_by_keys(customers.select("customer_id", "name"), top, customer_col, k, "customer_id")
    if customer_col != "customer_id":
        cust = cust.withColumnRenamed("customer_id", customer_col)
    return (top.join(bounded(cust.withColumnRenamed("name", "_n"), k), customer_col, "left")
            .withColumn(out, F.coalesce(F.col("_n"), F.lit(default))).drop("_n"))


def account_branch_map(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """account_number -> branch_name (inner join on customer id)."""
    return (accounts.select("account_number", "customer_id")
            .join(customers.select("customer_id", "branch_name"), "customer_id", "inner")
            .select("account_number", "branch_name"))
