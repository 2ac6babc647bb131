"""Banking tables over the driver's test data.

``Bank(spark, sf_dir)`` exposes the seven banking tables plus the query log
as lazy DataFrames derived from the TPC-H-like parquet files. All
derivations are narrow projections except ``loans`` (lineitem aggregated per
order, then joined to orders). Nothing is collected or cached; Catalyst
pushes filters and column pruning of the operators down to the parquet
scans through these projections.

The mapping rules are fixed values shared with the DuckDB oracle views in
``vaultline.plans.oracle`` and documented in FIXTURES.md.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
              "lineitem", "events", "documents", "embeddings", "pages",
              "benchmark", "labels", "conversations")


# Column types of the raw tables the banking tables are derived
# from. A fixed schema costs no inference job per read.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                 "l_shipdate timestamp_ntz"),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}


def prefixed(prefix: str, key: Column | str) -> Column:
    """``'CUS' || key`` style identifiers."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), k.cast("string"))


def case_map(col: Column, mapping: dict, default=None) -> Column:
    """CASE col WHEN k THEN v ... ELSE default END."""
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def money(c: Column) -> Column:
    return c.cast("decimal(15,2)")


class Bank:
    """Lazy banking tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            schema = RAW_SCHEMAS.get(name)
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            self._raw[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    # -- customers -----------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        n = self.raw("nation").select("n_nationkey", "n_name")
        key = F.col("c_custkey")
        return (c.join(n, c.c_nationkey == n.n_nationkey, "inner")
                .select(
                    prefixed("CUS", key).alias("customer_id"),
                    F.col("c_name").alias("name"),
                    F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                             F.lit("@example.com")).alias("email"),
                    F.when(key % 13 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("555"), F.lpad(key.cast("string"), 7, "0")))
                     .alias("phone"),
                    case_map(F.col("c_mktsegment"), {"AUTOMOBILE": "PLATINUM", "BUILDING": "GOLD",
                                                     "FURNITURE": "SILVER"}, "BRONZE").alias("segment"),
                    money(F.col("c_acctbal")).alias("lifetime_value"),
                    F.col("n_name").alias("branch_name"),
                    (key % 101).cast("int").alias("risk_score"),
                    F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int")).alias("joined_date")))

    # -- accounts ------------------------------------------------------
    @cached_property
    def accounts(self) -> DataFrame:
        """One account per customer plus a savings account for every third;
        both rows come out of one scan of the customer file (``inline`` of a
        one- or two-element array), not a union of two scans."""
        c = self.raw("customer").select("c_custkey", "c_acctbal").filter(F.col("c_custkey") % 10 != 9)
        key, bal = F.col("c_custkey"), F.col("c_acctbal")
        main = F.struct(
            prefixed("ACC", key).alias("account_number"),
            prefixed("CUS", key).alias("customer_id"),
            case_map(key % 3, {0: "CHECKING", 1: "LOAN"}, "CREDIT").alias("account_type"),
            money(bal).alias("balance"),
            F.when(bal < 0, "FROZEN").when(bal < 1000, "DORMANT").otherwise("ACTIVE").alias("status"))
        savings = (F.struct(
            prefixed("SAV", key).alias("account_number"),
            prefixed("CUS", key).alias("customer_id"),
            F.lit("SAVINGS").alias("account_type"),
            money(F.lit(1000) + key).alias("balance"),
            F.lit("ACTIVE").alias("status")))
        rows = F.when(key % 3 == 0, F.array(main, savings)).otherwise(F.array(main))
        return c.select(F.inline(rows))

    # -- transactions --------------------------------------------------
    @cached_property
    def transactions(self) -> DataFrame:
        o = self.raw("orders")
        key, price = F.col("o_orderkey"), F.col("o_totalprice")
        return o.select(
            prefixed("TX", key).alias("transaction_id"),
            prefixed("ACC", F.col("o_custkey")).alias("account_number"),
            money(price).alias("amount"),
            case_map(F.col("o_orderpriority"), {"1-URGENT": "TRANSFER", "2-HIGH": "CREDIT_CARD",
                                                "3-MEDIUM": "WITHDRAWAL", "4-NOT SPECIFIED": "ONLINE"},
                     "DEPOSIT").alias("transaction_type"),
            F.lit("USD").alias("currency"),
            F.when(key % 7 == 0, F.lit(None).cast("string"))
             .otherwise(prefixed("Merchant ", key % 40)).alias("merchant_name"),
            prefixed("City ", key % 5).alias("location"),
            F.when(price > 400000, "HIGH").when(price > 200000, "MEDIUM").otherwise("LOW").alias("risk_factor"),
            case_map(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "PENDING"}, "FAILED").alias("status"),
            F.col("o_orderdate").alias("timestamp"))

    # -- loans ---------------------------------------------------------
    @cached_property
    def loans(self) -> DataFrame:
        """One loan per order. Lineitem is aggregated per order *before* the
        join with orders (orders is unique on its key), so the shuffle carries
        one partial row per order and partition instead of every line."""
        li = self.raw("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate")
        price = money(F.col("l_extendedprice"))
        per_order = li.groupBy("l_orderkey").agg(
            F.sum(price).alias("_sum"), F.max(price).alias("_max"), F.min(price).alias("_min"),
            F.max("l_discount").alias("_disc"), F.max("l_shipdate").alias("_ship"))
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        j = per_order.join(o, per_order.l_orderkey == o.o_orderkey, "inner")
        key = F.col("l_orderkey")
        return j.select(
            prefixed("LOAN", key).alias("loan_id"),
            prefixed("CUS", F.col("o_custkey")).alias("customer_id"),
            case_map(key % 5, {0: "HOME", 1: "AUTO", 2: "PERSONAL", 3: "BUSINESS"}, "EDUCATION").alias("category"),
            F.col("_sum").cast("decimal(15,2)").alias("amount"),
            (F.col("_disc") * 100).cast("decimal(5,2)").alias("interest_rate"),
            (F.lit(12) + F.lit(12) * (key % 5)).cast("int").alias("term_months"),
            F.col("_min").cast("decimal(15,2)").alias("emi"),
            (F.col("_sum") - F.col("_max")).cast("decimal(15,2)").alias("remaining_balance"),
            F.col("_max").cast("decimal(15,2)").alias("recovered_amount"),
            F.when(key % 17 == 0, F.lit(None).cast("date")).otherwise(F.col("_ship").cast("date")).alias("next_due_date"),
            case_map(key % 7, {0: "A", 1: "B", 2: "C", 3: "D"}, "E").alias("risk_rating"),
            case_map(key % 4, {0: "DELINQUENT", 1: "FULLY_PAID"}, "ACTIVE").alias("status"))

    # -- branch_performance --------------------------------------------
    @cached_property
    def branch_performance(self) -> DataFrame:
        n = self.raw("nation")
        r = self.raw("region")
        key = F.col("n_nationkey")
        return (n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
            prefixed("BR", key).alias("branch_id"),
            F.col("n_name").alias("branch_name"),
            F.col("r_name").alias("city"),
            prefixed("Manager ", key).alias("manager"),
            (key * 11).cast("bigint").alias("customer_count"),
            (key * 3).cast("bigint").alias("active_loans"),
            (key * 10000).cast("decimal(15,2)").alias("total_deposits"),
            (key * 2500).cast("decimal(15,2)").alias("total_revenue"),
            (key * 40).cast("bigint").alias("transaction_count"),
            ((key * 7) % 31 - 10).cast("decimal(5,2)").alias("growth_rate")))

    # -- fraud_alerts --------------------------------------------------
    @cached_property
    def fraud_alerts(self) -> DataFrame:
        return alerts_from_events(self.raw("events"))

    # -- records -------------------------------------------------------
    @cached_property
    def records(self) -> DataFrame:
        p = self.raw("pages").select("page_id", "url")
        key = F.col("page_id")
        return p.select(
            prefixed("rec-", key).alias("id"),
            F.col("url").alias("name"),
            F.concat(F.lit("page"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.lit(None).cast("string").alias("details"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int"))
             .cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"))

    # -- query_log -----------------------------------------------------
    @cached_property
    def query_log(self) -> DataFrame:
        e = self.raw("events")
        uid = F.col("user_id")
        return e.select(
            F.col("event_id").cast("string").alias("query_id"),
            prefixed("u", uid).alias("user_name"),
            case_map(uid % 4, {0: "BANKING_ADMIN", 1: "BANKING_DATA_ENGINEER", 2: "BANKING_ANALYST"},
                     "BANKING_BUSINESS_USER").alias("role_name"),
            case_map(F.col("event_type"), {"view": "SELECT * FROM CUSTOMERS", "click": "/* ui */ select 1",
                                           "signup": "INSERT INTO CUSTOMERS VALUES (1)",
                                           "purchase": "UPDATE CUSTOMERS SET name = NULL"},
                     "SHOW TABLES").alias("query_text"),
            F.col("ts").alias("start_time"),
            F.round(F.col("value") * 100).cast("bigint").alias("total_elapsed_time"),
            F.when(F.col("event_type") == "error", "FAIL").otherwise("SUCCESS").alias("execution_status"))

    # -- streams and usage logs over events ------------------------------
    @cached_property
    def event_transactions(self) -> DataFrame:
        """Events read as a transaction feed (the streaming input shape)."""
        return event_transactions(self.raw("events"))

    @cached_property
    def usage_log(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("ts").alias("start_time"),
                        (F.col("value").cast("decimal(18,2)") / 100).cast("decimal(18,4)").alias("credits_used"))

    @cached_property
    def storage_log(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.to_date("ts").alias("usage_date"),
                        (F.col("event_id") * F.lit(1024 * 1024)).cast("bigint").alias("bytes"))

    def isolated(self) -> Bank:
        """The same tables in a session of their own (same application), so
        that views and functions of SQL text rebind nobody else's names."""
        session = self.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
            session.conf.set(key, self.spark.conf.get(key))
        return Bank(session, self.sf_dir)

    def register_views(self, names=None) -> None:
        """Expose the banking tables to ``spark.sql`` as temp views."""
        for name in names or ("customers", "accounts", "transactions", "loans", "records",
                              "branch_performance", "fraud_alerts", "query_log"):
            self.table(name).createOrReplaceTempView(name)


def event_transactions(events: DataFrame) -> DataFrame:
    """Map raw events (batch or streaming) to the transaction shape.

    ``props`` carries ``{"k": n}``; ``k`` picks location and merchant so the
    location and duplicate rules have something to compare. The timestamp
    stays NTZ (time-zone free); streaming jobs cast it for their watermark.
    """
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return events.select(
        prefixed("TX", F.col("event_id")).alias("transaction_id"),
        prefixed("ACC", F.col("user_id")).alias("account_number"),
        F.col("value").cast("decimal(15,2)").alias("amount"),
        F.upper(F.col("event_type")).alias("transaction_type"),
        prefixed("Merchant ", k % 40).alias("merchant_name"),
        prefixed("City ", k % 5).alias("location"),
        F.col("ts").alias("timestamp"))


def alerts_from_events(events: DataFrame) -> DataFrame:
    """Error events read as fraud alerts (batch or streaming input)."""
    e = events.filter(F.col("event_type") == "error")
    key = F.col("event_id")
    return e.select(
        prefixed("AL", key).alias("alert_id"),
        prefixed("TX", key).alias("transaction_id"),
        prefixed("CUS", F.col("user_id")).alias("customer_id"),
        money(F.col("value")).alias("amount"),
        case_map(key % 4, {0: "VELOCITY_LIMIT", 1: "HIGH_VALUE", 2: "GEOGRAPHIC_ANOMALY"},
                 "DUPLICATE_TX").alias("alert_type"),
        F.col("ts").alias("timestamp"),
        (key % 101).cast("int").alias("risk_score"),
        case_map(key % 4, {0: "OPEN", 1: "INVESTIGATING", 2: "DISMISSED"}, "CONFIRMED").alias("status"),
        F.col("props").alias("details"))
