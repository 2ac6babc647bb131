"""Governance: masked views, masking policies, row policy, roles, audits.

Policies are column expressions or filters applied to whole DataFrames; the
role is an argument (the reference reads it from the session). Rule tables
(role hierarchy, permission matrix) are tiny literal frames whose size is
fixed by the rule, not by the data, so they are broadcast where joined.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mask_email, mask_name, mask_phone, mask_ssn, since, to_char
from .joins import bounded, pin

# Role inheritance (child, parent) as granted by the setup script.
ROLE_EDGES = [
    ("BANKING_BUSINESS_USER", "BANKING_ANALYST"),
    ("BANKING_ANALYST", "BANKING_DATA_ENGINEER"),
    ("BANKING_DATA_ENGINEER", "BANKING_ADMIN"),
    ("BANKING_ADMIN", "SYSADMIN"),
]

DATABASE, SCHEMA, ANALYTICS_WAREHOUSE, INGEST_WAREHOUSE = "BANK_DB", "BANK_DB.BANK_SCHEMA", "ANALYTICS_WH", "INGEST_WH"


def setup_grant_rows(database: str = DATABASE, schema: str = SCHEMA, analytics: str = ANALYTICS_WAREHOUSE,
                     ingest: str = INGEST_WAREHOUSE) -> list[tuple[str, str, str, str]]:
    """Grants of the setup script (privilege, object type, object, grantee)
    for the given object names."""
    return [
        ("USAGE", "DATABASE", database, "BANKING_BUSINESS_USER"),
        ("USAGE", "SCHEMA", schema, "BANKING_BUSINESS_USER"),
        ("USAGE", "WAREHOUSE", analytics, "BANKING_BUSINESS_USER"),
        ("SELECT", "VIEW", f"ALL VIEWS IN {schema}", "BANKING_ANALYST"),
        ("ALL PRIVILEGES", "DATABASE", database, "BANKING_DATA_ENGINEER"),
        ("USAGE", "WAREHOUSE", ingest, "BANKING_DATA_ENGINEER"),
    ]


# Roles, actions and resources of the API permission check.
ROLES = ("BANKING_ADMIN", "BANKING_DATA_ENGINEER", "BANKING_ANALYST", "BANKING_BUSINESS_USER")
ACTIONS = ("read", "create", "update", "delete")
RESOURCES = ("dashboard", "customers", "accounts", "transactions", "loans", "branches", "fraud",
             "security", "monitoring", "upload", "recovery", "sql", "query-history")
ANALYST_DENIED = ("security", "monitoring", "upload", "recovery")
FULL_ACCESS_ROLES = ("BANKING_ADMIN", "BANKING_DATA_ENGINEER")
DEFAULT_POLICY_BRANCH = "Silicon Valley Branch"


# Fixed value: a block comment before the first keyword of a statement.
LEADING_COMMENT = r"^/\*[\s\S]*?\*/"


# -- masked view and masking policies -------------------------------------

def secure_customer_view(customers: DataFrame, short: bool = False) -> DataFrame:
    """Analyst view: masked name, masked e-mail local part, phone dropped.
    ``short`` is the UI variant that masks the name only."""
    if short:
        return customers.select("customer_id", mask_name("name").alias("masked_name"), "segment",
                                "lifetime_value", "branch_name")
    return customers.select("customer_id", mask_name("name").alias("masked_name"),
                            mask_email("email").alias("masked_email"), "segment", "lifetime_value",
                            "branch_name", "risk_score", "joined_date")


def apply_phone_mask(df: DataFrame, role: str, column: str = "phone") -> DataFrame:
    return df.withColumn(column, mask_phone(column, role))


def apply_ssn_mask(df: DataFrame, role: str, column: str) -> DataFrame:
    return df.withColumn(column, mask_ssn(column, role))


# -- row access policy ----------------------------------------------------

def row_policy(df: DataFrame, role: str, branch_col: str = "branch_name",
               user: str | None = None, user_branches: DataFrame | None = None,
               default_branch: str = DEFAULT_POLICY_BRANCH) -> DataFrame:
    """Admins and engineers see every row; others see their branch only.

    With a ``user_branches`` map (user_name, branch_name) the user's own
    branches apply (semi join; the map is filtered to one user first);
    without it, the policy's single literal branch applies.
    """
    if role in FULL_ACCESS_ROLES:
        return df
    if user_branches is None or user is None:
        return df.filter(F.col(branch_col) == F.lit(default_branch))
    mine = (user_branches.filter(F.col("user_name") == user)
            .select(F.col("branch_name").alias(branch_col)).distinct())
    return df.join(mine, branch_col, "left_semi")


# -- roles ----------------------------------------------------------------

def role_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_EDGES, "child string, parent string")


def role_closure(spark: SparkSession, edges: DataFrame | None = None) -> DataFrame:
    """(role, effective_role, depth): every role a role inherits, itself at
    depth 0, each once with its least depth, on any graph (cycles too).

    Semi-naive: a round extends only the pairs of the round before and drops
    what was reached earlier; there are as many rounds as the longest of the
    shortest ways. Every round's pairs are pinned in the checkpoint folder."""
    edges = pin((edges if edges is not None else role_edges(spark)).dropna().distinct())
    both = F.explode(F.array("child", "parent")).alias("role")
    reached = pin(edges.select(both).distinct().select("role", F.col("role").alias("effective_role"), F.lit(0).alias("depth")))
    n_edges, n_new, n_reached, last, depth = edges.count(), reached.count(), 0, reached, 0
    while n_new:
        n_reached, depth = n_reached + n_new, depth + 1
        step = last.join(bounded(edges, n_edges), last.effective_role == edges.child) \
            .select("role", F.col("parent").alias("effective_role")).distinct()
        last = pin(step.join(bounded(reached, n_reached), ["role", "effective_role"], "left_anti").withColumn("depth", F.lit(depth)))
        reached, n_new = reached.unionByName(last), last.count()
    return reached


def role_cycles(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Roles that inherit themselves through others."""
    back = closure.join(edges, (closure.effective_role == edges.child) & (closure.role == edges.parent))
    return back.select("role").distinct()


def effective_roles(query_log: DataFrame, closure: DataFrame) -> DataFrame:
    """Effective roles of every (user, role) seen in the query log."""
    users = query_log.select("user_name", F.col("role_name").alias("role")).distinct()
    return users.join(closure, "role", "inner").select(
        "user_name", F.col("role").alias("role_name"), "effective_role", "depth")


def roles_report(query_log: DataFrame, spark: SparkSession, k: int = 50) -> DataFrame:
    """Per role: parent role, distinct users and queries seen in the log."""
    parents = role_edges(spark).select(F.col("child").alias("role"), F.col("parent"))
    counts = query_log.groupBy(F.col("role_name").alias("role")).agg(
        F.countDistinct("user_name").alias("users_count"), F.count(F.lit(1)).alias("queries_count"))
    return (counts.join(F.broadcast(parents), "role", "left")
            .orderBy("role").limit(k)
            .select("role", "parent", "users_count", "queries_count"))


def grants_report(grants: DataFrame, k: int = 100) -> DataFrame:
    """privilege, object_type, object_name, grantee sorted by grantee, type
    (privilege and object break ties, so the first k are deterministic)."""
    return (grants.select("privilege", "object_type", "object_name", "grantee")
            .orderBy("grantee", "object_type", "privilege", "object_name").limit(k))


def setup_grants(spark: SparkSession, **names) -> DataFrame:
    return spark.createDataFrame(setup_grant_rows(**names), "privilege string, object_type string, object_name string, grantee string")


TABLE_REF = r"(?i)(FROM|INTO|UPDATE)\s+([A-Za-z_]+)"


def observed_grants(query_log: DataFrame) -> DataFrame:
    """Privileges in use: (statement verb, table, role) of every logged
    statement that names a table, distinct (a hash aggregate)."""
    obj = F.regexp_extract("query_text", TABLE_REF, 2)
    return (query_log.filter(obj != "")
            .select(statement_verb("query_text").alias("privilege"), F.lit("TABLE").alias("object_type"),
                    F.upper(obj).alias("object_name"), F.col("role_name").alias("grantee"))
            .distinct())


# -- query log reports ----------------------------------------------------

def query_history(query_log: DataFrame, as_of: str, days: int = 7, k: int = 20) -> DataFrame:
    """Last ``days`` days, newest ``k``. The reference divides elapsed
    milliseconds by 1000 and calls it duration_ms; both units are given."""
    q = query_log.filter(since("start_time", as_of, "day", days))
    top = q.orderBy(F.col("start_time").desc_nulls_first(), F.col("query_id")).limit(k)
    secs = (F.col("total_elapsed_time").cast("decimal(20,3)") / 1000).cast("decimal(20,3)")
    return top.select(F.col("query_id").alias("id"), "query_text", F.col("user_name").alias("user"),
                      F.col("role_name").alias("role"),
                      to_char("start_time", "YYYY-MM-DD HH24:MI:SS").alias("timestamp"),
                      F.col("total_elapsed_time").alias("duration_ms"), secs.alias("duration_s"),
                      F.col("execution_status").alias("status"))


def permission_allowed(role, action, resource) -> F.Column:
    """The API permission rule as a column expression."""
    r, a, s = F.col(role), F.col(action), F.col(resource)
    return (F.when(r.isin("BANKING_ADMIN", "ADMIN"), True)
            .when(r.isin("BANKING_DATA_ENGINEER", "DATA_ENGINEER"), (s != "security") & (a != "delete"))
            .when(r.isin("BANKING_ANALYST", "ANALYST"),
                  ((s == "sql") & (a == "read")) | ((a == "read") & ~s.isin(*ANALYST_DENIED)))
            .when(r.isin("BANKING_BUSINESS_USER", "BUSINESS_USER"), (s == "dashboard") & (a == "read"))
            .otherwise(False))


def permission_matrix(spark: SparkSession) -> DataFrame:
    """role x action x resource -> allowed (4 x 4 x 13 rows)."""
    rows = list(product(ROLES, ACTIONS, RESOURCES))
    m = spark.createDataFrame(rows, "role string, action string, resource string")
    return m.withColumn("allowed", permission_allowed("role", "action", "resource"))


def statement_verb(text) -> F.Column:
    """First keyword of a statement after a leading block comment, upper."""
    body = F.trim(F.regexp_replace(F.trim(F.col(text)), LEADING_COMMENT, ""))
    return F.upper(F.regexp_extract(body, r"^([A-Za-z]+)", 1))


def read_only_guard(role, text) -> F.Column:
    """SQL workspace rule: business users refused; analysts only statements
    starting with SELECT or SHOW (after a leading comment); others allowed.
    ``WITH ...`` is refused for analysts, as in the reference."""
    body = F.upper(F.trim(F.regexp_replace(F.trim(F.col(text)), LEADING_COMMENT, "")))
    ro = body.startswith("SELECT") | body.startswith("SHOW")
    r = F.col(role)
    return (F.when(r.isin("BANKING_BUSINESS_USER", "BUSINESS_USER"), False)
            .when(r.isin("BANKING_ANALYST", "ANALYST"), ro)
            .otherwise(True))


# the resource that guards each table; statements on no table are the workspace's own ("sql")
TABLE_RESOURCE = {"CUSTOMERS": "customers", "ACCOUNTS": "accounts", "TRANSACTIONS": "transactions", "LOANS": "loans",
                  "BRANCH_PERFORMANCE": "branches", "FRAUD_ALERTS": "fraud", "QUERY_HISTORY": "query-history"}


def statement_resource(text) -> F.Column:
    """The resource of the first table a statement names, else "sql"."""
    name = F.upper(F.regexp_extract(F.col(text), TABLE_REF, 2))
    return F.coalesce(*[F.when(name == t, F.lit(r)) for t, r in TABLE_RESOURCE.items()], F.lit("sql"))


VERB_ACTION = {"SELECT": "read", "SHOW": "read", "INSERT": "create", "UPDATE": "update",
               "MERGE": "update", "DELETE": "delete"}


def access_audit(query_log: DataFrame, spark: SparkSession) -> DataFrame:
    """Every logged statement with the action it needs, the permission
    matrix's answer for (role, action, 'sql') and the workspace guard."""
    verb = statement_verb("query_text")
    action = F.coalesce(*[F.when(verb == k, F.lit(v)) for k, v in VERB_ACTION.items()], F.lit("update"))
    q = query_log.select("query_id", "user_name", "role_name", "query_text",
                         action.alias("action"), F.lit("sql").alias("resource"))
    m = permission_matrix(spark).select(F.col("role").alias("role_name"), "action", "resource",
                                        F.col("allowed").alias("permitted"))
    return (q.join(F.broadcast(m), ["role_name", "action", "resource"], "left")
            .withColumn("permitted", F.coalesce("permitted", F.lit(False)))
            .withColumn("guard_allowed", read_only_guard("role_name", "query_text")))


def permission_usage(query_log: DataFrame) -> DataFrame:
    """The permission rule over the logged statements: (role, action,
    resource, allowed) with the number of attempts, the resource taken from
    the table each statement names. Partial counts per task before the shuffle."""
    verb = statement_verb("query_text")
    action = F.coalesce(*[F.when(verb == k, F.lit(v)) for k, v in VERB_ACTION.items()], F.lit("update"))
    a = (query_log.groupBy(F.col("role_name").alias("role"), action.alias("action"),
                           statement_resource("query_text").alias("resource")).agg(F.count(F.lit(1)).alias("attempts")))
    return a.withColumn("allowed", permission_allowed("role", "action", "resource"))
