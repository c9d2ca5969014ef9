"""Queries over the star-schema and text tables that show each operator, with the SQL that says the same.

The tables have no configuration files, so environments, findings and inventories are derived from whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, coerce, rules
from ..operators import contract, drift, findings, reconcile, render
from ..sources import dotenv, files
from ..streaming import idle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(col: str) -> Column:
    return F.col(col).cast("string")


# Environments: what the customers table says of each customer, and what the orders say of those who have ordered.
_LEFT = "SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_acctbal > 5000 THEN 'F' ELSE 'O' END AS value FROM customer"
_RIGHT = "SELECT CAST(o_custkey AS VARCHAR) AS name, max(o_orderstatus) AS value FROM orders GROUP BY o_custkey"


def _environments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = _t(spark, sf_dir, "customer").select(_text("c_custkey").alias("name"), F.when(F.col("c_acctbal") > 5000, "F").otherwise("O").alias("value"))
    right = _t(spark, sf_dir, "orders").groupBy(_text("o_custkey").alias("name")).agg(F.max("o_orderstatus").alias("value"))
    return left, right


_DRIFT = f"""
SELECT coalesce(l.name, r.name) AS name, l.value AS value1, r.value AS value2,
       CASE WHEN l.name IS NULL THEN 'added' WHEN r.name IS NULL THEN 'removed' WHEN l.value = r.value THEN 'unchanged' ELSE 'changed' END AS diff_type
FROM ({_LEFT}) l FULL JOIN ({_RIGHT}) r ON l.name = r.name
"""


@query(f"SELECT name, diff_type, value1, value2 FROM ({_DRIFT}) WHERE diff_type <> 'unchanged'")
def drift_full_outer(spark, sf_dir):
    """Every name of either side, without those that are the same."""
    return drift.drift(*_environments(spark, sf_dir), normalize=False).select("name", "diff_type", "value1", "value2")


@query(f"""
SELECT name, CASE WHEN diff_type IN ('added', 'removed') THEN diff_type WHEN (value1 = 'F') = (value2 = 'F') THEN 'unchanged' ELSE 'changed' END AS diff_type
FROM ({_DRIFT})
""")
def drift_normalized(spark, sf_dir):
    """V1c, V1d: white space and truth values, unchanged names included."""
    left, right = _environments(spark, sf_dir)
    left = left.withColumn("value", F.when(F.col("value") == "F", "\t true ").otherwise("off"))
    right = right.withColumn("value", F.when(F.col("value") == "F", "YES").otherwise("0 "))
    return drift.drift(left, right, include_unchanged=True).select("name", "diff_type")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE 'unchanged' END AS diff_type FROM orders")
def drift_typed(spark, sf_dir):
    """Equal as whole numbers though not as texts; a value that is none beside one that is differs for good."""
    orders = _t(spark, sf_dir, "orders")
    other = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("q"), _text("o_custkey"))).otherwise(F.concat(F.lit(" +0"), _text("o_custkey"), F.lit(".0")))
    left, right = (orders.select(_text("o_orderkey").alias("name"), v.alias("value")) for v in (_text("o_custkey"), other))
    fields = left.select(F.col("name").alias("field"), F.lit("int").alias("type"), F.lit(False).alias("sensitive"))
    return drift.drift(left, right, fields, include_unchanged=True).select("name", "diff_type")


@query(f"""
SELECT count(*) FILTER (diff_type = 'added') AS added, count(*) FILTER (diff_type = 'removed') AS removed, count(*) FILTER (diff_type = 'changed') AS changed,
       count(*) FILTER (diff_type <> 'unchanged') > 0 AS has_drift FROM ({_DRIFT})
""")
def drift_summary(spark, sf_dir):
    """G1."""
    return drift.summary(drift.drift(*_environments(spark, sf_dir), normalize=False))


@query(f"""
SELECT d.name, d.diff_type, CASE WHEN s.name IS NULL THEN value1 WHEN value1 <> '' THEN '********' END AS value1,
       CASE WHEN s.name IS NULL THEN value2 WHEN value2 <> '' THEN '********' END AS value2, s.name IS NOT NULL AS is_sensitive
FROM ({_DRIFT}) d LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_mktsegment = 'BUILDING') s ON d.name = s.name
WHERE diff_type <> 'unchanged'
""")
def drift_masked(spark, sf_dir):
    """values of sensitive names are hidden."""
    fields = _t(spark, sf_dir, "customer").select(_text("c_custkey").alias("field"), F.lit("str").alias("type"), (F.col("c_mktsegment") == "BUILDING").alias("sensitive"))
    found = drift.drift(*_environments(spark, sf_dir), fields=fields, normalize=False)
    return found.select("name", "diff_type", "value1", "value2", "is_sensitive")


@query("""
SELECT path, name, value FROM (
  SELECT o_orderpriority AS path, CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS value,
         row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
  FROM orders) WHERE k = 1 AND value IS NOT NULL
""")
def latest_assignment(spark, sf_dir):
    """P10: the last event of each name, unless it takes the name away."""
    orders = _t(spark, sf_dir, "orders")
    events = orders.select(F.col("o_orderpriority").alias("path"), _text("o_custkey").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return dotenv.latest(events, order="at").select("path", "name", "value")


@query("""
WITH n AS (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, p_partkey FROM part)
SELECT lower(name) AS folded, count(DISTINCT name) AS n_names, arg_max(name, p_partkey) AS kept FROM n GROUP BY lower(name) HAVING count(DISTINCT name) > 1
""")
def case_collisions(spark, sf_dir):
    """G3."""
    rows = _t(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("line_number"))
    return contract.collisions(rows).select("folded", F.size("names").cast("long").alias("n_names"), "kept")


_VARIABLES = """
SELECT 'supplier' AS path, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'events', event_type FROM events UNION SELECT 'region', r_name FROM region
"""


def _variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the suppliers' nations, the events and the regions set, one file each."""
    nation = _t(spark, sf_dir, "nation")
    a = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier").alias("path"), F.col("n_name").alias("name"))
    b = _t(spark, sf_dir, "events").select(F.lit("events"), "event_type")
    c = _t(spark, sf_dir, "region").select(F.lit("region"), "r_name")
    return a.union(b).union(c).distinct().select("path", "name", F.lit("x").alias("value"), F.lit(1).alias("line_number"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation")
    return nation.select(F.col("n_name").alias("field"), F.lit("str").alias("type"), (F.col("n_regionkey") > 1).alias("required"), (F.col("n_regionkey") == 2).alias("sensitive"), F.lit(None).cast("string").alias("default"), F.array("n_name").alias("binding_names"), F.lit(None).cast("string").alias("description"))


@query(f"""
SELECT f.path, n_name AS field, n_regionkey > 1 AS required FROM (SELECT DISTINCT path FROM ({_VARIABLES})) f, nation
WHERE NOT EXISTS (SELECT 1 FROM ({_VARIABLES}) v WHERE v.path = f.path AND lower(v.name) = lower(n_name))
""")
def contract_missing(spark, sf_dir):
    """J3."""
    return contract.missing(_variables(spark, sf_dir), _fields(spark, sf_dir), ("path",))


@query(f"SELECT path, name FROM ({_VARIABLES}) v WHERE NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(v.name))")
def contract_extra(spark, sf_dir):
    """J4."""
    return contract.extra(_variables(spark, sf_dir), _fields(spark, sf_dir), ("path",))


@query(f"SELECT path, name FROM ({_VARIABLES}) v WHERE EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(v.name) AND n_regionkey = 2)")
def contract_unencrypted(spark, sf_dir):
    """J5."""
    return contract.unencrypted(_variables(spark, sf_dir), _fields(spark, sf_dir), ("path",))


@query(f"""
WITH v AS ({_VARIABLES}), k AS (
  SELECT path, count(*) FILTER (WHERE n_regionkey > 1) AS need FROM (SELECT DISTINCT path FROM v), nation GROUP BY path
), m AS (
  SELECT v.path, count(*) FILTER (WHERE n_regionkey > 1) AS have, count(*) FILTER (WHERE n_regionkey <= 1) AS opt, count(*) FILTER (WHERE n_regionkey = 2) AS sens,
         count(*) FILTER (WHERE n_nationkey IS NULL) AS extra
  FROM v LEFT JOIN nation ON lower(n_name) = lower(v.name) GROUP BY v.path
)
SELECT m.path, need - have + extra AS errors, (SELECT count(*) FROM nation WHERE n_regionkey <= 1) - opt + sens AS warnings, need - have + extra = 0 AS valid
FROM m JOIN k ON m.path = k.path
""")
def contract_verdict(spark, sf_dir):
    """All checks of each file, counted."""
    return contract.verdict(contract.violations(_variables(spark, sf_dir), _fields(spark, sf_dir), ("path",)), ("path",))


@query("""
SELECT r_name AS field, arg_min(n_name, n_nationkey) AS name FROM region JOIN nation ON n_regionkey = r_regionkey
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY r_name
""")
def alias_binding(spark, sf_dir):
    """Of the nations of a region, in order, the first that a supplier sets."""
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x.n_name)
    fields = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("field")).agg(names.alias("binding_names"))
    variables = _variables(spark, sf_dir).where("path = 'supplier'").drop("path")
    return contract.bind(variables, fields).select("field", "name")


@query("""
SELECT event_id, json_type(props) = 'OBJECT' AS map_ok, false AS list_ok, regexp_full_match(event_type, '(?i)(1|on|t|true|y|yes|0|off|f|false|n|no)') AS bool_ok,
       true AS int_ok, true AS float_ok, 'Expected integer, got ''' || event_type || '''' AS said FROM events
""")
def type_check(spark, sf_dir):
    """X9, X11."""
    events = _t(spark, sf_dir, "events")
    ok = lambda value, kind: coerce.accepted(value, F.lit(kind))
    number = F.concat(F.lit(" +"), F.regexp_replace(_text("user_id"), "([0-9])([0-9])", "$1_$2"))
    return events.select(
        "event_id",
        ok(F.col("props"), "map").alias("map_ok"),
        ok(F.col("props"), "list[int]").alias("list_ok"),
        ok(F.col("event_type"), "bool").alias("bool_ok"),
        ok(number, "int").alias("int_ok"),
        ok(F.concat(_text("user_id"), F.lit(".5e3")), "float").alias("float_ok"),
        coerce.message(F.col("event_type"), F.lit("?int")).alias("said"),
    )


@query("""
WITH v AS (SELECT o_orderpriority AS path, 'K' || CAST(o_orderkey AS VARCHAR) AS name, CASE o_orderstatus WHEN 'F' THEN 'encrypted:x' WHEN 'P' THEN '' ELSE 'sk-' || CAST(o_custkey AS VARCHAR) END AS value FROM orders)
SELECT path, count(*) FILTER (value = 'encrypted:x') AS encrypted, count(*) FILTER (starts_with(value, 'sk-')) AS plaintext, count(*) FILTER (value = '') AS empty,
       count(*) FILTER (starts_with(value, 'sk-')) AS plaintext_secrets, round(count(*) FILTER (value = 'encrypted:x') / count(*) FILTER (value <> ''), 9) AS ratio,
       'dotenvx' AS backend, count(*) FILTER (starts_with(value, 'sk-')) > 0 AS should_block FROM v GROUP BY path
""")
def encryption_report(spark, sf_dir):
    """P11, F3, G4, G5."""
    value = F.when(F.col("o_orderstatus") == "F", "encrypted:x").when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("sk-"), _text("o_custkey")))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"), F.concat(F.lit("K"), _text("o_orderkey")).alias("name"), value.alias("value"))
    return contract.encryption_report(rows, ("path",), names=False).select("path", "encrypted", "plaintext", "empty", "plaintext_secrets", F.round("ratio", 9).alias("ratio"), "backend", "should_block")


@query("""
WITH n AS (SELECT DISTINCT upper(replace(p_name, ' ', '_')) || s AS name FROM part, (VALUES ('_KEY'), ('_token'), ('_KEYS'), ('_CREDENTIAL_1'), ('')) t(s)
           UNION SELECT DISTINCT s || upper(event_type) FROM events, (VALUES ('JWT_'), ('auth_'), ('PRIVATE_'), ('X_JWT_')) t(s))
SELECT name, regexp_matches(name, '(?i)(_KEY|_SECRET|_TOKEN|_PASSWORD|_PASS|_DSN)$|_CREDENTIAL|^JWT_|^AUTH_') AS checked,
       regexp_matches(name, '(?i)(_KEY|_SECRET|_TOKEN|_PASSWORD|_PASS|_DSN)$|_CREDENTIAL|^JWT_|^AUTH_|^PRIVATE_') AS reported FROM n
""")
def name_sensitivity(spark, sf_dir):
    """F4."""
    plain = F.upper(F.regexp_replace("p_name", " ", "_"))
    a = _t(spark, sf_dir, "part").select(F.explode(F.array(*(F.concat(plain, F.lit(s)) for s in ("_KEY", "_token", "_KEYS", "_CREDENTIAL_1", "")))).alias("name"))
    b = _t(spark, sf_dir, "events").select(F.explode(F.array(*(F.concat(F.lit(s), F.upper("event_type")) for s in ("JWT_", "auth_", "PRIVATE_", "X_JWT_")))).alias("name"))
    name = F.col("name")
    return a.union(b).distinct().select("name", classify.sensitive_name(name).alias("checked"), classify.sensitive_name(name, classify.REPORTED_NAMES).alias("reported"))


def _any(patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(text, '{p}')" for p in patterns)


@query(f"SELECT doc_id, {_any(classify.CHECKED_VALUES)} AS checked, {_any(classify.REPORTED_VALUES)} AS reported FROM documents")
def value_suspicion(spark, sf_dir):
    """F5, over whole texts."""
    text = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", classify.suspicious_value(text).alias("checked"), classify.suspicious_value(text, classify.REPORTED_VALUES).alias("reported"))


_ENTROPY = "round(list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -(len(list_filter(string_split({0}, ''), lambda d: d = c)) / length({0})) * log2(len(list_filter(string_split({0}, ''), lambda d: d = c)) / length({0})))), 6)"


@query(f"SELECT c_custkey, {_ENTROPY.format('c_name')} AS entropy FROM customer")
def shannon_entropy(spark, sf_dir):
    """G11, X4."""
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(classify.entropy(F.col("c_name")), 6).alias("entropy"))


@query("""
SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN repeat('*', length(p_name)) ELSE p_name[1:4] || repeat('*', length(p_name) - 8) || p_name[-4:] END AS preview,
       sha256(p_name) AS hash, p_name || ':' || CAST(p_size AS VARCHAR) || ':' || '7' AS place FROM part
""")
def redact_hash(spark, sf_dir):
    """X1, X2, X18."""
    name = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", classify.redact(name).alias("preview"), classify.secret_hash(name).alias("hash"), classify.location(name, F.col("p_size"), F.lit(7)).alias("place"))


def _scan_sql(table: str, key: str, text: str) -> str:
    """Every rule by line in RE2, which has no look-ahead: there the next character is matched instead."""
    quote = lambda s: s.replace("'", "''")
    parts = []
    for r in rules.RULES:
        if r.whole:
            continue
        pattern = r.pattern.replace("(?=[^A-Z0-9]|$)", "(?:[^A-Z0-9]|$)")
        group = 1 if "(" in pattern.replace("(?", "") else 0
        gate = " AND (" + " OR ".join(f"contains(whole, '{k}')" for k in r.keywords) + ")" if r.gated else ""
        parts.append(f"SELECT {key}, line_number, '{r.id}' AS rule_id, '{r.severity}' AS severity, unnest(regexp_extract_all(line, '{quote(pattern)}', {group})) AS secret FROM l WHERE regexp_matches(line, '{quote(pattern)}'){gate}")
    entropy = _ENTROPY.format("secret")
    return f"""
WITH t AS (SELECT {key}, lower({text}) AS whole, string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS lines FROM {table}),
l AS (SELECT {key}, whole, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_number FROM t),
f AS ({" UNION ALL ".join(parts)})
SELECT CAST({key} AS VARCHAR) AS path, CAST(line_number AS INTEGER) AS line_number, rule_id, severity, sha256(secret) AS secret_hash
FROM f WHERE NOT regexp_matches(secret, '^0[23][0-9a-fA-F]{{64}}$') AND (rule_id <> 'generic-secret' OR ({entropy} >= 4.0 AND NOT regexp_matches(secret, '^(\\$|%|\\{{|\\\\\\$\\{{)')))
"""


def _scanned(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    found = findings.scan(df.select(_text(key).alias("path"), F.col(text).alias("content")), **how)
    return found.select("path", "line_number", "rule_id", "severity", "secret_hash")


@query(_scan_sql("documents", "doc_id", "text"))
def scan_documents(spark, sf_dir):
    """All rules over whole documents."""
    return _scanned(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(_scan_sql("pages", "page_id", "html"))
def scan_pages(spark, sf_dir):
    """N3, N4 over web pages."""
    return _scanned(_t(spark, sf_dir, "pages"), "page_id", "html")


_FINDINGS = """
SELECT 'src/' || CAST(l_suppkey AS VARCHAR) || '.env' AS path, l_returnflag AS rule_id, CAST(l_linenumber AS INTEGER) AS line_number,
       CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'info' END AS severity,
       CASE WHEN l_quantity > 40 THEN 4 WHEN l_quantity > 30 THEN 3 WHEN l_quantity > 20 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS rank,
       CASE WHEN l_linestatus = 'F' THEN sha256(CAST(CAST(l_partkey AS BIGINT) % 50 AS VARCHAR)) END AS secret_hash, l_tax > 0.04 AS verified, l_linestatus AS scanner FROM lineitem
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    severity = F.when(q > 40, "critical").when(q > 30, "high").when(q > 20, "medium").when(q > 10, "low").otherwise("info")
    hashed = F.when(F.col("l_linestatus") == "F", F.sha2((F.col("l_partkey") % 50).cast("string").cast("binary"), 256))
    null = F.lit(None).cast("string")
    return _t(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("src/"), _text("l_suppkey"), F.lit(".env")).alias("path"),
        F.col("l_returnflag").alias("rule_id"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        severity.alias("severity"),
        hashed.alias("secret_hash"),
        null.alias("secret_preview"),
        (F.col("l_tax") > 0.04).alias("verified"),
        F.col("l_linestatus").alias("scanner"),
    )


_ORDER = "rank DESC, verified DESC, (secret_hash IS NOT NULL) DESC, path, line_number, rule_id, scanner"
_DEDUP = f"""
SELECT * EXCLUDE (k, most) FROM (
  SELECT *, max(CASE WHEN secret_hash IS NOT NULL THEN rank END) OVER (PARTITION BY path, line_number, rule_id) AS most FROM (
    SELECT *, row_number() OVER (PARTITION BY path, line_number, rule_id, secret_hash ORDER BY {_ORDER}) AS k FROM ({_FINDINGS})) WHERE k = 1)
WHERE secret_hash IS NOT NULL OR most IS NULL OR rank > most
"""
_COLUMNS = ("path", "line_number", "rule_id", "severity", "secret_hash", "verified", "scanner")


@query(f"SELECT {', '.join(_COLUMNS)} FROM ({_DEDUP})")
def dedup_findings(spark, sf_dir):
    """W1, W2, G8, G9."""
    return findings.dedup(_findings(spark, sf_dir)).select(*_COLUMNS)


@query(f"""
SELECT {', '.join(_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(secret_hash, path || '|' || line_number || '|' || rule_id) ORDER BY {_ORDER}) AS k FROM ({_FINDINGS})) WHERE k = 1
""")
def dedup_unique_secret(spark, sf_dir):
    """W1 by secret."""
    return findings.dedup(_findings(spark, sf_dir), unique_secret=True).select(*_COLUMNS)


@query(f"SELECT s.severity, count(d.path) AS n FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN ({_DEDUP}) d ON d.severity = s.severity GROUP BY s.severity")
def severity_counts(spark, sf_dir):
    """G6, K2."""
    return findings.by_severity(findings.dedup(_findings(spark, sf_dir)))


@query(f"SELECT CAST(CASE WHEN max(rank) >= 3 THEN 5 - max(rank) ELSE 0 END AS INTEGER) AS exit_code FROM ({_DEDUP})")
def exit_code(spark, sf_dir):
    """G7."""
    return findings.exit_code(findings.dedup(_findings(spark, sf_dir)), fail_on="high")


@query(f"""
SELECT {', '.join(_COLUMNS)} FROM ({_DEDUP}) f
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND f.path = 'src/' || CAST(s_suppkey AS VARCHAR) || '.env')
  AND NOT regexp_matches(path, '^src/1[^/]*\\.env$') AND NOT (rule_id = 'R' AND regexp_matches(path, '(^|/)2[0-9]\\.env$'))
""")
def suppress_findings(spark, sf_dir):
    """ignored paths, a rule on some paths, and paths that version control ignores."""
    ignored = _t(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("src/"), _text("s_suppkey"), F.lit(".env")).alias("path"))
    found = findings.without_paths(findings.dedup(_findings(spark, sf_dir)), ignored)
    return findings.suppress(found, ignore_rules={"R": ("2[0-9].env",)}, ignore_paths=("src/1*.env",)).select(*_COLUMNS)


@query(f"SELECT rule_id, CASE max(rank) WHEN 4 THEN 'error' WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END AS level, CASE max(rank) WHEN 4 THEN '9.0' WHEN 3 THEN '7.0' WHEN 2 THEN '5.0' WHEN 1 THEN '3.0' ELSE '1.0' END AS security_severity FROM ({_DEDUP}) GROUP BY rule_id")
def sarif_rules(spark, sf_dir):
    """K3, D1, X16."""
    found = findings.dedup(_findings(spark, sf_dir)).withColumn("rule_description", F.col("rule_id"))
    return render.sarif_rules(found).select("rule_id", "level", "security_severity")


_SYNC = """
WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS secret_name, c_mktsegment AS environment, c_acctbal < 0 AS ephemeral, CASE WHEN c_nationkey = 3 THEN 'multiple_found' WHEN c_nationkey = 4 THEN 'not_found' WHEN c_nationkey = 5 THEN 'folder_not_found' ELSE 'found' END AS status FROM customer),
o AS (SELECT CAST(o_custkey AS VARCHAR) AS secret_name, 'key' || max(o_orderstatus) AS v, CASE WHEN count(*) > 5 THEN 'key' || min(o_orderstatus) END AS l FROM orders GROUP BY o_custkey)
SELECT m.secret_name, CASE WHEN status = 'folder_not_found' THEN 'error' WHEN status <> 'found' THEN 'skipped' WHEN v IS NULL THEN 'error' WHEN ephemeral THEN 'ephemeral'
       WHEN l IS NULL THEN 'created' WHEN l = v THEN 'skipped' ELSE 'updated' END AS action
FROM m LEFT JOIN o ON m.secret_name = o.secret_name
"""


@query(_SYNC)
def sync_actions(spark, sf_dir):
    """Customers as mappings, orders as the vault and as local keys."""
    nation = F.col("c_nationkey")
    status = F.when(nation == 3, "multiple_found").when(nation == 4, "not_found").when(nation == 5, "folder_not_found").otherwise("found")
    customer = _t(spark, sf_dir, "customer")
    mappings = customer.select(_text("c_custkey").alias("secret_name"), _text("c_custkey").alias("folder"), F.col("c_mktsegment").alias("environment"), F.lit(None).cast("string").alias("profile"), (F.col("c_acctbal") < 0).alias("ephemeral"), status.alias("status"))
    orders = _t(spark, sf_dir, "orders").groupBy(_text("o_custkey").alias("secret_name")).agg(F.concat(F.lit("key"), F.max("o_orderstatus")).alias("v"), F.concat(F.lit("key"), F.min("o_orderstatus")).alias("l"), F.count(F.lit(1)).alias("n"))
    environment = F.concat(F.lit("DOTENV_PRIVATE_KEY_"), F.upper("c_mktsegment"))
    label = F.concat(environment, F.lit("="), "v")
    vault = orders.join(customer.select(_text("c_custkey").alias("secret_name"), "c_mktsegment"), "secret_name").select("secret_name", label.alias("value"), environment.alias("key_name"), "l", "n")
    local = vault.where("n > 5").select(F.col("secret_name").alias("folder"), "key_name", F.col("l").alias("value"))
    return reconcile.sync(mappings, vault.select("secret_name", "value"), local, force=True).select("secret_name", "action")


@query(f"""
SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped,
       count(*) FILTER (action = 'ephemeral') AS ephemeral, count(*) FILTER (action = 'error') AS error, count(*) AS total, count(*) FILTER (action = 'error') > 0 AS has_errors FROM ({_SYNC})
""")
def sync_counts(spark, sf_dir):
    """G10."""
    return reconcile.counts(sync_actions(spark, sf_dir))


@query("""
SELECT CAST(coalesce(s, c) AS VARCHAR) AS project, CASE WHEN s IS NULL THEN 'stop' WHEN c IS NULL THEN 'start' ELSE 'keep' END AS action
FROM (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY') ON s = c
""")
def registry_reconcile(spark, sf_dir):
    """J10."""
    enabled = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(_text("s_nationkey").alias("project"), F.lit(False).alias("failed")).distinct()
    running = _t(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(_text("c_nationkey").alias("project")).distinct()
    return reconcile.registry(enabled, running)


@query("""
SELECT * FROM (VALUES ('P_SIZE', 'int', false), ('P_NAME', 'str', false), ('P_API_KEY', 'int', true), ('EVENT_OK', 'bool', false), ('MIXED', 'str', false)) t(field, type, sensitive)
""")
def infer_types(spark, sf_dir):
    """Over all rows, the type that every value of a name has."""
    part, events = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "events")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    rows = part.select(F.inline(F.array(pair("P_SIZE", _text("p_size")), pair("P_NAME", F.col("p_name")), pair("P_API_KEY", _text("p_partkey")), pair("MIXED", F.when(F.col("p_size") > 25, "true").otherwise(_text("p_size"))))))
    more = events.select(F.lit("EVENT_OK").alias("name"), (F.col("event_id") > 0).cast("string").alias("value"))
    return contract.infer(rows.union(more)).select("field", "type", "sensitive")


@query("SELECT event_type AS project, CAST(user_id AS VARCHAR) AS path, max(ts) AS last FROM events GROUP BY 1, 2 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE")
def idle_keys(spark, sf_dir):
    """T2, T3 as a batch."""
    events = _t(spark, sf_dir, "events").select(F.col("event_type").alias("project"), _text("user_id").alias("path"), "ts")
    return idle.idle_batch(events, 300)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS path, min(ts) AS first, max(ts) + INTERVAL 1 HOUR AS until, count(*) AS n FROM s GROUP BY user_id, k
""")
def debounce_sessions(spark, sf_dir):
    """T5 as a batch."""
    events = _t(spark, sf_dir, "events").select(_text("user_id").alias("path"), "ts")
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return idle.bursts(events, "1 hour").select("path", stamp("first"), stamp("until"), "n")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def changed_files(spark, sf_dir):
    """Lines of orders that the change list has as modified."""
    lines = _t(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("path"), "l_linenumber")
    changes = _t(spark, sf_dir, "orders").select(_text("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "M").otherwise("D").alias("status"))
    return files.changed(lines, changes)


@query("""
WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS lines FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*#'))) AS BIGINT) AS n_comments FROM l
""")
def document_lines(spark, sf_dir):
    """Physical lines and comments of whole texts."""
    docs = _t(spark, sf_dir, "documents").select(_text("doc_id").alias("path"), F.col("text").alias("content"))
    return dotenv.physical_lines(docs).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(classify.comment_line(F.col("line"))).alias("n_comments"))


from . import derived  # noqa: E402, F401  registers its queries too
