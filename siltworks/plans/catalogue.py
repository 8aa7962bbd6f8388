"""Queries of the column catalogue: roles and what follows from them, over profiles of the sales and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import catalogue as ca
from siltworks.operators import contract as ct
from siltworks.operators import profile as pf
from siltworks.sources.work import stored

from .views import COLUMNS, CONTRACT, DIRTY_SALES, EVENT_COLUMNS, TYPED_SQL, column_facts_sql, dirty_sales, table

_COMMON = ["table_name", "position", "column", "dtype", "inferred_type", "null_count", "row_count", "distinct_count", "is_unique", "identifier_reasons", "is_identifier_candidate", "is_categorical", "min_number", "max_number", "has_time", "has_blank"]


def _profiles(spark, sf_dir):
    """Profiles of two tables as rows of one catalogue."""
    frames = {"sales": stored(dirty_sales(spark, sf_dir), "dirty"), "events": table(spark, sf_dir, "events")}
    parts = [pf.profile(df).withColumn("table_name", F.lit(name)).select(*_COMMON) for name, df in frames.items()]
    return stored(parts[0].unionByName(parts[1]), "profiles")


def _roles(spark, sf_dir):
    profile = _profiles(spark, sf_dir)
    return profile, stored(ca.roles(profile), "roles")


def match_keywords(spark, sf_dir):
    return ca.match_keywords(_profiles(spark, sf_dir))


def column_roles(spark, sf_dir):
    return _roles(spark, sf_dir)[1].drop("position")


def key_candidates(spark, sf_dir):
    return ca.keys(*_roles(spark, sf_dir)).drop("position")


def key_orphans(spark, sf_dir):
    """Orders of lines that the orders table lacks, and customers without an order."""
    lines = ca.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit("lineitem").alias("child"), "orphans")
    customers = ca.orphans(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit("customer").alias("child"), "orphans")
    return lines.unionByName(customers)


#: Keys of the tables that sales rows come from.
PARENTS = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")]


def key_inclusions(spark, sf_dir):
    """Every pair of the key candidates of both tables and of the keys of their parents, by their values."""
    candidates = [(r.table_name, r.column) for r in ca.keys(*_roles(spark, sf_dir)).collect()]
    frames = {"sales": dirty_sales(spark, sf_dir), **{t: table(spark, sf_dir, t) for t in ("events", "orders", "customer", "nation")}}
    return ca.inclusions(frames, sorted(candidates) + PARENTS)


def table_domain(spark, sf_dir):
    return ca.domains(_roles(spark, sf_dir)[1])


def role_overrides(spark, sf_dir):
    _, roles = _roles(spark, sf_dir)
    accepted = roles.where("table_name = 'events' AND column = 'value'").select("table_name", "column", F.lit("MEASURE").alias("semantic_role"), F.lit("AMOUNT").alias("business_role"))
    new = stored(ca.override(roles, accepted), "roles")
    return new.join(ca.domains(new).select("table_name", "domain"), "table_name").select("table_name", "column", "semantic_role", "business_role", "confidence", "domain")


def restrict_to_contract(spark, sf_dir):
    contract = ct.rule_rows(spark, {k: r for k, r in CONTRACT.items() if k not in ("region", "tax_rate")})
    return ca.restrict(_roles(spark, sf_dir)[1].where("table_name = 'sales'"), contract).select("column", "semantic_role")


def cancellation_values(spark, sf_dir):
    return ca.cancellation_values(dirty_sales(spark, sf_dir), "status")


def generate_contract(spark, sf_dir):
    profile, roles = _roles(spark, sf_dir)
    sales = profile.where("table_name = 'sales'")
    roles = roles.where("table_name = 'sales'")
    return ct.generate(sales, roles, ca.keys(sales, roles))


def kpi_catalogue(spark, sf_dir):
    profile, roles = _roles(spark, sf_dir)
    return ca.kpis(roles, profile)


def cleaning_actions(spark, sf_dir):
    profile, roles = _roles(spark, sf_dir)
    duplicates = pf.duplicate_rows(dirty_sales(spark, sf_dir)).withColumn("table_name", F.lit("sales"))
    return ca.cleaning_actions(profile, roles, ct.rule_rows(spark, CONTRACT), duplicates)


def gold_specs(spark, sf_dir):
    profile, roles = _roles(spark, sf_dir)
    return ca.gold_specs(profile, roles, ca.keys(profile, roles), ct.rule_rows(spark, CONTRACT))


_KEYWORDS = ", ".join(f"('{kind}', '{role}', '{word}', {i})" for kind, of in ca.VOCABULARY.items() for i, (role, word) in enumerate((role, word) for role, words in of.items() for word in words))

def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Roles from names, types and counts of the tables, over the fixed keywords and figures of the rules.
_K = ca.CONFIDENCE
_ROLES = f"""keywords(kind, role, keyword, priority) AS (VALUES {_KEYWORDS}),
told AS ({column_facts_sql("sales", "dirty_sales", COLUMNS)} UNION ALL {column_facts_sql("events", "events", EVENT_COLUMNS)}),
{TYPED_SQL},
hinted AS (SELECT *, list_has_any(words, [{", ".join(f"'{w}'" for w in pf.ID_TOKENS)}]) AS strong, len(words) > 1 AND words[1] IN {_in(pf.ID_STARTS)} OR words[-1] IN {_in(pf.ID_ENDS)} OR list_has_any(words, [{", ".join(f"'{w}'" for w in pf.ID_TOKENS)}]) AS by_name,
  is_unique AND n >= {pf.IDENTIFIER_ROWS} AND kind IN ('integer', 'string') AS by_values FROM typed),
hits AS (SELECT DISTINCT "column", k.kind AS of, role, priority FROM hinted JOIN keywords k ON contains(concat('_', array_to_string(words, '_'), '_'), concat('_', keyword, '_'))),
met AS (SELECT "column", {', '.join(f"arg_min(role, priority) FILTER (WHERE of = '{k}') AS {k}" for k in ca.VOCABULARY)} FROM hits GROUP BY 1),
known_columns AS (SELECT h.*, measure, contact, dimension, temporal, entity, kind = 'decimal' AND low >= 0 AND high <= 1 AS between_0_and_1, coalesce(dimension = 'GEOGRAPHY' OR dimension IS NOT NULL AND NOT (strong OR is_unique), false) AS dimension_wins,
  kind = 'boolean' OR kind = 'string' AND NOT (by_name OR by_values) AND (d <= {pf.CATEGORICAL_VALUES} OR d / nullif(known, 0) <= {pf.CATEGORICAL_RATIO}) AS categorical FROM hinted h LEFT JOIN met USING ("column")),
judged AS (SELECT *, (by_name OR by_values) AND NOT dimension_wins AND NOT (by_values AND NOT by_name AND blank) AS identifier, CASE WHEN measure = 'LEVEL' AND between_0_and_1 THEN NULL ELSE measure END AS m FROM known_columns),
roles AS (SELECT table_name, "column", place, n, is_unique, by_name, entity,
  CASE WHEN kind = 'empty' THEN 'ATTRIBUTE' WHEN kind = 'datetime' THEN 'TEMPORAL' WHEN contact IS NOT NULL THEN 'ATTRIBUTE' WHEN identifier THEN 'IDENTIFIER'
   WHEN kind IN ('integer', 'decimal') THEN CASE WHEN dimension IS NOT NULL AND m IS NULL THEN 'DIMENSION' ELSE 'MEASURE' END WHEN kind = 'boolean' OR dimension IS NOT NULL OR categorical THEN 'DIMENSION' ELSE 'ATTRIBUTE' END AS semantic_role,
  CASE WHEN kind = 'empty' THEN NULL WHEN kind = 'datetime' THEN CASE WHEN timed OR temporal = 'TIMESTAMP' THEN 'TIMESTAMP' ELSE 'DATE' END WHEN contact IS NOT NULL THEN 'CONTACT' WHEN identifier THEN NULL
   WHEN kind IN ('integer', 'decimal') THEN CASE WHEN dimension IS NOT NULL AND m IS NULL THEN dimension WHEN m IS NOT NULL THEN m WHEN between_0_and_1 THEN 'RATIO' END WHEN kind = 'boolean' THEN 'FLAG' WHEN dimension IS NOT NULL THEN dimension WHEN categorical AND entity IS NULL THEN 'CATEGORY' END AS business_role,
  CASE WHEN kind = 'empty' THEN {_K["empty"]} WHEN kind = 'datetime' THEN CASE WHEN temporal IS NOT NULL THEN {_K["temporal_named"]} ELSE {_K["temporal"]} END WHEN contact IS NOT NULL THEN {_K["contact"]}
   WHEN identifier THEN CASE WHEN by_name AND by_values THEN {_K["identifier_both"]} WHEN by_name THEN {_K["identifier_named"]} ELSE {_K["identifier_unique"]} END
   WHEN kind IN ('integer', 'decimal') THEN CASE WHEN dimension IS NOT NULL AND m IS NULL THEN {_K["number_dimension"]} WHEN m IS NOT NULL THEN {_K["measure_named"]} WHEN between_0_and_1 THEN {_K["measure_ratio"]} ELSE {_K["measure"]} END
   WHEN kind = 'boolean' THEN {_K["flag"]} WHEN dimension IS NOT NULL THEN CASE WHEN categorical THEN {_K["dimension_categorical"]} ELSE {_K["dimension"]} END WHEN categorical THEN CASE WHEN entity IS NULL THEN {_K["categorical"]} ELSE {_K["categorical_entity"]} END ELSE {_K["attribute"]} END AS confidence FROM judged)"""
_DOMAINS = f"""signs AS (SELECT table_name, count(DISTINCT business_role) FILTER (WHERE semantic_role = 'MEASURE' AND business_role IN ('AMOUNT', 'PRICE')) AS money,
  count(DISTINCT business_role) FILTER (WHERE semantic_role = 'MEASURE' AND business_role = 'QUANTITY') + count(DISTINCT entity) FILTER (WHERE entity IN {_in(ca.SALES_ENTITIES)}) AS others FROM {{0}} GROUP BY 1),
domains AS (SELECT table_name, CASE WHEN money > 0 AND money + others >= 2 THEN 'SALES' ELSE 'UNKNOWN' END AS domain, CASE WHEN money > 0 AND money + others >= 2 THEN round(least({ca.DOMAIN_MOST}, {ca.DOMAIN_BASE} + {ca.DOMAIN_STEP} * (money + others)), 2) ELSE 0 END AS confidence FROM signs)"""

#: Dimensions with their numbers of values, in the order of aggregates; `priority` is the order of breakdowns.
_AXES = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{column}' AS \"column\", {i} AS position, {priority} AS priority, count(DISTINCT {column}) AS n FROM {source}"
    for name, source, columns in (("sales", "dirty_sales", (("product", 0), ("category", 3), ("region", 2), ("status", 4), ("source_file", 3))), ("events", "events", (("event_type", 3), ("props", 3))))
    for i, (column, priority) in enumerate(columns)
)
_TEXTS = "('product', 'category', 'region', 'status', 'source_file', 'event_type', 'props')"

ORACLES = {
    "match_keywords": f"""WITH {DIRTY_SALES}, keywords(kind, role, keyword, priority) AS (VALUES {_KEYWORDS}),
names AS (SELECT column_name AS name FROM (DESCRIBE FROM dirty_sales) UNION SELECT column_name FROM (DESCRIBE FROM events)),
found AS (SELECT name, kind, role, priority FROM names JOIN keywords ON contains(concat('_', lower(name), '_'), concat('_', keyword, '_')))
SELECT name AS "column", {', '.join(f"arg_min(role, priority) FILTER (WHERE kind = '{k}') AS {k}" for k in ca.VOCABULARY)} FROM names LEFT JOIN found USING (name) GROUP BY 1""",
    "kpi_catalogue": f"""WITH {DIRTY_SALES}, {_ROLES}, axes AS (SELECT * FROM ({_AXES}) a WHERE n <= 50 QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY priority, position) <= 4),
main(table_name, label, expression, sure) AS (VALUES ('sales', 'Revenue', 'SUM(quantity * unit_price)', 0.86), ('events', 'Number of Lines', 'COUNT(*)', 0.95)),
words AS (SELECT *, string_split("column", '_') AS w FROM axes)
SELECT table_name, kpi, formula, kind, CAST(confidence AS DOUBLE) AS confidence FROM (
SELECT * FROM (VALUES ('sales', 'Orders', 'COUNT(DISTINCT order_id)', 'scalar', 0.85), ('sales', 'Quantity Sold', 'SUM(quantity)', 'scalar', 0.9), ('sales', 'Average Order Value', 'SUM(quantity * unit_price) / COUNT(DISTINCT order_id)', 'scalar', 0.85), ('sales', 'Customers', 'COUNT(DISTINCT customer_id)', 'scalar', 0.85),
 ('sales', 'Products', 'COUNT(DISTINCT product)', 'scalar', 0.85), ('sales', 'Average Unit Price', 'AVG(unit_price)', 'scalar', 0.9), ('sales', 'Average tax_rate', 'AVG(tax_rate)', 'scalar', 0.9), ('events', 'Total value', 'SUM(value)', 'scalar', 0.48)) v(table_name, kpi, formula, kind, confidence)
UNION ALL SELECT table_name, label, expression, 'scalar', sure FROM main
UNION ALL SELECT table_name, concat(label, ' by Month'), concat(expression, ' GROUP BY MONTH(', CASE table_name WHEN 'sales' THEN 'order_date' ELSE 'ts' END, ')'), 'trend', CASE table_name WHEN 'sales' THEN 0.82 ELSE 0.8 END FROM main
UNION ALL SELECT table_name, concat(label, ' by ', array_to_string(list_transform(w, lambda x: concat(upper(x[1]), x[2:])), ' ')), concat(expression, ' GROUP BY ', "column"), 'breakdown', round(least(sure * 0.95, confidence), 2) FROM words JOIN main USING (table_name) JOIN roles USING (table_name, "column")) k""",
    "cleaning_actions": f"""WITH {DIRTY_SALES}, {_ROLES}, texts AS (SELECT * FROM roles WHERE "column" IN {_TEXTS}), actions AS (
SELECT table_name, 'trim' AS action, "column" FROM texts UNION ALL SELECT table_name, 'normalize', "column" FROM texts WHERE business_role IN ('STATUS', 'CATEGORY')
UNION ALL SELECT 'sales', 'cast', 'order_date_text' UNION ALL SELECT 'sales', 'check', "column" FROM roles WHERE table_name = 'sales' AND "column" <> 'source_file'
UNION ALL SELECT 'sales', 'fill_unknown', 'status' FROM dirty_sales HAVING count(*) > count(status) UNION ALL SELECT 'sales', 'derive_amount', 'quantity * unit_price'
UNION ALL SELECT 'sales', 'deduplicate', '*' FROM dirty_sales HAVING count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_sales))
UNION ALL SELECT 'sales', 'derive_date_parts', 'order_date' UNION ALL SELECT 'events', 'derive_date_parts', 'ts')
SELECT table_name, CAST(list_position([{', '.join(f"'{a}'" for a in ca.STEP_ORDER)}], action) AS INTEGER) AS step, action, "column", action IN ('drop_null_keys', 'fill_unknown', 'deduplicate') AS destructive FROM actions""",
    "gold_specs": f"""WITH {DIRTY_SALES}, {_ROLES}, axes AS (SELECT * FROM ({_AXES}) a WHERE n <= 50 QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY position) <= 3),
metrics(table_name, "column", operation) AS (VALUES ('sales', 'quantity', 'SUM'), ('sales', 'unit_price', 'AVG'), ('sales', 'line_amount', 'SUM'), ('events', 'value', 'AVG')),
named AS (SELECT table_name, concat(table_name, '_by_', "column") AS gold_table FROM axes UNION ALL SELECT t, concat(t, x) FROM (VALUES ('sales'), ('events')) v(t), (VALUES ('_by_month'), ('_summary')) w(x)),
dims(table_name, entity, "column") AS (VALUES ('sales', 'customer', 'customer_id'), ('sales', 'order', 'order_id'), ('sales', 'line_number', 'line_number'), ('sales', 'product', 'product'), ('events', 'user', 'user_id'))
SELECT table_name, gold_table, 'aggregate' AS kind, "column", operation FROM named JOIN metrics USING (table_name)
UNION ALL SELECT table_name, concat('fact_', table_name), 'fact', "column", NULL FROM (SELECT table_name, "column" FROM roles UNION ALL SELECT 'sales', 'line_amount') f
UNION ALL SELECT table_name, concat(table_name, '_dim_', entity), 'dimension', "column", NULL FROM dims
UNION ALL SELECT t, concat(t, '_dim_date'), 'dimension', c, NULL FROM (VALUES ('sales'), ('events')) v(t), (VALUES ('date'), ('year'), ('quarter'), ('month'), ('day')) w(c)""",
    "column_roles": f"WITH {DIRTY_SALES}, {_ROLES} SELECT table_name, \"column\", semantic_role, business_role, entity, CAST(confidence AS DOUBLE) AS confidence FROM roles",
    "key_candidates": f"""WITH {DIRTY_SALES}, {_ROLES}, ids AS (SELECT *, coalesce(entity, nullif(upper(array_to_string(list_filter(string_split(lower("column"), '_'), lambda w: w NOT IN {_in(pf.ID_TOKENS)}), '_')), '')) AS referenced_entity, is_unique AND n >= {ca.UNIQUE_ROWS} AS first_key FROM roles WHERE semantic_role = 'IDENTIFIER')
SELECT table_name, "column", CASE WHEN first_key THEN 'PRIMARY_KEY_CANDIDATE' ELSE 'FOREIGN_KEY_CANDIDATE' END AS relationship, referenced_entity, CAST(CASE WHEN first_key THEN confidence WHEN entity IS NOT NULL THEN {_K["foreign_key_entity"]} ELSE {_K["foreign_key"]} END AS DOUBLE) AS confidence FROM ids WHERE first_key OR by_name""",
    "key_orphans": "SELECT 'lineitem' AS child, count(DISTINCT l_orderkey) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer', count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "key_inclusions": f"""WITH {DIRTY_SALES}, held AS ({" UNION ".join(f"SELECT '{t}.{c}' AS name, CAST({c} AS VARCHAR) AS v FROM {'dirty_sales' if t == 'sales' else t} WHERE {c} IS NOT NULL" for t, c in [("sales", "order_id"), ("sales", "line_number"), ("sales", "customer_id"), ("events", "event_id"), ("events", "user_id"), *PARENTS])}),
sizes AS (SELECT name, count(*) AS n FROM held GROUP BY 1), shared AS (SELECT a.name AS child, b.name AS parent, count(*) AS n FROM held a JOIN held b USING (v) GROUP BY 1, 2)
SELECT a.name AS child, b.name AS parent, a.n AS n_values, a.n - coalesce(s.n, 0) AS missing FROM sizes a JOIN sizes b ON a.name <> b.name LEFT JOIN shared s ON s.child = a.name AND s.parent = b.name""",
    "table_domain": f"WITH {DIRTY_SALES}, {_ROLES}, {_DOMAINS.format('roles')} SELECT table_name, domain, CAST(confidence AS DOUBLE) AS confidence FROM domains",
    "role_overrides": f"""WITH {DIRTY_SALES}, {_ROLES}, given AS (SELECT * REPLACE (CASE WHEN table_name = 'events' AND "column" = 'value' THEN 'MEASURE' ELSE semantic_role END AS semantic_role, CASE WHEN table_name = 'events' AND "column" = 'value' THEN 'AMOUNT' ELSE business_role END AS business_role,
  CASE WHEN table_name = 'events' AND "column" = 'value' THEN {_K["accepted"]} ELSE confidence END AS confidence) FROM roles), {_DOMAINS.format('given')} SELECT table_name, "column", semantic_role, business_role, CAST(given.confidence AS DOUBLE) AS confidence, domain FROM given JOIN domains USING (table_name)""",
    "restrict_to_contract": f"WITH {DIRTY_SALES}, {_ROLES} SELECT \"column\", semantic_role FROM roles WHERE table_name = 'sales' AND \"column\" IN ({', '.join(repr(c) for c in CONTRACT if c not in ('region', 'tax_rate'))})",
    "cancellation_values": f"WITH {DIRTY_SALES} SELECT DISTINCT 'status' AS \"column\", upper(trim(status)) AS value FROM dirty_sales WHERE regexp_matches(lower(status), 'cancel|annul')",
    "generate_contract": f"WITH {DIRTY_SALES} SELECT c AS \"column\", t AS type, CASE WHEN c = 'status' THEN (SELECT count(*) > count(status) FROM dirty_sales) ELSE false END AS nullable, CAST(CASE c WHEN 'unit_price' THEN 0 WHEN 'tax_rate' THEN 0 WHEN 'quantity' THEN (SELECT CASE WHEN min(quantity) >= 1 THEN 1 WHEN min(quantity) >= 0 THEN 0 END FROM dirty_sales) END AS DOUBLE) AS min, CAST(CASE c WHEN 'tax_rate' THEN 1 END AS DOUBLE) AS max, false AS unique FROM (VALUES ('order_id', 'integer'), ('line_number', 'integer'), ('order_date', 'datetime'), ('order_date_text', 'datetime'), ('customer_id', 'integer'), ('product', 'string'), ('category', 'string'), ('region', 'string'), ('quantity', 'integer'), ('unit_price', 'decimal'), ('tax_rate', 'decimal'), ('status', 'string'), ('source_file', 'string')) v(c, t)",
}

QUERIES = {f.__name__: f for f in (match_keywords, column_roles, key_candidates, key_orphans, key_inclusions, table_domain, role_overrides, restrict_to_contract, cancellation_values, generate_contract, kpi_catalogue, cleaning_actions, gold_specs)}
