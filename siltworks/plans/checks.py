"""Queries of profiling, contracts, quality rules and routing, over dirty_sales and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import values as v
from siltworks.operators import contract as ct
from siltworks.operators import profile as pf
from siltworks.operators import quality as q
from siltworks.sources.work import stored

from .views import COLUMNS, CONTRACT, DIRTY_SALES, EVENT_COLUMNS, TYPED_SQL, column_facts_sql, dirty_sales, table

FILE = "source_file"


def _text(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def profile_table(spark, sf_dir):
    return pf.table_profile(dirty_sales(spark, sf_dir))


def profile_duplicates(spark, sf_dir):
    return pf.duplicate_rows(dirty_sales(spark, sf_dir))


def _profile(spark, sf_dir):
    return pf.profile(stored(dirty_sales(spark, sf_dir), "dirty"))


def profile_nulls(spark, sf_dir):
    return pf.null_counts(dirty_sales(spark, sf_dir)).select("column", "null_count", F.round(F.col("null_count") / F.col("row_count"), 6).alias("null_ratio"))


def profile_distinct(spark, sf_dir):
    return _profile(spark, sf_dir).select("column", "distinct_count", F.round("cardinality_ratio", 6).alias("cardinality_ratio"), "is_unique")


def profile_decided(spark, sf_dir):
    """The limits that distinct counts decide, by sketches and exact counts near a limit alone."""
    p = pf.profile(stored(dirty_sales(spark, sf_dir), "dirty"), exact=False)
    return p.select("column", "is_unique", (F.col("distinct_count") <= pf.CATEGORICAL_VALUES).alias("few_values"), (F.col("cardinality_ratio") <= pf.CATEGORICAL_RATIO).alias("low_ratio"), "is_categorical", "is_identifier_candidate")


def profile_types(spark, sf_dir):
    return pf.facts(dirty_sales(spark, sf_dir)).select("column", "inferred_type").unionByName(pf.facts(table(spark, sf_dir, "events")).select("column", "inferred_type"))


def profile_minmax(spark, sf_dir):
    return pf.facts(dirty_sales(spark, sf_dir)).where("inferred_type IN ('integer', 'decimal', 'datetime')").select("column", F.coalesce("min_number", F.unix_seconds(F.col("min_date").cast("timestamp")).cast("double")).alias("min"), F.coalesce("max_number", F.unix_seconds(F.col("max_date").cast("timestamp")).cast("double")).alias("max"))


def profile_samples(spark, sf_dir):
    return pf.samples(dirty_sales(spark, sf_dir).select("product", "category", "region", "status", "order_date_text", "source_file", "line_number"))


def profile_flags(spark, sf_dir):
    return _profile(spark, sf_dir).select("column", "is_categorical", "is_identifier_candidate", F.array_join("identifier_reasons", ",").alias("reasons"))


def name_tokens(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "part").select(F.initcap("p_name").alias("name")))
    return names.select(F.explode(v.name_tokens(F.regexp_replace("name", " ", ""))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def value_shapes(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")).union(table(spark, sf_dir, "part").select("p_brand")).union(table(spark, sf_dir, "orders").select("o_orderpriority"))
    return names.groupBy(v.value_shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


#: A contract that dirty_sales breaks in every way.
STRICT = {**{k: r for k, r in CONTRACT.items() if k != "region"}, "status": {"type": "integer", "nullable": False}, "quantity": {"type": "integer", "nullable": False, "min": 1, "max": 40}, "product": {"type": "datetime", "nullable": False}, "order_id": {"type": "integer", "nullable": False, "unique": True}, "line_number": {"type": "boolean", "nullable": False}, "discount": {"type": "decimal", "nullable": True}}


def contract_columns(spark, sf_dir):
    df = dirty_sales(spark, sf_dir)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return ct.column_issues(spark, [c for c in df.columns if c != FILE], STRICT).join(rows, F.lit(True))


def contract_types(spark, sf_dir):
    return ct.rule_counts(dirty_sales(spark, sf_dir), STRICT, FILE).where("rule = 'type'").select(FILE, "column", "n")


def contract_rules(spark, sf_dir):
    return ct.rule_counts(dirty_sales(spark, sf_dir), STRICT, FILE).where("rule <> 'type'")


def contract_unique(spark, sf_dir):
    return ct.unique_counts(dirty_sales(spark, sf_dir), ["order_id", "customer_id"], FILE)


def contract_report(spark, sf_dir):
    return ct.report(dirty_sales(spark, sf_dir), CONTRACT, FILE)


#: Kinds of columns that contracts ask for, in order; two of the same shape tell no file.
STRUCTURES = [
    ("sales", [CONTRACT[c]["type"] for c in COLUMNS if c != FILE]),
    ("events", ["integer", "datetime", "integer", "string", "decimal", "string"]),
    ("countries", ["integer", "string", "decimal"]),
    ("states", ["decimal", "string", "integer"]),
]


def match_contract(spark, sf_dir):
    """The structure of sales and events, as profiled, against contracts."""
    kinds = lambda df, name: pf.facts(df).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "inferred_type"))), lambda s: s["inferred_type"]).alias("kinds")).select(F.lit(name).alias("file"), "kinds")
    files = kinds(dirty_sales(spark, sf_dir).drop(FILE), "sales").unionByName(kinds(table(spark, sf_dir, "events"), "events")).unionByName(kinds(table(spark, sf_dir, "nation"), "nation"))
    contracts = spark.createDataFrame(STRUCTURES, "contract string, kinds array<string>")
    return ct.match_structure(files, contracts)


def contract_registry(spark, sf_dir):
    """Versions of contracts, one for each user's day of events."""
    day = F.dayofmonth("ts")
    versions = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("set_"), F.col("user_id").cast("string")).alias("dataset"), day.alias("d")).agg(F.count(F.lit(1)).alias("k"))
    status = F.when(F.col("k") % 4 == 0, F.lit(None)).when(F.col("k") % 4 == 1, "PROPOSED").when(F.col("k") % 4 == 2, "REJECTED").otherwise("VALIDATED")
    return ct.registry(versions.select("dataset", F.concat(F.lit("1."), F.col("d").cast("string")).alias("version"), status.alias("status")))


def _issues(spark, sf_dir):
    return q.with_severity(q.issues(dirty_sales(spark, sf_dir), FILE), CONTRACT)


def quality_report(spark, sf_dir):
    return q.issues(dirty_sales(spark, sf_dir), FILE)


def quality_severity(spark, sf_dir):
    return _issues(spark, sf_dir).groupBy(FILE, "severity").agg(F.count(F.lit(1)).alias("issues"), F.sum("n").alias("values"))


def quality_corrections(spark, sf_dir):
    return q.corrections(_issues(spark, sf_dir), approved=True).select(FILE, "issue", "column", "step", "will_run")


def _decisions(spark, sf_dir):
    return q.decide(ct.report(dirty_sales(spark, sf_dir), CONTRACT, FILE), _issues(spark, sf_dir), FILE)


def ingest_decision(spark, sf_dir):
    return _decisions(spark, sf_dir)


def batch_decision(spark, sf_dir):
    return q.batch_decision(_decisions(spark, sf_dir))


def route_rows(spark, sf_dir):
    routed = stored(q.route(dirty_sales(spark, sf_dir), stored(_decisions(spark, sf_dir), "decisions"), FILE), "routed", "decision")
    return routed.groupBy("decision", "rule").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(FILE).alias("files"))


def profile_admitted(spark, sf_dir):
    decisions = stored(_decisions(spark, sf_dir), "decisions")
    return pf.facts(q.admitted(dirty_sales(spark, sf_dir), decisions, FILE)).select("column", "row_count", "null_count")


def _long(expressions: dict[str, str], view: str = "dirty_sales") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} FROM {view}" for c, e in expressions.items())


_EVENTS = {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "decimal", "props": "string"}
_TYPES = {"order_id": "integer", "line_number": "integer", "order_date": "datetime", "order_date_text": "datetime", "customer_id": "integer", "product": "string", "category": "string", "region": "string", "quantity": "integer", "unit_price": "decimal", "tax_rate": "decimal", "status": "string", "source_file": "string"}
#: Types by the data: whole numbers in a double are integers, texts that all parse are dates.
_TYPE_SQL = {c: f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN bool_and({c} % 1 = 0) THEN 'integer' ELSE 'decimal' END" if c in ("quantity", "unit_price", "tax_rate") else f"CASE WHEN count(*) FILTER (WHERE regexp_matches({c}, '^\\s*\\d{{4}}-\\d\\d-\\d\\d') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) >= 0.9 * count({c}) THEN 'datetime' ELSE 'string' END" if t in ("string",) or c == "order_date_text" else f"max('{t}')" for c, t in _TYPES.items()}
_NUMBERS = ["order_id", "line_number", "customer_id", "quantity", "unit_price", "tax_rate"]
_SAMPLED = ["product", "category", "region", "status", "order_date_text", "source_file", "line_number"]
_DUPLICATES = f"SELECT source_file, CAST(count(*) - count(DISTINCT ({', '.join(COLUMNS)})) AS BIGINT) AS n FROM dirty_sales GROUP BY 1"
_ISSUES = f"""{DIRTY_SALES}, found AS (SELECT * FROM (
SELECT source_file, 'duplicate' AS issue, '*' AS "column", n FROM ({_DUPLICATES})
UNION ALL SELECT source_file, 'null', 'status', count(*) FILTER (WHERE status IS NULL) FROM dirty_sales GROUP BY 1
UNION ALL SELECT source_file, 'positive', 'quantity', count(*) FILTER (WHERE quantity <= 0) FROM dirty_sales GROUP BY 1
UNION ALL SELECT source_file, 'not_negative', 'unit_price', count(*) FILTER (WHERE unit_price < 0) FROM dirty_sales GROUP BY 1
UNION ALL SELECT source_file, 'not_blank', 'product', count(*) FILTER (WHERE coalesce(trim(product), '') = '') FROM dirty_sales GROUP BY 1) WHERE n > 0),
graded AS (SELECT *, CASE WHEN issue = 'duplicate' OR (issue = 'null' AND "column" = 'status') THEN 'WARNING' ELSE 'BLOCKING' END AS severity FROM found),
errors AS (SELECT source_file, CAST((count(*) FILTER (WHERE quantity < 1) > 0)::INT + (count(*) FILTER (WHERE unit_price < 0) > 0)::INT AS BIGINT) AS errors FROM dirty_sales GROUP BY 1),
rules AS (SELECT e.source_file, CASE WHEN errors > 0 THEN 'CONTRACT_VIOLATION' WHEN count(*) FILTER (WHERE severity = 'BLOCKING') > 0 THEN 'QUALITY_ISSUES' WHEN count(severity) > 0 THEN 'PASSED_WITH_WARNINGS' ELSE 'ALL_CHECKS_PASSED' END AS rule
  FROM errors e LEFT JOIN graded g ON g.source_file = e.source_file GROUP BY e.source_file, errors),
decisions AS (SELECT source_file, CASE rule WHEN 'CONTRACT_VIOLATION' THEN 'REJECT' WHEN 'QUALITY_ISSUES' THEN 'QUARANTINE' ELSE 'INGEST' END AS decision, rule FROM rules)"""
_RULES = {("quantity", "min"): "quantity < 1", ("quantity", "max"): "quantity > 40", ("status", "null"): "status IS NULL", ("unit_price", "min"): "unit_price < 0", ("tax_rate", "max"): "tax_rate > 1"}
_BAD_TYPES = {"status": "status IS NOT NULL", "product": "TRY_CAST(product AS TIMESTAMP) IS NULL", "line_number": "line_number IS NOT NULL", "quantity": "quantity % 1 <> 0"}

ORACLES = {
    "profile_table": f"WITH {DIRTY_SALES} SELECT count(*) AS row_count, CAST({len(COLUMNS)} AS BIGINT) AS column_count FROM dirty_sales",
    "profile_duplicates": f"WITH {DIRTY_SALES} SELECT (SELECT count(*) FROM dirty_sales) - count(*) AS duplicate_rows FROM (SELECT DISTINCT * FROM dirty_sales)",
    "profile_nulls": f"WITH {DIRTY_SALES} " + _long({c: f"count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_ratio" for c in COLUMNS}),
    "profile_distinct": f"WITH {DIRTY_SALES} " + _long({c: f"count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count({c}), 6) AS cardinality_ratio, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique" for c in COLUMNS}),
    "profile_types": f"WITH {DIRTY_SALES} " + _long({c: f"{e} AS inferred_type" for c, e in _TYPE_SQL.items()}) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{t}'" for c, t in _EVENTS.items()),
    "profile_minmax": f"WITH {DIRTY_SALES} " + _long({**{c: f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" for c in _NUMBERS}, **{c: f"CAST(epoch(min(CAST({c} AS TIMESTAMP))) AS DOUBLE) AS min, CAST(epoch(max(CAST({c} AS TIMESTAMP))) AS DOUBLE) AS max" for c in ("order_date", "order_date_text")}}),
    "profile_samples": f"WITH {DIRTY_SALES} SELECT \"column\", value, CAST(n AS INTEGER) AS position FROM (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY value) AS n FROM (SELECT DISTINCT \"column\", value FROM (" + _long({c: f"{_text(c)} AS value" for c in _SAMPLED}) + ") WHERE value IS NOT NULL)) WHERE n <= 5",
    "profile_decided": f"WITH {DIRTY_SALES} " + _long({c: f"count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique, count(DISTINCT {c}) <= 50 AS few_values, count(DISTINCT {c}) / count({c}) <= 0.5 AS low_ratio, " + (f"count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count({c}) <= 0.5" if t == "string" and c != "order_date_text" else "bool_or(false)") + f" AS is_categorical, bool_or({'true' if c.endswith(('_id', '_number')) else 'false'}) AS is_identifier_candidate" for c, t in _TYPES.items()}),
    "profile_flags": f"WITH {DIRTY_SALES} " + _long({c: (f"count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count({c}) <= 0.5" if t == "string" and c != "order_date_text" else "bool_or(false)") + f" AS is_categorical, bool_or({'true' if c.endswith(('_id', '_number')) else 'false'}) AS is_identifier_candidate, max('{'name' if c.endswith(('_id', '_number')) else ''}') AS reasons" for c, t in _TYPES.items()}),
    "name_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(c_name), '[a-z0-9]+')) AS token FROM customer UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part) GROUP BY 1",
    "value_shapes": "SELECT regexp_replace(regexp_replace(regexp_replace(substr(x, 1, 40), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM (SELECT c_name AS x FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1",
    "contract_columns": f"""WITH {DIRTY_SALES}, rules("column") AS (VALUES {", ".join(f"('{c}')" for c in STRICT)}), names AS (SELECT column_name AS "column" FROM (DESCRIBE FROM dirty_sales) WHERE column_name <> '{FILE}')
SELECT *, (SELECT count(*) FROM dirty_sales) AS rows FROM (SELECT "column", 'missing_column' AS issue, 'error' AS severity FROM rules ANTI JOIN names USING ("column") UNION ALL SELECT "column", 'unexpected_column', 'warning' FROM names ANTI JOIN rules USING ("column"))""",
    "contract_types": f"WITH {DIRTY_SALES} SELECT * FROM (" + " UNION ALL ".join(f"SELECT source_file, '{c}' AS \"column\", count(*) FILTER (WHERE {e}) AS n FROM dirty_sales GROUP BY 1" for c, e in _BAD_TYPES.items()) + ") WHERE n > 0",
    "contract_rules": f"WITH {DIRTY_SALES} SELECT * FROM (" + " UNION ALL ".join(f"SELECT source_file, '{c}' AS \"column\", '{r}' AS rule, count(*) FILTER (WHERE {e}) AS n FROM dirty_sales GROUP BY 1" for (c, r), e in _RULES.items()) + ") WHERE n > 0",
    "contract_unique": f"WITH {DIRTY_SALES} SELECT * FROM (" + " UNION ALL ".join(f"SELECT source_file, '{c}' AS \"column\", 'unique' AS rule, count({c}) - count(DISTINCT {c}) AS n FROM dirty_sales GROUP BY 1" for c in ("order_id", "customer_id")) + ") WHERE n > 0",
    "contract_report": f"WITH {_ISSUES} SELECT source_file, errors = 0 AS valid, errors, CAST(0 AS BIGINT) AS warnings FROM errors",
    "match_contract": f"""WITH {DIRTY_SALES}, told AS ({column_facts_sql("sales", "dirty_sales", [c for c in COLUMNS if c != FILE])} UNION ALL {column_facts_sql("events", "events", EVENT_COLUMNS)} UNION ALL {column_facts_sql("nation", "nation", ["n_nationkey", "n_name", "n_regionkey"])}), {TYPED_SQL},
files AS (SELECT table_name AS file, list(replace(replace(kind, 'integer', 'number'), 'decimal', 'number') ORDER BY place) AS kinds FROM typed GROUP BY 1),
contracts(contract, kinds) AS (VALUES {", ".join(f"('{name}', {[k.replace('integer', 'number').replace('decimal', 'number') for k in kinds]})" for name, kinds in STRUCTURES)}),
met AS (SELECT file, contract FROM files f JOIN contracts c ON len(f.kinds) = len(c.kinds) AND len(list_filter(list_zip(f.kinds, c.kinds), lambda x: x[1] <> x[2] AND x[1] <> 'empty')) = 0)
SELECT file, min(contract) AS contract FROM met GROUP BY 1 HAVING count(*) = 1""",
    "contract_registry": "SELECT dataset, concat('1.', d) AS version, 'VALIDATED' AS status FROM (SELECT concat('set_', user_id) AS dataset, d, k, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS n FROM (SELECT user_id, day(ts) AS d, count(*) AS k FROM events GROUP BY 1, 2) WHERE k % 4 IN (0, 3)) WHERE n = 1",
    "quality_report": f"WITH {_ISSUES} SELECT * FROM found",
    "quality_severity": f"WITH {_ISSUES} SELECT source_file, severity, count(*) AS issues, CAST(sum(n) AS BIGINT) AS values FROM graded GROUP BY 1, 2",
    "quality_corrections": f"WITH {_ISSUES} SELECT source_file, issue, \"column\", CASE issue WHEN 'duplicate' THEN 'deduplicate_rows' ELSE 'fill_null_dimensions' END AS step, true AS will_run FROM graded WHERE severity = 'WARNING'",
    "ingest_decision": f"WITH {_ISSUES} SELECT * FROM decisions",
    "batch_decision": f"WITH {_ISSUES} SELECT CASE WHEN count(DISTINCT decision) = 1 THEN min(decision) ELSE 'PARTIAL' END AS decision, count(*) AS files, count(*) FILTER (WHERE decision = 'INGEST') AS ingest, count(*) FILTER (WHERE decision = 'QUARANTINE') AS quarantine, count(*) FILTER (WHERE decision = 'REJECT') AS reject FROM decisions",
    "route_rows": f"WITH {_ISSUES} SELECT decision, rule, count(*) AS rows, count(DISTINCT source_file) AS files FROM dirty_sales JOIN decisions USING (source_file) GROUP BY 1, 2",
    "profile_admitted": f"WITH {_ISSUES}, kept AS (SELECT * FROM dirty_sales WHERE source_file IN (SELECT source_file FROM decisions WHERE decision = 'INGEST')) " + _long({c: f"count(*) AS row_count, count(*) - count({c}) AS null_count" for c in COLUMNS}, "kept"),
}

QUERIES = {
    f.__name__: f
    for f in (
        profile_table, profile_duplicates, profile_nulls, profile_distinct, profile_decided, profile_types, profile_minmax, profile_samples, profile_flags, name_tokens, value_shapes, contract_columns, contract_types, contract_rules, contract_unique,
        contract_report, match_contract, contract_registry, quality_report, quality_severity, quality_corrections, ingest_decision, batch_decision, route_rows, profile_admitted,
    )
}
