"""Queries of the Silver, Gold, KPI and analysis layers over the sales views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import analysis as an
from siltworks.operators import gold, kpi
from siltworks.operators import silver as sv
from siltworks.operators.gold import Exclusion, Metric
from siltworks.operators.kpi import Kpi
from siltworks.sources.work import stored

from .views import CONTRACT, DIRTY_SALES, SALES_LINES, SILVER, dirty_sales, sales_lines, text_dates, text_dates_sql

CANCELLED = Exclusion("status", ("CANCELLED",))
KEEPS = "(status IS NULL OR status <> 'CANCELLED')"
METRICS = [Metric("total_sales", "SUM", "line_amount"), Metric("total_quantity", "SUM", "quantity"), Metric("avg_unit_price", "AVG", "unit_price")]


def money(c: str) -> str:
    return f"coalesce(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE), 0)"


METRICS_SQL = f"{money('line_amount')} AS total_sales, {money('quantity')} AS total_quantity, round(avg(unit_price), 6) AS avg_unit_price"


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dirty_sales cleaned: statuses trimmed and upper-cased, rows that break a rule out, repeated rows out, amount and date parts derived."""
    rows = dirty_sales(spark, sf_dir).where((F.col("quantity") >= 1) & (F.col("unit_price") >= 0))
    rows = sv.deduplicate(sv.normalize(rows, ["status"]))
    return sv.derive_date_parts(sv.derive_amount(rows, "quantity", "unit_price"), "order_date")


# -- Silver --------------------------------------------------------------------------------------


def silver_rename(spark, sf_dir):
    odd = sales_lines(spark, sf_dir).select(F.col("order_id").alias("OrderID"), F.col("order_date").alias("Order Date"), F.col("quantity").alias("Quantité Vendue"), F.col("unit_price").alias("unitPrice"))
    return sv.rename(odd).groupBy("order_id").agg(F.count("order_date").alias("order_date"), F.sum("quantite_vendue").alias("quantite_vendue"), F.max("unit_price").alias("unit_price"))


def silver_trim(spark, sf_dir):
    return sv.trim(dirty_sales(spark, sf_dir), ["status", "product"]).groupBy("status", "product").agg(F.count(F.lit(1)).alias("n"))


def silver_cast(spark, sf_dir):
    rows = sv.cast(dirty_sales(spark, sf_dir).select("source_file", "order_date_text", F.col("quantity").cast("string").alias("quantity"), F.col("line_number").cast("string").alias("line_number")), {"order_date_text": "datetime", "quantity": "decimal", "line_number": "integer"})
    return rows.groupBy("source_file").agg(F.min("order_date_text").alias("first_date"), F.max("order_date_text").alias("last_date"), F.sum("quantity").alias("quantity"), F.sum("line_number").alias("line_number"))


def silver_normalize(spark, sf_dir):
    return sv.normalize(dirty_sales(spark, sf_dir), ["status", "category"]).groupBy("status", "category").agg(F.count(F.lit(1)).alias("n"))


def silver_impute(spark, sf_dir):
    return sv.fill_unknown(sv.normalize(dirty_sales(spark, sf_dir), ["status"]), ["status"]).groupBy("source_file", "status").agg(F.count(F.lit(1)).alias("n"))


def silver_drop_null_keys(spark, sf_dir):
    return sv.drop_null_keys(dirty_sales(spark, sf_dir), ["status"]).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def silver_dedup(spark, sf_dir):
    return sv.deduplicate(dirty_sales(spark, sf_dir)).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def silver_line_amount(spark, sf_dir):
    return sv.derive_amount(dirty_sales(spark, sf_dir), "quantity", "unit_price").select("order_id", "line_number", "source_file", F.round("line_amount", 4).alias("line_amount"))


def silver_date_parts(spark, sf_dir):
    return sv.derive_date_parts(sales_lines(spark, sf_dir), "order_date").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


UNIQUE_RULES = {**CONTRACT, "line_key": {"unique": True}}


def silver_quarantine(spark, sf_dir):
    rows = dirty_sales(spark, sf_dir).withColumn("line_key", F.concat_ws("-", "order_id", "line_number", "product", "quantity"))
    flagged = sv.check_rows(rows, UNIQUE_RULES)
    return flagged.groupBy("source_file", F.array_join("_violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def enrich_arith(spark, sf_dir):
    rows = sv.enrich(dirty_sales(spark, sf_dir), [{"kind": "multiply", "left": "quantity", "right": "unit_price", "target": "amount"}, {"kind": "divide", "left": "unit_price", "right": "tax_rate", "target": "per_tax"}, {"kind": "subtract", "left": "unit_price", "right": "tax_rate", "target": "net"}, {"kind": "add", "left": "quantity", "right": "line_number", "target": "both"}])
    return rows.select("order_id", "line_number", F.round("amount", 4).alias("amount"), F.round("per_tax", 4).alias("per_tax"), F.round("net", 4).alias("net"), "both")


def enrich_concat(spark, sf_dir):
    return sv.enrich(dirty_sales(spark, sf_dir), [{"kind": "concat", "columns": ["product", "status"], "separator": " / ", "target": "label"}]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def enrich_datepart(spark, sf_dir):
    parts = ["year", "month", "day", "quarter", "weekday"]
    rows = sv.enrich(dirty_sales(spark, sf_dir), [{"kind": "date_part", "column": "order_date", "part": p, "target": f"d_{p}"} for p in parts])
    return rows.groupBy(*[f"d_{p}" for p in parts]).agg(F.count(F.lit(1)).alias("n"))


def enrich_const(spark, sf_dir):
    return sv.enrich(dirty_sales(spark, sf_dir), [{"kind": "constant", "value": "web", "target": "channel"}]).groupBy("channel", "source_file").agg(F.count(F.lit(1)).alias("n"))


def silver_step_report(spark, sf_dir):
    """The steps' rows as counted while the cleaned rows were written."""
    steps = [sv.Step("trim_strings", "trim", {"columns": ["status", "product"]}), sv.Step("normalize_categories", "normalize", {"columns": ["status"]}), sv.Step("drop_rows_with_null_keys", "filter", {"keys": ["status"]}, destructive=True), sv.Step("deduplicate_rows", "deduplicate", destructive=True), sv.Step("keep_null_measures", "keep_nulls")]
    cleaned = sv.apply_steps(dirty_sales(spark, sf_dir), steps, rules={"quantity": {"min": 1}})
    out = stored(cleaned.passed.select("source_file"), "silver")
    rows = [(i, *r) for i, r in enumerate(cleaned.report(), 1)]
    report = spark.createDataFrame(rows, "step_number int, step string, outcome string, rows_before long, rows_after long")
    return report.join(out.agg(F.count(F.lit(1)).alias("rows_passed")), F.lit(True))


# -- Gold ----------------------------------------------------------------------------------------


def gold_by_month(spark, sf_dir):
    return gold.aggregate(silver(spark, sf_dir), ["year", "month"], [*METRICS, Metric("number_of_lines", "COUNT", "order_date")], CANCELLED)


def gold_by_dimension(spark, sf_dir):
    return gold.aggregate(silver(spark, sf_dir), ["status"], [*METRICS, Metric("number_of_lines", "COUNT", "status")], CANCELLED)


def gold_summary(spark, sf_dir):
    return gold.aggregate(silver(spark, sf_dir), [], [*METRICS, Metric("number_of_lines", "COUNT", "order_id")], CANCELLED)


def gold_fact(spark, sf_dir):
    return gold.fact(silver(spark, sf_dir), ["order_id", "customer_id", "order_date", "product", "category", "region", "status", "quantity", "unit_price", "line_amount"]).withColumn("line_amount", F.round("line_amount", 4))


def gold_dimension(spark, sf_dir):
    order = ["order_date", "order_id", "line_number", "product", "category", "region", "quantity", "source_file"]
    return gold.dimension(silver(spark, sf_dir), "customer_id", ["region", "product"], order)


def gold_dim_date(spark, sf_dir):
    return gold.date_dimension(silver(spark, sf_dir), "order_date")


def gold_grouping_sets(spark, sf_dir):
    return gold.grouping_sets(silver(spark, sf_dir), [["region"], ["category"], []], METRICS[:2], CANCELLED)


def verify_counts(spark, sf_dir):
    s = stored(silver(spark, sf_dir), "silver")
    dates = gold.date_dimension(s, "order_date")
    months = gold.aggregate(s, ["year", "month"], METRICS)
    return gold.verify_counts({"dim_date": dates, "by_month": months}, {"dim_date": stored(dates, "gold"), "by_month": stored(months, "gold")})


def verify_reconcile(spark, sf_dir):
    """Rows that came in, less what the steps took away and what was quarantined, are the rows cleaned."""
    raw = dirty_sales(spark, sf_dir)
    flagged = sv.check_rows(sv.deduplicate(raw), {"quantity": {"min": 1}})
    one = flagged.agg(F.count(F.lit(1)).alias("after_dedup"), F.count_if(F.size("_violations") > 0).alias("quarantined"), F.count_if(F.size("_violations") == 0).alias("silver"))
    both = raw.agg(F.count(F.lit(1)).alias("bronze")).join(one, F.lit(True))
    removed = F.col("bronze") - F.col("after_dedup")
    return both.select("bronze", removed.alias("removed"), "quarantined", "silver", (F.col("bronze") - removed - F.col("quarantined") == F.col("silver")).alias("ok"))


def verify_not_null(spark, sf_dir):
    return gold.verify_not_null(silver(spark, sf_dir), ["order_id", "product", "quantity", "status"])


def verify_totals(spark, sf_dir):
    s = stored(silver(spark, sf_dir), "silver")
    tables = {"by_month": gold.aggregate(s, ["year", "month"], METRICS, CANCELLED), "by_region": gold.aggregate(s, ["region"], METRICS, CANCELLED), "summary": gold.aggregate(s, [], METRICS, CANCELLED)}
    return gold.verify_totals(gold.totals(s, ["line_amount", "quantity"], CANCELLED), tables, {"total_sales": "line_amount", "total_quantity": "quantity"})


# -- KPIs ----------------------------------------------------------------------------------------

REVENUE = Kpi("Revenue", "product", ("quantity", "unit_price"))
ORDERS = Kpi("Orders", "distinct", ("order_id",))
KPIS = [REVENUE, ORDERS, Kpi("Quantity Sold", "sum", ("quantity",)), Kpi("Lines", "rows"), Kpi("Average Unit Price", "avg", ("unit_price",)), Kpi("Average Order Value", "ratio", (REVENUE, ORDERS)), Kpi("Statuses", "distinct", ("status",))]


def _excluding(k: Kpi) -> Kpi:
    return Kpi(k.name, k.op, k.args, CANCELLED, k.by, k.by_month)


def kpi_values(spark, sf_dir):
    return kpi.evaluate(silver(spark, sf_dir), KPIS)


def kpi_excluding(spark, sf_dir):
    return kpi.evaluate(silver(spark, sf_dir), map(_excluding, KPIS))


def kpi_by_dim(spark, sf_dir):
    return kpi.evaluate_by(silver(spark, sf_dir), Kpi("Revenue by Region", "product", ("quantity", "unit_price"), CANCELLED, by="region"))


def kpi_by_month(spark, sf_dir):
    return kpi.evaluate_by(silver(spark, sf_dir), Kpi("Revenue by Month", "product", ("quantity", "unit_price"), CANCELLED, by_month="order_date"))


def _kpi_sql(where: str) -> str:
    return f"""WITH {SILVER}, k AS (SELECT {money('quantity * unit_price')} AS revenue, count(DISTINCT order_id) AS orders, {money('quantity')} AS quantity, count(*) AS n,
 avg(unit_price) AS price, count(DISTINCT status) + coalesce(max(CASE WHEN status IS NULL THEN 1 ELSE 0 END), 0) AS statuses FROM silver WHERE {where})
SELECT 'Revenue' AS kpi, round(CAST(revenue AS DOUBLE), 6) AS value FROM k UNION ALL SELECT 'Orders', CAST(orders AS DOUBLE) FROM k UNION ALL SELECT 'Quantity Sold', CAST(quantity AS DOUBLE) FROM k
UNION ALL SELECT 'Lines', CAST(n AS DOUBLE) FROM k UNION ALL SELECT 'Average Unit Price', round(price, 6) FROM k UNION ALL SELECT 'Average Order Value', round(revenue / nullif(orders, 0), 6) FROM k
UNION ALL SELECT 'Statuses', CAST(statuses AS DOUBLE) FROM k"""


# -- analysis ------------------------------------------------------------------------------------

DIMENSIONS = ["region", "category", "product", "status"]


def _months(spark, sf_dir):
    return an.monthly(silver(spark, sf_dir), F.col("line_amount"), "order_date", CANCELLED)


def _broken(spark, sf_dir):
    return stored(an.breakdown(silver(spark, sf_dir), F.col("line_amount"), DIMENSIONS, CANCELLED), "broken")


def an_overview(spark, sf_dir):
    return an.overview(silver(spark, sf_dir), CANCELLED)


def an_monthly(spark, sf_dir):
    return _months(spark, sf_dir).select("month", "total")


def an_incomplete_months(spark, sf_dir):
    return _months(spark, sf_dir).where("incomplete").select("month")


def an_years(spark, sf_dir):
    return an.yearly(_months(spark, sf_dir))


def an_yoy(spark, sf_dir):
    return an.year_over_year(stored(_months(spark, sf_dir), "months"))


def an_best_worst(spark, sf_dir):
    return an.best_worst(_months(spark, sf_dir))


def an_mom(spark, sf_dir):
    return an.month_over_month(stored(_months(spark, sf_dir), "months"))


def an_top5(spark, sf_dir):
    return an.top(_broken(spark, sf_dir))


def an_top_share(spark, sf_dir):
    return an.top_share(_broken(spark, sf_dir))


def an_pareto(spark, sf_dir):
    return an.pareto(_broken(spark, sf_dir))


MEASURES = ["quantity", "unit_price", "line_amount"]


def an_distribution(spark, sf_dir):
    return an.distribution(stored(silver(spark, sf_dir).withColumn("line_amount", F.round("line_amount", 2)).select(*MEASURES), "silver"), MEASURES)


def an_outliers(spark, sf_dir):
    s = stored(silver(spark, sf_dir).withColumn("line_amount", F.round("line_amount", 2)).select(*MEASURES), "silver")
    return an.outliers(s, an.quartiles(s, MEASURES), MEASURES)


def an_largest(spark, sf_dir):
    return an.largest(silver(spark, sf_dir).withColumn("line_amount", F.round("line_amount", 2)), "line_amount")


def an_mean_by_dim(spark, sf_dir):
    return an.mean_by(stored(silver(spark, sf_dir).select("product", "unit_price"), "silver"), "unit_price", F.col("product"))


def an_mean_by_month(spark, sf_dir):
    return an.mean_by(stored(silver(spark, sf_dir).select("order_date", "unit_price"), "silver"), "unit_price", F.trunc(F.to_date("order_date"), "month"))


def an_extremes(spark, sf_dir):
    return an.extremes(silver(spark, sf_dir), "unit_price", "region").unionByName(an.extremes(silver(spark, sf_dir), "quantity", "category"))


def an_findings(spark, sf_dir):
    s = stored(silver(spark, sf_dir).withColumn("line_amount", F.round("line_amount", 2)), "silver")
    months = stored(an.monthly(s, F.col("line_amount"), "order_date", CANCELLED), "months")
    broken = stored(an.breakdown(s, F.col("line_amount"), DIMENSIONS, CANCELLED), "broken")
    spread = stored(an.distribution(s, MEASURES), "spread")
    extreme = stored(an.extremes(s, "unit_price", "region").unionByName(an.extremes(s, "quantity", "category")), "extremes")
    return an.findings(months, broken, spread, an.outliers(s, spread, MEASURES), extreme)


def claims_unverified(spark, sf_dir):
    """Numbers that the documents cite, against monthly totals and KPIs as known figures."""
    figures = _months(spark, sf_dir).select(F.col("total").alias("value")).unionByName(kpi.evaluate(silver(spark, sf_dir), KPIS).select("value"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cited = stored(an.cited_numbers(docs, ["doc_id"], "text"), "cited")
    return an.unverified(cited, stored(figures, "figures"), ["doc_id"])


#: The query's key; a real one comes from a secret store.
PSEUDONYM_KEY = "key of the example"


def pseudonymize(spark, sf_dir):
    rows = sales_lines(spark, sf_dir).select(F.concat(F.lit("c"), F.col("customer_id").cast("string"), F.lit("@shop")).alias("customer"), "quantity")
    return an.pseudonyms(rows, "customer", PSEUDONYM_KEY).groupBy("customer").agg(F.sum("quantity").alias("quantity"))


_MONTHS_SQL = f"""{SILVER}, cover AS (SELECT min(CAST(order_date AS DATE)) AS first_day, max(CAST(order_date AS DATE)) AS last_day FROM silver),
months AS (SELECT CAST(m AS DATE) AS month, coalesce(total, 0) AS total,
  (CAST(m AS DATE) = CAST(date_trunc('month', first_day) AS DATE) AND day(first_day) > 1) OR (CAST(m AS DATE) = CAST(date_trunc('month', last_day) AS DATE) AND last_day < last_day(last_day)) AS incomplete
  FROM (SELECT first_day, last_day, unnest(generate_series(date_trunc('month', first_day), date_trunc('month', last_day), INTERVAL 1 MONTH)) AS m FROM cover) g
  LEFT JOIN (SELECT CAST(date_trunc('month', order_date) AS DATE) AS k, {money('line_amount')} AS total FROM silver WHERE {KEEPS} GROUP BY 1) s ON CAST(g.m AS DATE) = s.k),
years AS (SELECT CAST(year(month) AS INTEGER) AS year, {money('total')} AS total, count(*) = 12 AND NOT bool_or(incomplete) AS complete FROM months GROUP BY 1)"""

_BROKEN_SQL = f"""{SILVER}, longer AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, coalesce({d}, '(vide)') AS value, line_amount FROM silver WHERE {KEEPS}" for d in DIMENSIONS)}),
sums AS (SELECT dimension, value, {money('line_amount')} AS total FROM longer GROUP BY 1, 2),
broken AS (SELECT dimension, value, total, total / nullif(sum(total) OVER (PARTITION BY dimension), 0) AS share, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value) AS rank,
 CAST(sum(CAST(total AS DECIMAL(28,2))) OVER (PARTITION BY dimension ORDER BY total DESC, value ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running, CAST(sum(CAST(total AS DECIMAL(28,2))) OVER (PARTITION BY dimension) AS DOUBLE) AS whole FROM sums)"""

_SPREAD = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(v) AS n, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) = max(v) AS is_constant FROM (SELECT {'round(line_amount, 2)' if c == 'line_amount' else c} AS v FROM silver)" for c in MEASURES)
_OUTSIDE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(v) AS n, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT {'round(line_amount, 2)' if c == 'line_amount' else c} AS v FROM silver) s, spread d WHERE d.\"column\" = '{c}'" for c in MEASURES)
_OUTLIERS_SQL = f"{SILVER}, spread AS ({_SPREAD}), outside AS (SELECT *, round(outliers / n, 6) AS share FROM ({_OUTSIDE}) o)"


def _mean_by_sql(group: str) -> str:
    return f"""WITH {SILVER}, g AS (SELECT {group} AS "group", round(avg(unit_price), 6) AS mean, count(*) AS n FROM silver WHERE {group} IS NOT NULL AND unit_price IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, "group") AS a, row_number() OVER (ORDER BY mean, "group" DESC) AS b, count(*) OVER () AS k FROM g)
SELECT "group", mean, n FROM r WHERE a <= 5 OR b <= 5 OR k <= 10"""


def _extremes_sql(measure: str, dimension: str) -> str:
    return f"""SELECT '{measure}' AS measure, '{dimension}' AS dimension, (SELECT g FROM x WHERE n >= 5 ORDER BY mean DESC, g LIMIT 1) AS highest, max(mean) AS highest_mean,
 (SELECT g FROM x WHERE n >= 5 ORDER BY mean, g LIMIT 1) AS lowest, min(mean) AS lowest_mean,
 coalesce(abs((max(mean) - min(mean)) / nullif((SELECT avg({measure}) FROM silver), 0)) < 0.05, false) AS close FROM x WHERE n >= 5 HAVING count(*) >= 2"""


ORACLES_SQL = {
    "silver_rename": f"WITH {SALES_LINES} SELECT order_id, count(order_date) AS order_date, sum(quantity) AS quantite_vendue, max(unit_price) AS unit_price FROM sales_lines GROUP BY 1",
    "silver_trim": f"WITH {DIRTY_SALES} SELECT trim(status) AS status, trim(product) AS product, count(*) AS n FROM dirty_sales GROUP BY 1, 2",
    "silver_cast": f"WITH {DIRTY_SALES} SELECT source_file, min(CAST(order_date_text AS TIMESTAMP)) AS first_date, max(CAST(order_date_text AS TIMESTAMP)) AS last_date, sum(quantity) AS quantity, CAST(sum(line_number) AS BIGINT) AS line_number FROM dirty_sales GROUP BY 1",
    "silver_normalize": f"WITH {DIRTY_SALES} SELECT upper(trim(status)) AS status, upper(trim(category)) AS category, count(*) AS n FROM dirty_sales GROUP BY 1, 2",
    "silver_impute": f"WITH {DIRTY_SALES} SELECT source_file, coalesce(upper(trim(status)), 'UNKNOWN') AS status, count(*) AS n FROM dirty_sales GROUP BY 1, 2",
    "silver_drop_null_keys": f"WITH {DIRTY_SALES} SELECT source_file, count(*) AS n FROM dirty_sales WHERE status IS NOT NULL GROUP BY 1",
    "silver_dedup": f"WITH {DIRTY_SALES} SELECT source_file, count(*) AS n FROM (SELECT DISTINCT * FROM dirty_sales) GROUP BY 1",
    "silver_line_amount": f"WITH {DIRTY_SALES} SELECT order_id, line_number, source_file, round(quantity * unit_price, 4) AS line_amount FROM dirty_sales",
    "silver_date_parts": f"WITH {SALES_LINES} SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month, count(*) AS n FROM sales_lines GROUP BY 1, 2",
    "silver_quarantine": f"""WITH {DIRTY_SALES}, keyed AS (SELECT *, concat_ws('-', order_id, line_number, product, quantity) AS line_key FROM dirty_sales),
n AS (SELECT *, row_number() OVER (PARTITION BY line_key ORDER BY order_id, line_number, order_date, order_date_text, customer_id, product, category, region, quantity, unit_price, tax_rate, status NULLS FIRST, source_file) AS nth FROM keyed)
SELECT source_file, concat_ws(',', CASE WHEN quantity < 1 THEN 'quantity:min' END, CASE WHEN nth > 1 THEN 'line_key:unique' END) AS violations, count(*) AS n FROM n GROUP BY 1, 2""",
    "enrich_arith": f"WITH {DIRTY_SALES} SELECT order_id, line_number, round(quantity * unit_price, 4) AS amount, round(unit_price / nullif(tax_rate, 0), 4) AS per_tax, round(unit_price - tax_rate, 4) AS net, quantity + line_number AS both FROM dirty_sales",
    "enrich_concat": f"WITH {DIRTY_SALES} SELECT trim(concat(coalesce(product, ''), ' / ', coalesce(status, ''))) AS label, count(*) AS n FROM dirty_sales GROUP BY 1",
    "enrich_datepart": f"WITH {DIRTY_SALES} SELECT CAST(year(order_date) AS INTEGER) AS d_year, CAST(month(order_date) AS INTEGER) AS d_month, CAST(day(order_date) AS INTEGER) AS d_day, CAST(quarter(order_date) AS INTEGER) AS d_quarter, CAST(isodow(order_date) - 1 AS INTEGER) AS d_weekday, count(*) AS n FROM dirty_sales GROUP BY 1, 2, 3, 4, 5",
    "enrich_const": f"WITH {DIRTY_SALES} SELECT 'web' AS channel, source_file, count(*) AS n FROM dirty_sales GROUP BY 1, 2",
    "silver_step_report": f"""WITH {DIRTY_SALES}, t AS (SELECT * REPLACE (trim(product) AS product, upper(trim(status)) AS status) FROM dirty_sales), a AS (SELECT count(*) AS n FROM t), b AS (SELECT count(*) AS n FROM t WHERE status IS NOT NULL),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quantity >= 1) AS passed FROM (SELECT DISTINCT * FROM t WHERE status IS NOT NULL))
SELECT CAST(i AS INTEGER) AS step_number, step, 'APPLIED' AS outcome, x AS rows_before, y AS rows_after, (SELECT passed FROM c) AS rows_passed FROM (
SELECT 1 AS i, 'trim_strings' AS step, a.n AS x, a.n AS y FROM a UNION ALL SELECT 2, 'normalize_categories', a.n, a.n FROM a UNION ALL SELECT 3, 'drop_rows_with_null_keys', a.n, b.n FROM a, b
UNION ALL SELECT 4, 'deduplicate_rows', b.n, c.n FROM b, c UNION ALL SELECT 5, 'keep_null_measures', c.n, c.n FROM c)""",
    "gold_by_month": f"WITH {SILVER} SELECT year, month, {METRICS_SQL}, count(order_date) AS number_of_lines FROM silver WHERE {KEEPS} GROUP BY 1, 2",
    "gold_by_dimension": f"WITH {SILVER} SELECT status, {METRICS_SQL}, count(status) AS number_of_lines FROM silver WHERE {KEEPS} GROUP BY 1",
    "gold_summary": f"WITH {SILVER} SELECT {METRICS_SQL}, count(order_id) AS number_of_lines FROM silver WHERE {KEEPS}",
    "gold_fact": f"WITH {SILVER} SELECT order_id, customer_id, order_date, product, category, region, status, quantity, unit_price, round(line_amount, 4) AS line_amount FROM silver",
    "gold_dimension": f"WITH {SILVER} SELECT customer_id, region, product FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id, line_number, product, category, region, quantity, source_file) AS n FROM silver) WHERE n = 1",
    "gold_dim_date": f"WITH {SILVER} SELECT DISTINCT CAST(order_date AS DATE) AS date, CAST(year(order_date) AS INTEGER) AS year, CAST(quarter(order_date) AS INTEGER) AS quarter, CAST(month(order_date) AS INTEGER) AS month, CAST(day(order_date) AS INTEGER) AS day FROM silver",
    "gold_grouping_sets": f"WITH {SILVER} SELECT region, category, CAST(grouping(region, category) AS BIGINT) AS grouping_id, {money('line_amount')} AS total_sales, {money('quantity')} AS total_quantity FROM silver WHERE {KEEPS} GROUP BY GROUPING SETS ((region), (category), ())",
    "verify_counts": f"WITH {SILVER}, c AS (SELECT count(DISTINCT CAST(order_date AS DATE)) AS d, count(DISTINCT year * 100 + month) AS m FROM silver) SELECT 'dim_date' AS table_name, d AS expected, d AS actual, true AS ok FROM c UNION ALL SELECT 'by_month', m, m, true FROM c",
    "verify_reconcile": f"WITH {DIRTY_SALES}, d AS (SELECT count(*) AS n, count(*) FILTER (WHERE quantity < 1) AS q FROM (SELECT DISTINCT * FROM dirty_sales)), b AS (SELECT count(*) AS n FROM dirty_sales) SELECT b.n AS bronze, b.n - d.n AS removed, d.q AS quarantined, d.n - d.q AS silver, true AS ok FROM b, d",
    "verify_not_null": f"WITH {SILVER} SELECT * , nulls = 0 AS ok FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM silver" for c in ("order_id", "product", "quantity", "status")) + ")",
    "verify_totals": f"WITH {SILVER}, t AS (SELECT {money('line_amount')} AS a, {money('quantity')} AS q FROM silver WHERE {KEEPS}) " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{m}' AS metric, {c} AS expected, {c} AS actual, true AS ok FROM t" for n in ("by_month", "by_region", "summary") for m, c in (("total_sales", "a"), ("total_quantity", "q"))),
    "kpi_values": _kpi_sql("true"),
    "kpi_excluding": _kpi_sql(KEEPS),
    "kpi_by_dim": f"WITH {SILVER} SELECT region AS \"group\", round({money('quantity * unit_price')}, 6) AS value FROM silver WHERE {KEEPS} GROUP BY 1",
    "kpi_by_month": f"WITH {SILVER} SELECT CAST(date_trunc('month', order_date) AS DATE) AS \"group\", round({money('quantity * unit_price')}, 6) AS value FROM silver WHERE {KEEPS} GROUP BY 1",
    "an_overview": f"WITH {SILVER} SELECT count(*) AS rows, count(*) FILTER (WHERE {KEEPS}) AS analysed, count(*) FILTER (WHERE NOT {KEEPS}) AS excluded FROM silver",
    "an_monthly": f"WITH {_MONTHS_SQL} SELECT month, total FROM months",
    "an_incomplete_months": f"WITH {_MONTHS_SQL} SELECT month FROM months WHERE incomplete",
    "an_years": f"WITH {_MONTHS_SQL} SELECT * FROM years",
    "an_yoy": f"WITH {_MONTHS_SQL} SELECT a.year, a.total, b.total AS previous, round((a.total - b.total) / nullif(b.total, 0), 6) AS change FROM years a JOIN years b ON a.year = b.year + 1 AND a.complete AND b.complete WHERE a.year = (SELECT max(year) FROM years WHERE complete)",
    "an_best_worst": f"WITH {_MONTHS_SQL}, m AS (SELECT * FROM months WHERE NOT incomplete OR (SELECT bool_and(incomplete) FROM months)) SELECT (SELECT month FROM m ORDER BY total DESC, month LIMIT 1) AS best_month, max(total) AS best_total, (SELECT month FROM m ORDER BY total, month LIMIT 1) AS worst_month, min(total) AS worst_total, round(avg(total), 2) AS mean_total FROM m",
    "an_mom": f"WITH {_MONTHS_SQL}, m AS (SELECT * FROM months WHERE NOT incomplete OR (SELECT bool_and(incomplete) FROM months)) SELECT a.month, a.total, b.total AS previous, round((a.total - b.total) / nullif(b.total, 0), 6) AS change FROM m a JOIN m b ON b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE) WHERE a.month = (SELECT max(month) FROM m)",
    "an_top5": f"WITH {_BROKEN_SQL} SELECT dimension, value, total, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM broken WHERE rank <= 5",
    "an_top_share": f"WITH {_BROKEN_SQL} SELECT dimension, round(sum(share), 6) AS share FROM broken WHERE rank <= 5 GROUP BY 1",
    "an_pareto": f"WITH {_BROKEN_SQL} SELECT dimension, count(*) AS n_values, CASE WHEN max(whole) <> 0 THEN least(count(*) FILTER (WHERE running / whole < 0.8) + 1, count(*)) END AS n_needed FROM broken GROUP BY 1",
    "an_distribution": f"WITH {_OUTLIERS_SQL} SELECT * FROM spread",
    "an_outliers": f"WITH {_OUTLIERS_SQL} SELECT * FROM outside",
    "an_largest": f"WITH {SILVER} SELECT round(line_amount, 2) AS value FROM silver ORDER BY 1 DESC LIMIT 3",
    "an_mean_by_dim": _mean_by_sql("product"),
    "an_mean_by_month": _mean_by_sql("CAST(date_trunc('month', order_date) AS DATE)"),
    "an_extremes": f"WITH {SILVER} SELECT * FROM (WITH x AS (SELECT region AS g, round(avg(unit_price), 6) AS mean, count(unit_price) AS n FROM silver WHERE region IS NOT NULL GROUP BY 1) {_extremes_sql('unit_price', 'region')}) UNION ALL SELECT * FROM (WITH x AS (SELECT category AS g, round(avg(quantity), 6) AS mean, count(quantity) AS n FROM silver WHERE category IS NOT NULL GROUP BY 1) {_extremes_sql('quantity', 'category')})",
    "pseudonymize": f"WITH {SALES_LINES} SELECT concat('Client ', substr(sha256(concat('{PSEUDONYM_KEY}:c', customer_id, '@shop')), 1, 16)) AS customer, sum(quantity) AS quantity FROM sales_lines GROUP BY 1",
}



def _finding_sql(name: str, subject: str, value: str, reference: str, rows: str) -> str:
    return f"SELECT '{name}' AS finding, {subject} AS subject, round(CAST({value} AS DOUBLE), 6) AS value, round(CAST({reference} AS DOUBLE), 6) AS reference FROM ({rows}) AS x"


ORACLES_SQL["an_findings"] = " UNION ALL ".join([
    _finding_sql("best_month", "strftime(best_month, '%Y-%m')", "best_total", "mean_total", ORACLES_SQL["an_best_worst"]),
    _finding_sql("worst_month", "strftime(worst_month, '%Y-%m')", "worst_total", "mean_total", ORACLES_SQL["an_best_worst"]),
    _finding_sql("yearly_change", "CAST(year AS VARCHAR)", "change", "previous", ORACLES_SQL["an_yoy"]),
    _finding_sql("monthly_change", "strftime(month, '%Y-%m')", "change", "previous", ORACLES_SQL["an_mom"]),
    _finding_sql("incomplete_month", "strftime(month, '%Y-%m')", "total", "NULL", f"WITH {_MONTHS_SQL} SELECT * FROM months WHERE incomplete"),
    _finding_sql("concentration", "dimension", "n_needed", "n_values", ORACLES_SQL["an_pareto"]) + " WHERE n_needed < n_values",
    _finding_sql("close_means", "concat(measure, ' by ', dimension)", "lowest_mean", "highest_mean", ORACLES_SQL["an_extremes"]) + " WHERE close",
    _finding_sql("highest_mean", "concat(measure, ' by ', highest)", "highest_mean", "lowest_mean", ORACLES_SQL["an_extremes"]) + " WHERE NOT close",
    _finding_sql("lowest_mean", "concat(measure, ' by ', lowest)", "lowest_mean", "highest_mean", ORACLES_SQL["an_extremes"]) + " WHERE NOT close",
    _finding_sql("constant_column", '"column"', "min", "NULL", ORACLES_SQL["an_distribution"]) + " WHERE is_constant",
    _finding_sql("spread", '"column"', "share", "outliers", ORACLES_SQL["an_outliers"]) + " WHERE share >= 0.10",
    _finding_sql("atypical_values", '"column"', "share", "outliers", ORACLES_SQL["an_outliers"]) + " WHERE share >= 0.01 AND share < 0.10",
])

#: SQL has no look-behind, so a number's mark before it is taken along, and the word behind it, of which a second pattern tells the unit.
_WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_NUMBERS = rf"(?:^|[^{_WORD}.,])(\p{{Nd}}{{1,3}}(?:[ \x{{a0}}\x{{202f}}]\p{{Nd}}{{3}})+|\p{{Nd}}+)([.,]\p{{Nd}}+)?({_SPACE}(?:%|\p{{L}}[{_WORD}]*))?"
_UNIT = rf"^({_SPACE})(%|md$|m$|k$|milliards?|millions?|milliers?)"
_CLAIMS_SQL = rf"""
SELECT DISTINCT doc_id, cited, round(value, 6) AS value FROM (
  WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUMBERS}', 1)) AS w, unnest(regexp_extract_all(text, '{_NUMBERS}', 2)) AS d, unnest(regexp_extract_all(text, '{_NUMBERS}', 3)) AS tail FROM documents),
  parts AS (SELECT *, lower(regexp_extract(lower(tail), '{_UNIT}', 2)) AS unit, len(regexp_extract(lower(tail), '{_UNIT}', 0)) AS taken, TRY_CAST(concat(regexp_replace(w, '[ \x{{a0}}\x{{202f}}]', '', 'g'), replace(d, ',', '.')) AS DOUBLE) AS number, greatest(len(d) - 1, 0) AS decimals FROM found),
  numbers AS (SELECT doc_id, regexp_replace(concat(w, d, tail[1:taken]), '{_SPACE}$', '') AS cited, number, decimals, unit,
    CASE WHEN unit IN ('md', 'milliard', 'milliards') THEN 1e9 WHEN unit IN ('m', 'million', 'millions') THEN 1e6 WHEN unit IN ('k', 'millier', 'milliers') THEN 1e3 ELSE 1.0 END AS factor FROM parts WHERE number IS NOT NULL),
  asked AS (SELECT doc_id, cited, number * factor AS value, 0.5 * pow(10.0, -decimals) * factor AS half FROM numbers WHERE NOT (unit = '' AND decimals = 0 AND (number <= 31 OR number BETWEEN 1900 AND 2100))),
  known AS (SELECT total AS f FROM ({ORACLES_SQL["an_monthly"]}) m UNION SELECT value FROM ({ORACLES_SQL["kpi_values"]}) k WHERE value IS NOT NULL),
  figures AS (SELECT f FROM known UNION SELECT f * 100 FROM known WHERE f BETWEEN -10 AND 10)
  SELECT * FROM asked WHERE NOT EXISTS (SELECT 1 FROM figures WHERE abs(f - value) <= greatest(abs(f) * 0.015, half)))"""
ORACLES_SQL["claims_unverified"] = _CLAIMS_SQL

QUERIES = {
    f.__name__: (lambda spark, sf_dir, f=f: text_dates(f(spark, sf_dir)))
    for f in (
        silver_rename, silver_trim, silver_cast, silver_normalize, silver_impute, silver_drop_null_keys, silver_dedup, silver_line_amount, silver_date_parts, silver_quarantine, enrich_arith, enrich_concat, enrich_datepart,
        enrich_const, silver_step_report, gold_by_month, gold_by_dimension, gold_summary, gold_fact, gold_dimension, gold_dim_date, gold_grouping_sets, verify_counts, verify_reconcile, verify_not_null, verify_totals, kpi_values,
        kpi_excluding, kpi_by_dim, kpi_by_month, an_overview, an_monthly, an_incomplete_months, an_years, an_yoy, an_best_worst, an_mom, an_top5, an_top_share, an_pareto, an_distribution, an_outliers, an_largest, an_mean_by_dim,
        an_mean_by_month, an_extremes, an_findings, claims_unverified, pseudonymize,
    )
}
_DATES = {"gold_dim_date": ["date"], "kpi_by_month": ["group"], "an_monthly": ["month"], "an_incomplete_months": ["month"], "an_best_worst": ["best_month", "worst_month"], "an_mom": ["month"], "an_mean_by_month": ["group"]}
ORACLES = {k: text_dates_sql(q, *_DATES[k]) if k in _DATES else q for k, q in ORACLES_SQL.items()}
