"""Views on the given tables that have the shape of sales files, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task joins, about, and parts that Spark may send to all tasks.
ROWS_A_TASK, PARTS_SENT = 250_000, 1_000_000


def _dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Dealt by a key to a task for each ROWS_A_TASK rows, where that is more tasks than Spark's setting gives."""
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line, with customer, product, region and status. Equi-joins only; Spark broadcasts sides that are small.

    More lines are dealt to more tasks, last by order: the rows of an order are in one task, which makes them distinct or groups them
    as it joins them, without another shuffle. Counts of the files' footers tell how many tasks are needed."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = t("customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders, lines, parts = t("orders"), t("lineitem"), t("part")
    n_orders, n_lines = orders.count(), lines.count()
    orders = _dealt(orders, n_orders, "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if parts.count() > PARTS_SENT:
        lines = _dealt(lines, n_lines, "l_partkey")
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = _dealt(lines, n_lines, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "O", "SHIPPED").otherwise("cancelled")
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("l_tax").alias("tax_rate"),
        status.alias("status"),
    )


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales_lines as four files with one defect each: repeated rows, null statuses, blank products, negative quantities."""
    s = sales_lines(spark, sf_dir)
    k, part = F.col("order_id") * 7 + F.col("line_number"), F.col("order_id") % 4
    base = s.select(
        "order_id",
        "line_number",
        "order_date",
        F.col("order_date").cast("date").cast("string").alias("order_date_text"),
        "customer_id",
        F.when((part == 2) & (k % 13 == 0), "").otherwise(F.col("product")).alias("product"),
        "category",
        "region",
        F.when((part == 3) & (k % 17 == 0), -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"),
        "unit_price",
        "tax_rate",
        F.when((part == 1) & (k % 11 == 0), F.lit(None)).when(k % 5 == 0, F.concat(F.lit(" "), "status", F.lit(" "))).otherwise(F.col("status")).alias("status"),
        F.concat(F.lit("part_"), part.cast("string")).alias("source_file"),
    )
    twice = (F.col("source_file") == "part_0") & ((F.col("order_id") * 7 + F.col("line_number")) % 19 == 0)
    return base.withColumn("_nth", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_nth")


def text_dates(df: DataFrame) -> DataFrame:
    """Dates as text, so that results compare alike in every engine."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def text_dates_sql(sql: str, *columns: str) -> str:
    return "SELECT * REPLACE (" + ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns) + f") FROM ({sql}) t"


SALES_LINES = """sales_lines AS (
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number, o.o_orderdate AS order_date,
       o.o_custkey AS customer_id, p.p_name AS product, p.p_type AS category, r.r_name AS region,
       l.l_quantity AS quantity, p.p_retailprice AS unit_price, l.l_tax AS tax_rate,
       CASE o.o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'SHIPPED' ELSE 'cancelled' END AS status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey)"""

DIRTY_SALES = f"""{SALES_LINES}, dirty_base AS (
SELECT order_id, line_number, order_date, CAST(CAST(order_date AS DATE) AS VARCHAR) AS order_date_text, customer_id,
       CASE WHEN part = 2 AND k % 13 = 0 THEN '' ELSE product END AS product, category, region,
       CASE WHEN part = 3 AND k % 17 = 0 THEN -quantity ELSE quantity END AS quantity, unit_price, tax_rate,
       CASE WHEN part = 1 AND k % 11 = 0 THEN NULL WHEN k % 5 = 0 THEN concat(' ', status, ' ') ELSE status END AS status,
       concat('part_', part) AS source_file
FROM (SELECT s.*, order_id * 7 + line_number AS k, order_id % 4 AS part FROM sales_lines s) t), dirty_sales AS (
SELECT * FROM dirty_base
UNION ALL
SELECT * FROM dirty_base WHERE source_file = 'part_0' AND (order_id * 7 + line_number) % 19 = 0)"""

#: The cleaned rows that Gold, KPI and analysis queries start from.
SILVER = f"""{DIRTY_SALES}, silver AS (
SELECT DISTINCT order_id, line_number, order_date, order_date_text, customer_id, product, category, region, quantity, unit_price,
       tax_rate, upper(trim(status)) AS status, source_file, quantity * unit_price AS line_amount,
       CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month
FROM dirty_sales WHERE quantity >= 1 AND unit_price >= 0)"""

COLUMNS = ["order_id", "line_number", "order_date", "order_date_text", "customer_id", "product", "category", "region", "quantity", "unit_price", "tax_rate", "status", "source_file"]

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def column_facts_sql(name: str, source: str, columns: list[str]) -> str:
    """What the rows say of each column."""
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, '{c}' AS "column", {i} AS place, any_value(typeof({c})) AS dtype, count(*) AS n, count({c}) AS known, count(DISTINCT {c}) AS d, bool_and(TRY_CAST({c} AS DOUBLE) % 1 = 0) AS whole,
 min(TRY_CAST({c} AS DOUBLE)) AS low, max(TRY_CAST({c} AS DOUBLE)) AS high, count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '^\\s*[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) AS dates,
 coalesce(bool_or(date_trunc('day', TRY_CAST({c} AS TIMESTAMP)) <> TRY_CAST({c} AS TIMESTAMP)), false) AS timed, coalesce(bool_or(contains(trim(CAST({c} AS VARCHAR)), ' ')), false) AS blank FROM {source}"""
        for i, c in enumerate(columns)
    )


#: The inferred kind of each column of `told`, rows of `column_facts_sql`.
TYPED_SQL = """typed AS (SELECT *, string_split(lower("column"), '_') AS words, CASE WHEN known = 0 THEN 'empty' WHEN dtype LIKE 'TIMESTAMP%' OR dtype = 'DATE' THEN 'datetime' WHEN dtype LIKE '%INT' OR dtype = 'INTEGER' THEN 'integer' WHEN dtype = 'BOOLEAN' THEN 'boolean'
  WHEN dtype = 'VARCHAR' THEN CASE WHEN dates >= 0.9 * known THEN 'datetime' ELSE 'string' END WHEN whole THEN 'integer' ELSE 'decimal' END AS kind, known = n AND d = n AND n > 0 AS is_unique FROM told)"""

#: Rules for dirty_sales: status may be null, quantity is 1 at least, unit_price 0 at least.
CONTRACT = {
    "order_id": {"type": "integer", "nullable": False},
    "line_number": {"type": "integer", "nullable": False},
    "order_date": {"type": "datetime", "nullable": False},
    "order_date_text": {"type": "datetime", "nullable": False},
    "customer_id": {"type": "integer", "nullable": False},
    "product": {"type": "string", "nullable": False},
    "category": {"type": "string", "nullable": False},
    "region": {"type": "string", "nullable": False},
    "quantity": {"type": "decimal", "nullable": False, "min": 1},
    "unit_price": {"type": "decimal", "nullable": False, "min": 0},
    "tax_rate": {"type": "decimal", "nullable": False, "min": 0, "max": 1},
    "status": {"type": "string", "nullable": True},
}

#: Audit records made from events: ten events are a run, each event a step.
AUDIT_RUNS = """audit_runs AS (
SELECT concat('run_', g) AS run_id, concat('file_', g % 7) AS source_file,
       CASE g % 5 WHEN 0 THEN 'QUARANTINE' WHEN 1 THEN 'REJECT' WHEN 2 THEN NULL ELSE 'INGEST' END AS decision,
       CASE g % 6 WHEN 0 THEN 'ASSESS_ONLY' WHEN 1 THEN 'LEGACY' ELSE 'INGEST' END AS execution_mode,
       CASE WHEN errors > 3 THEN 'FAILED' WHEN g % 5 = 1 THEN 'REJECTED' ELSE 'SUCCESS' END AS final_status,
       started_at, CASE WHEN g % 9 = 0 THEN NULL ELSE total END AS duration_seconds
FROM (SELECT event_id // 10 AS g, min(ts) AS started_at, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
             count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) t)"""

AUDIT_STEPS = """audit_steps AS (
SELECT concat('run_', event_id // 10) AS run_id, event_id % 10 + 1 AS step_order, event_type AS step_name,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       ts AS started_at, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS duration_seconds
FROM events)"""


def audit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.floor(F.col("event_id") / 10)
    runs = table(spark, sf_dir, "events").groupBy(g.alias("g")).agg(
        F.min("ts").alias("started_at"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    g = F.col("g")
    return runs.select(
        F.concat(F.lit("run_"), g.cast("string")).alias("run_id"),
        F.concat(F.lit("file_"), (g % 7).cast("string")).alias("source_file"),
        F.when(g % 5 == 0, "QUARANTINE").when(g % 5 == 1, "REJECT").when(g % 5 == 2, F.lit(None)).otherwise("INGEST").alias("decision"),
        F.when(g % 6 == 0, "ASSESS_ONLY").when(g % 6 == 1, "LEGACY").otherwise("INGEST").alias("execution_mode"),
        F.when(F.col("errors") > 3, "FAILED").when(g % 5 == 1, "REJECTED").otherwise("SUCCESS").alias("final_status"),
        "started_at",
        F.when(g % 9 == 0, F.lit(None)).otherwise(F.col("total")).alias("duration_seconds"),
    )


def audit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), F.floor(i / 10).cast("string")).alias("run_id"),
        (i % 10 + 1).alias("step_order"),
        F.col("event_type").alias("step_name"),
        F.when(i % 13 == 0, F.lit(None)).when((F.col("event_type") == "error") & (i % 2 == 0), "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("ts").alias("started_at"),
        F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("value")).alias("duration_seconds"),
    )
