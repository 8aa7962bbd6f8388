"""Queries of dashboard tables over the cleaned sales rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import dashboard

from .sales import CANCELLED, KEEPS, money, silver
from .views import SILVER, text_dates, text_dates_sql

FILTER_COLUMNS = ["product", "region", "status", "category", "source_file", "order_date_text", "line_number"]
DETAIL = ["order_id", "line_number", "customer_id", "order_date", "product", "category", "region", "status", "quantity", "unit_price"]


def viz_month_split(spark, sf_dir):
    return dashboard.month_split(silver(spark, sf_dir), F.col("line_amount"), "order_date", "status", CANCELLED)


def viz_matrix(spark, sf_dir):
    return dashboard.matrix(silver(spark, sf_dir), F.col("line_amount"), "region", "category", CANCELLED)


def viz_scatter_bins(spark, sf_dir):
    return dashboard.scatter_bins(silver(spark, sf_dir), "quantity", "unit_price")


def viz_filters(spark, sf_dir):
    return dashboard.filters(silver(spark, sf_dir), "order_date", FILTER_COLUMNS)


def viz_detail(spark, sf_dir):
    return dashboard.detail(silver(spark, sf_dir), DETAIL[:3], DETAIL[3:4], DETAIL[4:8], [*DETAIL[8:], "line_amount"])


_BIN = "CAST(least(coalesce(floor(({c} - min({c}) OVER ()) * 20 / nullif(max({c}) OVER () - min({c}) OVER (), 0)), 0), 19) AS INTEGER)"
_LISTS = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM silver WHERE {c} IS NOT NULL GROUP BY ALL" for i, c in enumerate(FILTER_COLUMNS))

ORACLES = {
    "viz_month_split": text_dates_sql(f"WITH {SILVER} SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, status AS split, {money('line_amount')} AS total FROM silver WHERE {KEEPS} AND (SELECT count(DISTINCT status) FROM silver) <= 5 GROUP BY 1, 2", "month"),
    "viz_matrix": f"WITH {SILVER} SELECT region AS row, category AS \"column\", {money('line_amount')} AS total FROM silver WHERE {KEEPS} GROUP BY 1, 2",
    "viz_scatter_bins": f"WITH {SILVER} SELECT x_bin, y_bin, count(*) AS n FROM (SELECT {_BIN.format(c='quantity')} AS x_bin, {_BIN.format(c='unit_price')} AS y_bin FROM silver WHERE quantity IS NOT NULL AND unit_price IS NOT NULL) GROUP BY 1, 2",
    "viz_filters": f"""WITH {SILVER}, lists AS ({_LISTS}), few AS (SELECT place, "column", count(*) AS n_values, string_agg(v, '|' ORDER BY v) AS options FROM lists GROUP BY 1, 2 HAVING count(*) <= 50)
SELECT 'order_date' AS "column", 'date_range' AS type, CAST(min(CAST(order_date AS DATE)) AS VARCHAR) AS low, CAST(max(CAST(order_date AS DATE)) AS VARCHAR) AS high, CAST(NULL AS BIGINT) AS n_values, CAST(NULL AS VARCHAR) AS options FROM silver
UNION ALL SELECT "column", 'list', NULL, NULL, n_values, options FROM (SELECT * FROM few ORDER BY place LIMIT 4)""",
    "viz_detail": f"WITH {SILVER} SELECT {', '.join(DETAIL)} FROM silver",
}
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: text_dates(f(spark, sf_dir))) for f in (viz_month_split, viz_matrix, viz_scatter_bins, viz_filters, viz_detail)}
