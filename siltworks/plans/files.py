"""Queries of the readers: the sales view is written as landing files, and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators import profile as pf
from siltworks.sources import files as fl
from siltworks.sources.work import fresh_path, remove, stored

from .views import COLUMNS, DIRTY_SALES, dirty_sales

KINDS = {"order_id": "integer", "line_number": "integer", "order_date": "datetime", "order_date_text": "datetime", "customer_id": "integer", "quantity": "decimal", "unit_price": "decimal", "tax_rate": "decimal"}


def _as_text(df):
    """Columns as a file would hold them."""
    return df.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))


def _summary(df):
    return df.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count("product").alias("products"), F.count("status").alias("statuses"), F.sum("quantity").alias("quantity"), F.sum("order_id").alias("order_ids"), F.count_distinct("order_date").alias("days")
    )


def _landed(df, form, **options):
    """The folder of a frame written as text files, compressed: as they are, they would take many times the table's disk. A task
    reads such a file whole, so none holds more than FILE_ROWS rows."""
    path = fresh_path(df.sparkSession, "landing")
    df.write.format(form).options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_ROWS}, **options).save(path)
    return path


def _csv(spark, sf_dir, sep=",", header=True):
    path = fresh_path(spark, "landing")
    _as_text(dirty_sales(spark, sf_dir)).write.option("header", header).option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def scan_csv(spark, sf_dir):
    return _summary(fl.read_delimited(spark, _csv(spark, sf_dir, ";"), ";", kinds=KINDS))


def scan_json(spark, sf_dir):
    """One document for each order: an object whose `data` array holds its lines, with the customer nested."""
    path = fresh_path(spark, "landing")
    line = F.struct("source_file", "product", "status", "quantity", "order_date", F.struct(F.col("customer_id").alias("id"), F.struct("region").alias("home")).alias("customer"))
    _as_text(dirty_sales(spark, sf_dir)).groupBy("order_id").agg(F.collect_list(line).alias("data")).select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    read = fl.read_json(spark, path, multi_line=False)
    return read.groupBy(F.col("`customer.home.region`").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.count_distinct("`customer.id`").alias("customers"))


def scan_jsonl(spark, sf_dir):
    path = _landed(_as_text(dirty_sales(spark, sf_dir)), "json")
    out = stored(_summary(fl.read_json_lines(spark, path)), "summary")
    remove(spark, path)
    return out


def scan_parquet(spark, sf_dir):
    return _summary(stored(dirty_sales(spark, sf_dir), "landing"))


def combine_batch(spark, sf_dir):
    """Each file's rows written apart, one without its status, and combined."""
    df = stored(dirty_sales(spark, sf_dir), "landing")
    parts = [df.where(F.col("source_file") == f"part_{i}") for i in range(4)]
    return _summary(fl.combine([parts[0], parts[1], parts[2].drop("status"), parts[3]]))


def name_headerless(spark, sf_dir):
    """A file without header named by the only contract of its structure, found from the file's own profile."""
    path = _csv(spark, sf_dir, ",", header=False)
    raw = fl.read_delimited(spark, path, header=False)
    as_numbers = raw.select(*[F.when(F.col(c).rlike(r"^[+-]?\d+(\.\d+)?$"), F.col(c).try_cast("double")).alias(c) if i in (0, 1, 4, 8, 9, 10) else F.col(c) for i, c in enumerate(raw.columns)])
    kinds = [r.inferred_type for r in pf.facts(as_numbers).orderBy("position").select("inferred_type").collect()]
    sales = {c: "decimal" if c in ("quantity", "unit_price", "tax_rate") else KINDS.get(c, "string") for c in COLUMNS}
    named = fl.name_columns(raw, contracts={"sales": sales, "other": {"a": "string", "b": "string"}}, kinds=kinds)
    return _summary(fl.typed(named, KINDS))


#: Rows of a landing file, about, and files of a kind that lie in the folder at once.
FILE_ROWS, FILES_AT_ONCE = 100_000, 64
_CSV = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: kind -> (format, options, files at least).
WRITTEN = {
    "semicolon": ("csv", {"header": True, "sep": ";", **_CSV}, 2),
    "tab": ("csv", {"header": True, "sep": "\t", **_CSV}, 2),
    "headerless": ("csv", {"header": False, "sep": ",", **_CSV}, 1),
    "json": ("json", {}, 1),
    "parquet": ("parquet", {}, 2),
}


def _dealt(df, files):
    """The folder of a frame whose rows are dealt evenly to numbered files. A file is one row group, so one task reads all of it."""
    path = fresh_path(df.sparkSession, "dealt")
    nth = F.monotonically_increasing_id()
    turn = F.shiftrightunsigned(nth, 33) + nth.bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.withColumn("file", (turn % files).cast("int")).withColumn("slice", F.floor(F.col("file") / FILES_AT_ONCE).cast("int"))
    rows.repartition(files, "file").write.partitionBy("slice", "file").option("parquet.block.size", 1 << 30).parquet(path)
    return path


def _landing(spark, sf_dir, kinds=(*WRITTEN, "empty")):
    """Heads of a folder of the table's files in several formats, each with all rows. Rows are dealt evenly to as many files as the
    table needs, so no file grows with the table, and none is left with a row or two. FILES_AT_ONCE files are written, their heads
    kept, and the files removed before the next ones are: at any time the disk holds the rows once and some files."""
    df = stored(_as_text(dirty_sales(spark, sf_dir)), "landing")
    total = df.count()
    needed = -(-total // FILE_ROWS)
    schema = T.StructType([*df.schema, T.StructField("file", T.IntegerType())])
    kept = fresh_path(spark, "heads")
    dealt = {}

    def take(write):
        path = fresh_path(spark, "landing")
        write(path)
        fl.heads(spark, path).where("path RLIKE 'part-[^/]*$'").write.mode("append").parquet(kept)
        remove(spark, path)

    for kind in kinds:
        if kind == "empty":
            take(lambda path: spark.range(0).selectExpr("'' AS line").coalesce(1).write.text(f"{path}/kind=empty"))
            continue
        form, options, least = WRITTEN[kind]
        files = max(least, needed)
        if files not in dealt:
            dealt[files] = _dealt(df, files)
        for i in range(-(-files // FILES_AT_ONCE)):
            rows = spark.read.schema(schema).parquet(f"{dealt[files]}/slice={i}" if total else dealt[files])
            to = rows.write.partitionBy("file") if total else rows.drop("file").write
            take(lambda path: to.format(form).options(**options).save(f"{path}/kind={kind}"))
    for path in dealt.values():
        remove(spark, path)
    return spark.read.parquet(kept).withColumn("kind", F.regexp_extract("path", "kind=([a-z]+)", 1))


def classify_files(spark, sf_dir):
    files = _landing(spark, sf_dir)
    rows = fl.classify(files).withColumn("kind", F.regexp_extract("path", "kind=([a-z]+)", 1))
    return rows.groupBy("kind", "format", "detected_by", "delimiter", "error").agg(F.count(F.lit(1)).alias("files"))


def sniff_delimiter(spark, sf_dir):
    files = _landing(spark, sf_dir, ("semicolon", "tab", "headerless")).where("kind IN ('semicolon', 'tab', 'headerless')")
    return files.select("kind", fl.delimiter(F.make_valid_utf8(F.col("head").cast("string"))).alias("delimiter")).distinct()


def detect_header(spark, sf_dir):
    files = _landing(spark, sf_dir, ("semicolon", "tab", "headerless")).where("kind IN ('semicolon', 'tab', 'headerless')")
    return fl.detect_header(files).select(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"), "has_header").distinct()


def group_files(spark, sf_dir):
    files = _landing(spark, sf_dir, ("semicolon", "tab")).where("kind IN ('semicolon', 'tab')")
    return fl.group_by_columns(files).select(F.array_join("columns", ",").alias("columns"), F.size("paths").alias("files"))


def read_archives(spark, sf_dir):
    """Each source file's lines zipped in parts, and read back line by line."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0).to_pylist()
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("sales.csv", "".join(f"{x}\n" for x in lines))
                z.writestr(".hidden.csv", "no\n")
                z.writestr("deep/inside.csv", "no\n")
            yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary())], names=["content"])

    lines = _as_text(dirty_sales(spark, sf_dir)).select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS]).alias("line"))
    blobs = stored(lines.mapInArrow(pack, "content binary"), "zipped")
    return fl.unzipped(blobs.withColumn("path", F.lit("sales.zip"))).groupBy("member", F.element_at(F.split("line", ","), -1).alias("source_file")).agg(F.count(F.lit(1)).alias("n"))


_SUMMARY = "SELECT source_file, count(*) AS n, count({product}) AS products, count({status}) AS statuses, sum(quantity) AS quantity, CAST(sum(order_id) AS BIGINT) AS order_ids, count(DISTINCT order_date) AS days FROM dirty_sales GROUP BY 1"
_PLAIN = f"WITH {DIRTY_SALES} " + _SUMMARY.format(product="product", status="status")
_FOLDED = f"WITH {DIRTY_SALES} " + _SUMMARY.format(product="nullif(product, '')", status="status")

_CELLS = [f"coalesce(CAST({c} AS VARCHAR), '')" for c in COLUMNS]
_CELL_KIND = "CASE WHEN TRY_CAST({0} AS DOUBLE) IS NOT NULL THEN 'number' WHEN TRY_CAST({0} AS TIMESTAMP) IS NOT NULL THEN 'date' ELSE 'text' END"

#: Each kind's files hold every row as a line. What is told from a file's head is derived here from all of the table's rows and names.
_LINES = f"""WITH {DIRTY_SALES}, written(kind, mark, header) AS (VALUES ('semicolon', ';', true), ('tab', chr(9), true), ('headerless', ',', false)),
names AS (SELECT column_name AS name, row_number() OVER () AS p FROM (DESCRIBE FROM dirty_sales)),
lines AS (SELECT kind, concat_ws(mark, {", ".join(_CELLS)}) AS line FROM dirty_sales, written
  UNION ALL SELECT kind, replace((SELECT string_agg(name, ',' ORDER BY p) FROM names), ',', mark) FROM written WHERE header),
candidates(d, p) AS (VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)),
fits AS (SELECT kind, d, p, min(n) AS n FROM (SELECT kind, d, p, length(line) - length(replace(line, d, '')) AS n FROM lines, candidates) GROUP BY 1, 2, 3 HAVING min(n) = max(n) AND min(n) > 0),
delimiters AS (SELECT kind, coalesce(arg_max(d, n * 10 - p), ',') AS delimiter FROM written LEFT JOIN fits USING (kind) GROUP BY 1)"""

_HEADERS = f"""{_LINES}, body AS (SELECT p, min(k) AS low, max(k) AS high FROM (SELECT p, {_CELL_KIND.format("cell")} AS k FROM (SELECT unnest([{", ".join(_CELLS)}]) AS cell, unnest(range(1, {len(COLUMNS) + 1})) AS p FROM dirty_sales)) GROUP BY 1),
firsts AS (SELECT kind, p, low, high, CASE WHEN header THEN {_CELL_KIND.format("name")} ELSE low END AS first FROM written, body JOIN names USING (p))
SELECT kind, NOT coalesce(bool_and(first = low) FILTER (WHERE low = high AND low <> 'text'), false) AS has_header FROM firsts GROUP BY 1"""

_FILES = f"""{_LINES}, needed AS (SELECT CAST(ceil(count(*) / {FILE_ROWS}.0) AS BIGINT) AS n FROM dirty_sales),
kinds(kind, extension, first_bytes, least_files) AS (VALUES ('semicolon', 'csv', NULL, 2), ('tab', 'csv', NULL, 2), ('headerless', 'csv', NULL, 1), ('json', 'json', NULL, 1), ('parquet', 'parquet', 'PAR1', 2)),
files AS (SELECT kind, extension, first_bytes, greatest(least_files, n) AS files FROM kinds, needed UNION ALL SELECT 'empty', 'txt', NULL, 1)"""

ORACLES = {
    "classify_files": _FILES + " SELECT kind, CASE WHEN first_bytes = 'PAR1' THEN 'parquet' WHEN extension = 'txt' THEN 'csv' ELSE extension END AS format, CASE WHEN first_bytes IS NOT NULL THEN 'signature' ELSE 'extension' END AS detected_by, CASE WHEN extension IN ('csv', 'txt') THEN coalesce(delimiter, ',') END AS delimiter, CASE WHEN kind = 'empty' THEN 'EMPTY_FILE' END AS error, files FROM files LEFT JOIN delimiters USING (kind)",
    "group_files": _FILES + " SELECT (SELECT string_agg(name, ',' ORDER BY name) FROM names) AS columns, CAST(sum(files) AS INTEGER) AS files FROM files JOIN written USING (kind) WHERE header",
    "scan_csv": _FOLDED,
    "scan_json": f"WITH {DIRTY_SALES} SELECT region, count(*) AS n, sum(quantity) AS quantity, count(DISTINCT customer_id) AS customers FROM dirty_sales GROUP BY 1",
    "scan_jsonl": _PLAIN,
    "scan_parquet": _PLAIN,
    "combine_batch": f"WITH {DIRTY_SALES} " + _SUMMARY.format(product="product", status="CASE WHEN source_file <> 'part_2' THEN status END"),
    "name_headerless": _FOLDED,
    "sniff_delimiter": _LINES + " SELECT kind, delimiter FROM delimiters",
    "detect_header": _HEADERS,
    "read_archives": f"WITH {DIRTY_SALES} SELECT 'sales.csv' AS member, source_file, count(*) AS n FROM dirty_sales GROUP BY 2",
}

QUERIES = {f.__name__: f for f in (scan_csv, scan_json, scan_jsonl, scan_parquet, combine_batch, name_headerless, classify_files, sniff_delimiter, detect_header, group_files, read_archives)}
