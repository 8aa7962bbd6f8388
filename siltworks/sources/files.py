"""Landing files: their format, delimiter and header, and readers that give the same values whatever wrote them."""

from __future__ import annotations

import io
import shutil
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import values as v

from . import landing

#: Bytes of a file from which format and delimiter are told, and rows from which a header is.
HEAD_BYTES, HEAD_ROWS = 65_536, 200
#: Candidates for a delimiter in order, formats by extension.
DELIMITERS = (",", ";", "\t", "|")
EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "zip": "zip"}
#: First bytes in hex.
SIGNATURES = {"50415231": "parquet", "504B0304": "zip", "D0CF11E0": "excel", "1F8B": "gzip"}
#: Files in an archive, bytes of a member, bytes of all members.
ARCHIVE_FILES, ARCHIVE_MEMBER_BYTES, ARCHIVE_BYTES = 200, 100 << 20, 500 << 20
#: Lines of an archive's member that are handed on at once.
LINES_A_BATCH = 10_000


# -- readers -------------------------------------------------------------------------------------


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as integer, decimal, datetime or string; null where a text does not fit."""
    def column(name: str) -> Column:
        kind = kinds.get(name, "string")
        c = F.col(f"`{name}`")
        if kind == "datetime":
            return v.to_datetime(c).alias(name)
        if kind in ("integer", "decimal"):
            number = v.to_number(c)
            return (F.when(number % 1 == 0, number.cast("long")) if kind == "integer" else number).alias(name)
        return c.alias(name)

    return df.select(*[column(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, kinds: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Delimited files, all columns as text at first: no second scan to guess types, and texts that stand for null become null."""
    reader = spark.read.option("sep", sep).option("header", header).option("inferSchema", False).option("escape", '"').option("multiLine", False)
    df = reader.csv(path)
    if names:
        df = df.toDF(*names)
    return typed(v.fold_null_tokens(df), kinds or {})


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs become columns a.b, at every depth; arrays stay values."""
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterator[Column]:
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))

    return df.select(*leaves(df.schema, ()))


def read_json(spark: SparkSession, path: str | list[str], multi_line: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents: an array of objects, an object with a `data` array, or one object. Nested objects are flattened.
    multi_line: a file is one document; otherwise a line is."""
    reader = spark.read.option("multiLine", multi_line)
    df = (reader.schema(schema) if schema else reader).json(path)
    data = next((f for f in df.schema if f.name == "data" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
    return flatten(df.select(F.inline("data")) if data else df)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """One object for each line, not flattened."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def combine(frames: list[DataFrame]) -> DataFrame:
    """Frames under each other; a column that some lack is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def name_columns(df: DataFrame, names: list[str] | None = None, contracts: dict[str, dict[str, str]] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Names for the columns of a file without header: the given ones if there are as many, else those of the only contract
    (name -> kind of each column) with the same kinds in order, else column_1, column_2, ..."""
    if names and len(names) == len(df.columns):
        return df.toDF(*[v.plain_name(n) for n in names])
    coarse = lambda k: "number" if k in ("integer", "decimal") else k
    fits = [list(c) for c in (contracts or {}).values() if kinds and len(c) == len(kinds) and all(k == "empty" or coarse(k) == coarse(x) for k, x in zip(kinds, c.values()))]
    return df.toDF(*(fits[0] if len(fits) == 1 else [f"column_{i}" for i in range(1, len(df.columns) + 1)]))


# -- landing folder ------------------------------------------------------------------------------


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, head) of all files below a folder, those without a byte among them: of each, the first HEAD_BYTES."""
    return landing.heads(spark, path, HEAD_BYTES)


def _text(head: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(head.cast("string")), "^\ufeff", "")


def _lines(text: Column) -> Column:
    return F.filter(F.slice(F.split(text, "\r?\n", HEAD_ROWS + 1), 1, HEAD_ROWS), lambda x: x != "")


def _delimiter(lines: Column) -> Column:
    def often(sep: str) -> Column:
        counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
        return F.when(F.size(F.array_distinct(counts)) == 1, F.array_max(counts)).otherwise(0)

    # where none fits, all are 0, of which the comma is first
    return F.array_max(F.array(*[F.named_struct(F.lit("n"), often(sep), F.lit("order"), F.lit(-i), F.lit("sep"), F.lit(sep)) for i, sep in enumerate(DELIMITERS)]))["sep"]


def delimiter(text: Column) -> Column:
    """The candidate that stands equally often, and at least once, in every line of the head; the most frequent such; else a comma."""
    # the lines are a variable of a lambda, so a head is split once, not once for each use
    return F.element_at(F.transform(F.array(_lines(text)), _delimiter), 1)


def classify(files: DataFrame) -> DataFrame:
    """(path, format, detected_by, delimiter, error) of each head: by first bytes, else extension, else content."""
    signature = F.hex(F.substring("head", 1, 4))
    by_bytes = F.lit(None).cast("string")
    for mark, kind in SIGNATURES.items():
        by_bytes = F.when(signature.startswith(mark), kind).otherwise(by_bytes)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.lit(None).cast("string")
    for e, kind in EXTENSIONS.items():
        by_name = F.when(extension == e, kind).otherwise(by_name)
    text = _text(F.col("head"))
    first = F.substring(F.ltrim(text), 1, 1)
    by_content = F.when(first.isin("{", "["), "json").when(F.length(text) > 0, "csv")
    rows = files.select("path", "length", by_bytes.alias("b"), by_name.alias("n"), by_content.alias("c"), delimiter(text).alias("d"))
    kind = F.coalesce("b", "n", "c")
    error = (
        F.when(F.col("length") == 0, "EMPTY_FILE")
        .when(F.col("b").isNotNull() & F.col("n").isNotNull() & (F.col("b") != F.col("n")), "EXTENSION_MISMATCH")
        .when(F.col("b").isNull() & F.col("n").isin("parquet", "zip"), "SIGNATURE_MISSING")
    )
    by = F.when(F.col("b").isNotNull(), "signature").when(F.col("n").isNotNull(), "extension").when(F.col("c").isNotNull(), "content")
    return rows.select("path", kind.alias("format"), by.alias("detected_by"), F.when(kind == "csv", F.col("d")).alias("delimiter"), error.alias("error"))


def _cells(line: Column, sep: Column) -> Column:
    """The fields of a line; a delimiter between quotes is text."""
    outside = F.concat(F.regexp_replace(sep, r"([|])", r"[$1]"), F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return F.transform(F.split(line, outside, -1), lambda x: F.regexp_replace(x, '^"|"$', ""))


def detect_header(files: DataFrame) -> DataFrame:
    """(path, has_header) of delimited heads. A column is typed if all its cells from the second row on are numbers, or all dates;
    there is no header if the first row has the same kind in every typed column, and some column is typed."""
    # the delimiter is told below the explode: beside it, Spark would tell it again for each of the lines
    split = files.select("path", _lines(_text(F.col("head"))).alias("lines"))
    lines = split.select("path", _delimiter(F.col("lines")).alias("sep"), "lines").select("path", "sep", F.posexplode("lines").alias("row", "line"))
    cells = lines.select("path", "row", F.posexplode(_cells(F.col("line"), F.col("sep"))).alias("col", "cell"))
    kind = F.when(v.to_number(F.col("cell")).isNotNull(), "number").when(v.to_datetime(F.col("cell")).isNotNull(), "date").otherwise("text")
    kinds = cells.select("path", "row", "col", kind.alias("kind"))
    body = F.col("row") > 0
    per = kinds.groupBy("path", "col").agg(
        F.max(F.when(~body, F.col("kind"))).alias("first"), F.min(F.when(body, F.col("kind"))).alias("low"), F.max(F.when(body, F.col("kind"))).alias("high"), F.count_if(body).alias("n")
    )
    typed_ = (F.col("low") == F.col("high")) & F.col("low").isin("number", "date")
    out = per.groupBy("path").agg(F.coalesce(F.bool_or(typed_), F.lit(False)).alias("some"), F.coalesce(F.bool_and(F.when(typed_, F.col("first") == F.col("low"))), F.lit(False)).alias("same"), F.max("n").alias("n"))
    return files.select("path").join(out, "path", "left").select("path", (~F.coalesce(F.col("some") & F.col("same") & (F.col("n") > 0), F.lit(False))).alias("has_header"))


def group_by_columns(files: DataFrame) -> DataFrame:
    """(columns, paths): delimited heads with the same set of columns, in any order."""
    text = _text(F.col("head"))
    first = files.select("path", F.array_sort(_cells(F.try_element_at(_lines(text), F.lit(1)), delimiter(text))).alias("columns"))
    return first.groupBy("columns").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`unzipped` for all ZIP archives below a folder; each member is read from its archive's place by the task that unzips it. In a store
    that only Spark's readers reach, archives are read whole."""
    if not landing.reached(path):
        return unzipped(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").endswith(".zip")))
    names = landing.listing(spark, path).where(F.lower("path").endswith(".zip")).select("path", F.lit(None).cast("binary").alias("content"))
    return unzipped(names)


def _members(z: zipfile.ZipFile, name: str) -> list[zipfile.ZipInfo]:
    """The data files of an archive; an archive beyond the limits is refused."""
    members = [m for m in z.infolist() if not m.is_dir() and "/" not in m.filename and not m.filename.startswith((".", "_"))]
    if len(members) > ARCHIVE_FILES or any(m.file_size > ARCHIVE_MEMBER_BYTES for m in members) or sum(m.file_size for m in members) > ARCHIVE_BYTES:
        raise ValueError(f"{name} holds too many or too large files")
    return members


@contextmanager
def _archive(path: str, content: bytes | None) -> Iterator[zipfile.ZipFile]:
    """An archive from its bytes, or from its place, where only what is asked for is read."""
    if content is not None:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield z
    else:
        store, inner, _ = landing.store_of(path)
        with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            yield z


def member_lines(data: io.BufferedIOBase) -> Iterator[str]:
    """The lines of a UTF-8 file, decoded as they are read. A line ends at LF, CR LF or CR and nowhere else; bytes that are no
    UTF-8 become U+FFFD."""
    with io.TextIOWrapper(data, "utf-8-sig", errors="replace", newline=None) as text:
        for line in text:
            yield line.removesuffix("\n")


def unzipped(archives: DataFrame) -> DataFrame:
    """(archive, member, line_number, line) of the data files in archives (path, content; where content is null the archive is read
    from its path). The directories are read first; then each member is a row, dealt to tasks, so the members of one archive are
    unzipped by many. Hidden and nested members are left out; an archive with too many or too large members is refused. Unzipping is the
    one thing here that Spark has no function for."""

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                with _archive(path, content) as z:
                    for m in _members(z, path):
                        # a member of an archive in memory goes on alone, as it is compressed
                        own = None
                        if content is not None:
                            buffer = io.BytesIO()
                            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as one:
                                with z.open(m) as source, one.open(m.filename, "w") as to:
                                    shutil.copyfileobj(source, to)
                            own = buffer.getvalue()
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "member": pa.array([m.filename], pa.string()), "content": pa.array([own], pa.binary())})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, member, content in zip(*[c.to_pylist() for c in batch.columns]):
                with _archive(path, content) as z, z.open(member) as f:
                    number = 0
                    found = member_lines(f)
                    while part := list(islice(found, LINES_A_BATCH)):
                        n = len(part)
                        yield pa.RecordBatch.from_pydict({"archive": pa.array([path.rsplit("/", 1)[-1]] * n, pa.string()), "member": pa.array([member] * n, pa.string()), "line_number": pa.array(range(number + 1, number + 1 + n), pa.int64()), "line": pa.array(part, pa.string())})
                        number += n

    members = archives.select("path", "content").mapInArrow(directory, "path string, member string, content binary")
    dealt = members.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(lines, "archive string, member string, line_number long, line string")
