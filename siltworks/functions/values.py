"""Functions that fix what Spark and its settings leave open: nulls, NaN, text that is no number or date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that a delimited file holds for null.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Fixed value: what a text that may be a date begins with.
DATE_PATTERN = r"^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Shape of a text and the formats tried for it, in order: month first where a date is ambiguous.
DATE_FORMATS = tuple((rf"^\d{{4}}[{sep}]", (f"yyyy{sep}M{sep}d",)) for sep in "-/.") + tuple((rf"^\d{{1,2}}[{sep}]\d{{1,2}}[{sep}]\d{{4}}", (f"M{sep}d{sep}yyyy", f"d{sep}M{sep}yyyy")) for sep in "-/.")

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip(c: Column) -> Column:
    """White space of every kind off both ends; trim() takes blanks alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating-point columns."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in floats}) if floats else df


def fold_null_tokens(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Texts that stand for null become null, in all text columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(~F.col(f"`{n}`").isin(*tokens), F.col(f"`{n}`")) for n in texts}) if texts else df


def to_number(c: Column) -> Column:
    """A number, or null where a text is none ('12d' is none)."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), strip(text).try_cast("double"))


def to_datetime(c: Column) -> Column:
    """A timestamp without zone from ISO text or one of DATE_FORMATS; null where none fits.

    Only texts that look like a date are parsed, and only by the formats of their shape.
    """
    text = strip(c.cast("string"))
    ways = [text.try_cast("timestamp_ntz")]
    for shape, formats in DATE_FORMATS:
        parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
        ways.append(F.when(text.rlike(shape), parsed).cast("timestamp_ntz"))
    return F.when(text.rlike(DATE_PATTERN), F.coalesce(*ways))


def not_in(c: Column, values: Iterable[object]) -> Column:
    """True also for null, unlike NOT IN."""
    return c.isNull() | ~c.isin(*values)


def total(c: Column) -> Column:
    """The sum; 0 where there is nothing known to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def money_total(c: Column, scale: int = 2) -> Column:
    """The sum of amounts, exact in decimals whatever the order of rows, as a double; 0 for none."""
    return F.coalesce(F.sum(c.cast(f"decimal(18,{scale})")), F.lit(0)).cast("double")


def distinct_with_null(c: Column) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def join_text(separator: str, *columns: Column) -> Column:
    """Texts joined; a null is empty, and its separator stays until both ends are stripped."""
    return strip(F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def unaccent(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{M}", "")


def name_tokens(c: Column) -> Column:
    """Lower-case words of a name: accents off, camelCase split, anything but letters and digits between words."""
    snake = F.regexp_replace(unaccent(c), "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.filter(F.split(F.lower(snake), "[^a-z0-9]+"), lambda t: t != "")


def plain_name(name: str) -> str:
    """The snake_case form of one column name, on the driver; the name itself if nothing of it is left."""
    import re
    import unicodedata

    text = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
    words = re.split("[^a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", text).lower())
    return "_".join(w for w in words if w) or name


def value_shape(c: Column, width: int = 40) -> Column:
    """A-Z as A, a-z as a, digits as 9, in the first `width` characters."""
    text = F.substring(c.cast("string"), 1, width)
    for pattern, to in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"\p{Nd}", "9")):
        text = F.regexp_replace(text, pattern, to)
    return text
