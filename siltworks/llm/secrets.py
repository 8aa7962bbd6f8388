"""Secret scans that link the parts of multipart credentials.

Base spans are found by three strong patterns: assignments of secrets, access identifiers, and long
hexadecimal strings. Weak candidates (identifiers by name, mixed strings, endpoints) are reported
only where a complementary part stands in the same text with at most `scope` code points between them.
The link is an interval join: a part is dealt to every bin, as wide as the scope, that it covers; the
parts of each bin are reduced to their first start and last end, and a candidate looks at the bins that
it covers and two on each side. So a candidate meets a few rows for each role, however many parts a text
has.

Everything is DataFrame functions. Places are code points, ends exclusive. The text itself is never
shuffled; a row with matches carries only lengths.

Defined cases: a null or empty text has no spans; rows with the same id and text have the same
spans; a null id is a row of its own; a weak candidate that overlaps a base span is part of it and
not reported; a text of any length is searched whole, and parts meet within its scopes by bins; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_key, text_or_empty

#: Code points within which parts belong together.
SCOPE = 200

#: kind -> (pattern, group whose length counts, least length). The order is that of spans with one start.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "identifier": (r"""(?i)(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    "secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"(?:https?|ftp|ssh|postgres|mysql|redis)://[^\x20\x09-\x0D\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", 0, 7),
}
#: What a kind is a part of, and what a weak candidate needs near it.
ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
NEEDS = {"identifier": ["secret"], "endpoint": ["secret"], "secret": ["identifier", "endpoint"]}
ORDER = [*BASE, *WEAK]


def _matches(text: Column, kind: str) -> Column:
    """Leftmost matches that do not overlap, as an array of (kind, number, gap before the match, its length, long enough); empty if none.

    Splitting by the pattern gives the gaps between the matches, in order.
    """
    pattern, group, least = (BASE | WEAK)[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a match, looked at alone, has no neighbours to look around at, so a group's length comes from the text
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.length(v))
    rows = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), (v >= least).alias("ok")))
    rows = F.transform(rows, lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.get(gaps, i).alias("gap"), r.n.alias("n"), r.ok.alias("ok")))
    return F.when(text.rlike(pattern), rows).otherwise(F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,n:int,ok:boolean>>)"))


def parts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k0 id, k1 hash of the text, kind, start, end): all base spans and weak candidates that overlap none of them."""
    value = text_or_empty(text)
    slim = docs.select(F.col(id).alias("k0"), text_key(text).alias("k1"), F.concat(*[_matches(value, k) for k in ORDER]).alias("found"))
    some = slim.where(F.size("found") > 0).dropDuplicates(["k0", "k1"])
    rows = some.select("k0", "k1", F.explode("found").alias("m")).select("k0", "k1", "m.*")
    before = Window.partitionBy("k0", "k1", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before)).withColumn("start", F.col("end") - F.col("n")).where("ok")
    base = F.col("kind").isin(*BASE)
    earlier = Window.partitionBy("k0", "k1").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("k0", "k1").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    placed = placed.withColumn("base_end", F.max(F.when(base, F.col("end"))).over(earlier)).withColumn("base_start", F.min(F.when(base, F.col("start"))).over(later))
    free = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end")))
    return placed.where(base | free).select("k0", "k1", "kind", "start", "end")


def _map(values: dict[str, str | list[str]], key: Column) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).otherwise(out)
    return out


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of `found` that have a complementary part with at most `scope` code points between, and `partner`,
    the role of the nearest. A part in a bin that the candidate covers is less than a bin away. In a bin before, the
    part that ends last is the nearest; in a bin behind, the one that starts first."""
    low, high = F.floor(F.col("start") / scope), F.floor((F.greatest("start", F.col("end") - 1)) / scope)
    parts = found.select("k0", "k1", _map(ROLE, F.col("kind")).alias("role"), "start", "end", F.explode(F.sequence(low, high)).alias("bin"))
    of_bins = parts.groupBy("k0", "k1", "role", "bin").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = found.where(F.col("kind").isin(*WEAK)).withColumn("low", low).withColumn("high", high)
    asked = weak.select("*", F.explode(_map(NEEDS, F.col("kind"))).alias("role")).select("*", F.explode(F.sequence(F.col("low") - 2, F.col("high") + 2)).alias("bin"))
    near = asked.alias("a").join(of_bins.alias("b"), F.col("a.k0").eqNullSafe(F.col("b.k0")) & (F.col("a.k1") == F.col("b.k1")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.bin") == F.col("b.bin")))
    away = F.when(F.col("a.bin") < F.col("low"), F.col("start") - F.col("last")).when(F.col("a.bin") > F.col("high"), F.col("first") - F.col("end")).otherwise(0)
    near = near.select("a.k0", "a.k1", "a.kind", "a.start", "a.end", "a.role", away.alias("away")).where(F.col("away") <= scope)
    return near.groupBy("k0", "k1", "kind", "start", "end").agg(F.min_by("role", F.struct("away", "role")).alias("partner"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """For each row of `docs`: its id and `found`, an array of (start, order, end, kind) of all base and linked spans, in order."""
    found = stored(parts(docs, id, text), "secret-parts")
    base = found.where(F.col("kind").isin(*BASE))
    weak = linked(found, scope).select("k0", "k1", "kind", "start", "end")
    order = _map({k: i for i, k in enumerate(ORDER)}, F.col("kind")).cast("int")
    spans = base.unionByName(weak).groupBy("k0", "k1").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("found"))
    keys = docs.select(F.col(id).alias("id"), text_key(text).alias("k"))
    both = keys.join(spans, keys.id.eqNullSafe(spans.k0) & (keys.k == spans.k1), "left")
    return both.select(F.col("id").alias(id), F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint,kind:string>>)")).alias("found"))


def span_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
