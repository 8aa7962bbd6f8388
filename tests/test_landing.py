import gzip
import io
import json
import os
import re
import zipfile
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltworks.plans import files
from siltworks.plans.views import dirty_sales
from siltworks.sources import files as fl
from siltworks.sources import landing

SF = "/root/testdata/sf0.001"


def test_files_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 2000, raising=False)
    made = files._landing(spark, SF).cache()
    monkeypatch.setattr(files, "_landing", lambda *_: made)
    sizes = {r.kind: r["count"] for r in made.groupBy("kind").count().collect()}
    assert sizes.pop("empty") == 1 and len(sizes) == 5 and all(n >= 3 for n in sizes.values()), sizes
    assert {tuple(r) for r in files.sniff_delimiter(spark, SF).collect()} == {("semicolon", ";"), ("tab", "\t"), ("headerless", ",")}
    assert {tuple(r) for r in files.detect_header(spark, SF).collect()} == {("semicolon", True), ("tab", True), ("headerless", False)}


def test_a_sparse_file_of_3_gb_is_classified(spark, tmp_path):
    """No file is read whole: of each, tasks read 64 KB."""
    with open(tmp_path / "big.csv", "w") as f:
        f.write("id;name\n" + "1;x\n" * 40_000)
        f.truncate(3 << 30)
    (tmp_path / "empty.csv").write_text("")
    out = {os.path.basename(r.path): r for r in fl.heads(spark, str(tmp_path)).collect()}
    assert out["big.csv"].length == 3 << 30 and len(out["big.csv"].head) == fl.HEAD_BYTES
    assert out["empty.csv"].length == 0 and bytes(out["empty.csv"].head) == b""
    kinds = {os.path.basename(r.path): (r.format, r.delimiter, r.error) for r in fl.classify(fl.heads(spark, f"file://{tmp_path}")).collect()}
    assert kinds == {"big.csv": ("csv", ";", None), "empty.csv": ("csv", ",", "EMPTY_FILE")}


def test_listing_of_nested_and_hidden_files(spark, tmp_path):
    for name in ("a.csv", "b.csv", "c.csv", ".hidden", "_SUCCESS", "deep/d.csv", "deep/er/e.csv", "deep/_tmp/f.csv", ".git/g.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = landing.listing(spark, str(tmp_path))
    assert sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in found.collect()) == ["a.csv", "b.csv", "c.csv", "deep/d.csv", "deep/er/e.csv"]
    # a task for the files of the folder itself, one for the folder below
    assert found.rdd.getNumPartitions() == 2
    (tmp_path / "none").mkdir()
    assert landing.listing(spark, str(tmp_path / "none")).count() == 0 and fl.heads(spark, str(tmp_path / "none")).count() == 0


def test_a_folder_that_is_not_there_raises(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        fl.heads(spark, str(tmp_path / "nowhere")).collect()


def test_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    archive(tmp_path / "z.zip", {"m.csv": "1\n2\n"})
    assert landing.reached(str(tmp_path)) and not landing.reached("viewfs://c/x")
    monkeypatch.setattr(landing, "reached", lambda path: False)
    assert {(r.length, bytes(r.head)) for r in fl.heads(spark, str(tmp_path)).where("path LIKE '%csv'").collect()} == {(8, b"a;b\n1;2\n")}
    assert sorted((r.archive, r.member, r.line) for r in fl.read_archives(spark, str(tmp_path)).collect()) == [("z.zip", "m.csv", "1"), ("z.zip", "m.csv", "2")]


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_members_of_archives(spark, tmp_path):
    odd = "one\x85still one\x0cline\r\ntwo\n\nfour, no end".encode()
    members = {f"m{i}.csv": f"{i}\n" * 25_000 for i in range(6)} | {"odd.csv": b"\xef\xbb\xbf" + odd, "bad.csv": b"a\xff\n", "empty.csv": "", ".hidden": "no\n", "deep/in.csv": "no\n"}
    archive(tmp_path / "x.zip", members)
    archive(tmp_path / "y.ZIP", {"one.csv": "1\n"})
    out = fl.read_archives(spark, str(tmp_path))
    got = {}
    for r in out.collect():
        got.setdefault((r.archive, r.member), []).append((r.line_number, r.line))
    assert sorted(m for a, m in got if a == "x.zip") == ["bad.csv", *[f"m{i}.csv" for i in range(6)], "odd.csv"]
    assert sorted(got["x.zip", "odd.csv"]) == [(1, "one\x85still one\x0cline"), (2, "two"), (3, ""), (4, "four, no end")]
    assert got["x.zip", "bad.csv"] == [(1, "a�")] and got["y.ZIP", "one.csv"] == [(1, "1")]
    assert sorted(got["x.zip", "m3.csv"]) == [(i + 1, "3") for i in range(25_000)]
    # the members of one archive are more than one task's work
    assert out.where("archive = 'x.zip'").select(F.spark_partition_id()).distinct().count() > 1


def test_archives_in_memory_and_beyond_limits(spark, monkeypatch):
    buffer = io.BytesIO()
    archive(buffer, {"a.csv": "1\n2\n", "b.csv": "3\n"})
    rows = spark.createDataFrame([("in/memory.zip", bytearray(buffer.getvalue()))], "path string, content binary")
    assert sorted((r.archive, r.member, r.line_number, r.line) for r in fl.unzipped(rows).collect()) == [("memory.zip", "a.csv", 1, "1"), ("memory.zip", "a.csv", 2, "2"), ("memory.zip", "b.csv", 1, "3")]
    many = io.BytesIO()
    archive(many, {f"{i}.csv": "x" for i in range(fl.ARCHIVE_FILES + 1)})
    with pytest.raises(Exception, match="too many"):
        fl.unzipped(spark.createDataFrame([("m.zip", bytearray(many.getvalue()))], "path string, content binary")).collect()


def test_few_files_lie_in_the_folder_at_once(spark, monkeypatch):
    """Files are removed once their heads are kept, and every kind but the empty one has had each row in one of its files."""
    monkeypatch.setattr(files, "FILE_ROWS", 1000, raising=False)
    monkeypatch.setattr(files, "FILES_AT_ONCE", 3, raising=False)
    seen, rows, inner = [], Counter(), fl.heads

    def heads(spark, path):
        found = [os.path.join(d, n) for d, _, names in os.walk(path.removeprefix("file://")) for n in names if n.startswith("part-")]
        seen.append(len(found))
        for name in found:
            kind = re.search("kind=([a-z]+)", name)[1]
            lines = pq.read_metadata(name).num_rows if kind == "parquet" else sum(1 for _ in open(name, "rb")) - (kind in ("semicolon", "tab"))
            rows[kind] += lines
        return inner(spark, path)

    monkeypatch.setattr(fl, "heads", heads)
    n = dirty_sales(spark, SF).count()
    made = Counter(r.kind for r in files._landing(spark, SF).select("kind").collect())
    assert max(seen) <= 3, seen
    assert made == Counter(dict.fromkeys(("semicolon", "tab", "headerless", "json", "parquet"), -(-n // 1000)), empty=1)
    assert {k: rows[k] for k in made if k != "empty"} == dict.fromkeys(("semicolon", "tab", "headerless", "json", "parquet"), n)


def test_the_delimiter_is_told_once_for_each_file(spark, tmp_path):
    """Nothing above an explode reads a head, so its delimiter is not told again for each of its lines; and what is told stays the same."""
    texts = {
        "semicolon.csv": "id;when;note\n" + "1;2026-01-02;a, b\n" * 300, "tab.csv": "id\twhen\n" + "7\t2026-01-02\n" * 5, "bare.csv": "7|1\n\n8|2\r\n9|3", "text.csv": "one\ntwo",
        "even.csv": "1,2;3\n4,5;6\n", "empty.csv": "", "one.csv": "4;5", "odd.csv": "a,b\n1,2,3\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    heads = fl.heads(spark, str(tmp_path))
    told = {os.path.basename(r.path): r.d for r in heads.select("path", fl.delimiter(fl._text(F.col("head"))).alias("d")).collect()}
    assert told == {"semicolon.csv": ";", "tab.csv": "\t", "bare.csv": "|", "text.csv": ",", "even.csv": ",", "empty.csv": ",", "one.csv": ";", "odd.csv": ","}
    out = fl.detect_header(heads)
    assert {os.path.basename(r.path): r.has_header for r in out.collect()} == {n: n not in ("bare.csv", "even.csv") for n in texts}
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")
    assert len(above) == 3 and not any(re.search(r"\bhead#", x) for x in above[1:-1]) and "head#" not in above[-1].split("\n")[0], above


def test_json_lines_take_little_disk(spark, monkeypatch):
    """Every row lies in a compressed file of FILE_ROWS rows at most, and the files are removed once they are read."""
    monkeypatch.setattr(files, "FILE_ROWS", 1000)
    seen, inner = [], fl.read_json_lines

    def read_json_lines(spark, path):
        folder = path.removeprefix("file://")
        seen.extend([folder, *[os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("part-")]])
        seen.extend((os.path.getsize(n), gzip.open(n).read()) for n in seen[1:])
        return inner(spark, path)

    monkeypatch.setattr(fl, "read_json_lines", read_json_lines)
    rows = dirty_sales(spark, SF)
    assert sum(r.n for r in files.scan_jsonl(spark, SF).collect()) == rows.count()
    read = [x for x in seen if isinstance(x, tuple)]
    lines = [text.count(b"\n") for _, text in read]
    assert sum(lines) == rows.count() and max(lines) <= 1000
    assert all(set(json.loads(line)) <= set(rows.columns) for _, text in read for line in text.splitlines()[:100])
    assert 4 * sum(size for size, _ in read) < sum(len(text) for _, text in read)
    assert not os.path.exists(seen[0])
