"""The tree source's push-down, the writer's commits and aborts, and fetches with faults."""

from __future__ import annotations

import io
import json
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tracewell.sources import fetch, kept, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in (("a/x.py", "1"), ("a/b/y.py", "22"), ("a/b/.hid", "333"), ("c/z.txt", "4" * 1000), ("top.md", "")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "empty").mkdir()
    os.symlink("../a/x.py", root / "c/in")
    os.symlink("/etc/hosts", root / "out")
    return str(root)


def test_tree_filters(spark, root):
    """Every filter gives what Spark alone gives, and the plan has none of the pushed ones left."""
    tree.register(spark)
    all_rows = spark.read.format("code_tree").load(root).collect()
    assert {(r["path"], r["kind"], r["size"], r["inside"]) for r in all_rows} >= {("a/b/y.py", "file", 2, True), ("out", "link", 0, False), ("c/in", "link", 0, True), ("empty", "dir", 0, True), ("a/b/.hid", "file", 3, True)}
    plain = spark.createDataFrame(all_rows, tree.SCHEMA)
    for where in ("path LIKE 'a/b/%'", "path = 'c/z.txt'", "path IN ('a/x.py', 'none')", "kind = 'file' AND size > 1", "NOT kind = 'dir'", "size <= 3 AND path LIKE '%.py'", "link_target IS NOT NULL", "link_target IS NULL AND path LIKE '%b%'", "path > 'c'", "inside", "kind <> 'link' AND length(path) > 5", "NOT link_target = 'x'", "path <=> 'top.md'"):
        df = spark.read.format("code_tree").load(root).where(where)
        key = lambda rows: sorted((r["path"], r["content"]) for r in rows)
        assert key(df.collect()) == key(plain.where(where).collect()), where
    plan = spark.read.format("code_tree").load(root).where("kind = 'file' AND path LIKE 'a/%'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan) and "code_tree" in plan


def test_tree_lists_and_reads_only_what_is_asked(spark, root, monkeypatch):
    reader = tree.TreeReader(root, ["path", "content"], 10**9)
    left = list(reader.pushFilters([ds.StringStartsWith(("path",), "a/b/"), ds.EqualTo(("content",), b"22")]))
    assert [type(f) for f in left] == [ds.EqualTo]
    listed, real = [], os.listdir
    monkeypatch.setattr(os, "listdir", lambda p: listed.append(os.path.relpath(p, root)) or real(p))
    assert [r["path"] for r in reader.entries()] == ["a/b/.hid", "a/b/y.py"]
    assert sorted(listed) == [".", "a", "a/b"]
    monkeypatch.undo()
    assert len(tree.TreeReader(root, ["path", "content"], tree.OPEN_BYTES + 1).partitions()) > len(tree.TreeReader(root, ["path", "content"], 10**9).partitions()) == 1
    os.chmod(os.path.join(root, "a/x.py"), 0)
    try:
        rows = spark.read.format("code_tree").schema("path string, size long").load(root).collect()
    finally:
        os.chmod(os.path.join(root, "a/x.py"), 0o644)
    assert ("a/x.py", 1) in set(map(tuple, rows)) and rows[0].__fields__ == ["path", "size"]
    (part,) = tree.TreeReader(root, ["path", "size"], 10**9).partitions()
    monkeypatch.setattr("builtins.open", lambda *a, **k: pytest.fail("a file was read"))
    assert len(list(tree.TreeReader(root, ["path", "size"], 10**9).read(part))) == len(part.paths)


def test_row_groups(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 2345, 1, 2).select("id", F.col("id").cast("string").alias("s"), F.array("id").alias("a"))
    kept.write_rows(rows, path, row_group=500)
    sizes = [[pq.ParquetFile(f).metadata.row_group(i).num_rows for i in range(pq.ParquetFile(f).metadata.num_row_groups)] for f in sorted((tmp_path / "out").glob("part-*/rows.parquet"))]
    assert [len(s) for s in sizes] == [3, 3] and all(set(s[:-1]) == {500} and 0 < s[-1] <= 500 for s in sizes)
    again = spark.read.parquet(f"{path}/part-*")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    assert not [p for p in os.listdir(path) if p.startswith("_pending")]
    with pytest.raises(Exception, match="not empty"):
        kept.write_rows(rows, path)
    kept.write_rows(rows.limit(3), path, overwrite=True)
    assert spark.read.parquet(f"{path}/part-*").count() == 3


def test_failed_tasks_leave_nothing(spark, tmp_path):
    """A task dies after others have written: neither its files nor theirs stay, and what was there before does."""
    path = str(tmp_path / "out")
    kept.write_rows(spark.range(5), path)
    before = sorted(os.listdir(path))
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("planted")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="planted"):
        kept.write_rows(bad, path, row_group=100, overwrite=True)
    assert sorted(os.listdir(path)) == before and spark.read.parquet(f"{path}/part-*").count() == 5


def test_traces(spark, tmp_path):
    path = str(tmp_path / "traces")
    rows = [(r, i, f"é{i}") for r in ("one", "b/c d", "two") for i in range(5)]
    kept.write_traces(spark.createDataFrame(rows[::-1], "run string, pos int, text string").repartition(4), path, "run", "pos")
    files = {f: [json.loads(x) for x in open(os.path.join(d, f), encoding="utf-8")] for d, _, names in os.walk(path) for f in names if f.endswith(".jsonl")}
    assert {f: [(r["run"], r["pos"], r["text"]) for r in v] for f, v in files.items()} == {f"run-{n}.jsonl": [x for x in rows if x[0] == r] for r, n in (("one", "one"), ("b/c d", "b%2f%c%20%d"), ("two", "two"))}
    with pytest.raises(Exception, match="no column"):
        spark.range(1).write.format("kept_files").option("kind", "traces").mode("append").save(str(tmp_path / "x"))


class Faulty:
    """Answers by a script for each address."""

    def __init__(self, script):
        self.script, self.asked = script, []

    def __call__(self, url):
        self.asked.append(url)
        said = self.script.pop(0)
        if isinstance(said, Exception):
            raise said
        return io.BytesIO(said)


def test_retries_and_cache(tmp_path):
    waits = []
    source = Faulty([OSError("reset"), b"", TimeoutError("slow"), OSError("x"), OSError("x"), b"good"])
    content, tries = fetch.fetch("u", str(tmp_path), 9, 1.0, source, waits.append)
    assert (content, tries) == (b"good", 6) and waits == [1, 2, 4, 8, 8]
    assert fetch.fetch("u", str(tmp_path), 1, 1.0, Faulty([]), waits.append) == (b"good", 0)
    with pytest.raises(fetch.FetchError, match="v: last"):
        fetch.fetch("v", str(tmp_path), 2, 1.0, Faulty([OSError("first"), OSError("last")]), waits.append)
    assert len(os.listdir(tmp_path)) == 1  # neither halves nor failures


def test_fetched(spark, tmp_path):
    source, folder = tmp_path / "source", tmp_path / "cache"
    for repo, path, text in (("o/r", "a b.py", "one"), ("o/r", "d/é.py", "two"), ("o/s", "empty.py", "")):
        (source / repo / path).parent.mkdir(parents=True, exist_ok=True)
        (source / repo / path).write_text(text)
    keys = [("o/r", "a b.py")] * 3 + [("o/r", "d/é.py"), ("o/s", "empty.py"), ("o/s", "gone.py")]
    df = spark.createDataFrame(keys, "repo string, path string")
    template = f"file://{source}/{{repo}}/{{path}}"
    rows = lambda: {(r["repo"], r["path"]): (bytes(r["content"]).decode() if r["content"] is not None else None, r["tries"], r["error"] is not None) for r in fetch.fetched(df, template, str(folder), 2, 0.01).collect()}
    assert rows() == {("o/r", "a b.py"): ("one", 1, False), ("o/r", "d/é.py"): ("two", 1, False), ("o/s", "empty.py"): (None, 2, True), ("o/s", "gone.py"): (None, 2, True)}
    assert {v[1] for k, v in rows().items() if k[0] == "o/r"} == {0}  # all from the cache
