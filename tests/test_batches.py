"""Searches in batches against single ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import anchors, batches, search

WORDS = ["parse", "parser", "error", "raise", "class", "return", "value", "naïve", "tokens"]


@pytest.fixture(scope="module")
def files(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        path = "/".join([*rnd.choices(["src", "lib", "test", ".hid", "node_modules"], weights=[5, 4, 3, 1, 1], k=rnd.randint(0, 3)), rnd.choice(["mod", "util", ".rc", "a.b"]) + f"{i}" + rnd.choice([".py", ".txt", ".md"])])
        rows.append((path, "\n".join(" ".join(rnd.choices(WORDS, k=rnd.randint(0, 6))) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n", "\r\n"])))
    rows += [("bin.dat", "parser\0"), ("none.py", None), ("empty.py", ""), ("long.txt", "tokens " * 9000)]
    return spark.createDataFrame(rows, "path string, text string").repartition(4).cache()


REQUESTS = [
    ("grep", "parser?", None, None), ("grep", r"class\s+raise", "src", "*.py"), ("grep", "error|value", "lib", None), ("grep", "naïve$", None, "!*.txt"), ("grep", "nowhere", None, None), ("grep", "tokens", "long.txt", None), ("grep", "parser", "bin.dat", None),
    ("grep", "(?i)parse", None, None), ("grep", "a.*b", None, None), ("grep", "(?=x)abc", None, None), ("grep", "return", "../x", None), ("grep", "tokens tok", ".", ".rc*"), ("grep", r"\braise\b.*\berror\b", "./src//", "*.{py,md}"), ("grep", "", None, None),
    ("glob", "**/util*.py", None, None), ("glob", "src/**/*.txt", None, None), ("glob", "mod1*.md", "lib", None), ("glob", "*.py", None, None), ("glob", "/abs*", None, None), ("glob", "**/[am]*[0-9].txt", None, None), ("glob", "**/*", None, None), ("other", "parser", None, None),
]


@pytest.mark.parametrize("limit,budget", [(100, 30_000), (7, 300), (1000, 90)])
def test_batches(spark, files, tmp_path, limit, budget):
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(REQUESTS)], "request int, kind string, pattern string, path string, include string")
    answers, results = batches.searched(asked, files, batches.index_table(files, str(tmp_path / "grams")), limit, budget)
    got = {r["request"]: r for r in answers.collect()}
    rows = {}
    for r in results.orderBy("request", "ord").collect():
        rows.setdefault(r["request"], []).append((r["path"], r["line"], r["match"]))
    assert len(got) == len(REQUESTS)
    errors = 0
    for i, (kind, pattern, path, include) in enumerate(REQUESTS):
        if got[i]["error"]:
            errors += 1
            assert i not in rows and got[i]["n"] is None
            continue
        if kind == "grep":
            alone = search.grep_search(files, pattern, include, limit, budget, path, ignore=False).orderBy(F.split("path", "/"), "line").collect()
            want = [(r["path"], r["line"], r["match"]) for r in alone]
        else:
            alone = search.glob_search(files, pattern, limit, path).collect()
            want = [(r["path"], None, r["path"]) for r in alone]
        assert rows.get(i, []) == want, REQUESTS[i]
        assert got[i]["n"] == len(want) and got[i]["truncated"] == (alone[0]["truncated"] if alone else False), REQUESTS[i]
    assert errors == 8 and {got[i]["error"] for i in (7, 8, 20)} == {batches.TOO_BROAD}


@pytest.mark.parametrize("limit,budget,parts", [(100, 30_000, 16), (7, 300, 40), (1, 90, 5)])
def test_all_without_an_index(spark, files, monkeypatch, limit, budget, parts):
    """The same answers as over an index, also where most requests are full before the last files are looked into, and some go on for several rounds."""
    monkeypatch.setattr(batches, "PARTS", parts)
    monkeypatch.setattr(batches, "FIRST_TIMES", 1)
    monkeypatch.setattr(batches, "MORE_TIMES", 2)
    more = [("grep", "class return|value naïve|tokens", "src/lib", None), ("grep", "return value", None, "*7.py"), ("grep", "value", "src", None), ("grep", "error", None, "*.{md,txt}"), ("glob", "**/*.md", None, None), ("grep", r"tokens tokens \z", None, None)]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(REQUESTS + more)], "request int, kind string, pattern string, path string, include string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want, got = batches.searched(asked, files, batches.index(files), limit, budget), batches.searched_all(asked, files, limit, budget)
    for a, b in zip(want, got, strict=True):
        assert a.columns == b.columns and rows(a) == rows(b)
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_of_nothing(spark, files):
    asked = spark.createDataFrame([(1, "grep", "parser", None, None), (2, "glob", "*", None, None)], "request int, kind string, pattern string, path string, include string")
    for some, n in ((asked, 0), (asked.where("request = 2"), None)):
        answers, results = batches.searched_all(some, files.where("false"))
        assert {r["request"]: r["n"] for r in answers.collect()} == {1: n, 2: None} if n == 0 else [r["n"] for r in answers.collect()] == [None]
        assert results.isEmpty()


def test_frequent_strings_are_looked_up_in_the_first_files_only(spark, monkeypatch):
    """Lines that are read for requests that match everywhere grow with the requests, not with their product with the files."""
    held = []
    real = anchors.lines_with
    monkeypatch.setattr(anchors, "lines_with", lambda *a: held.append(real(*a)) or held[-1])
    files = spark.range(2000).select(F.format_string("d/f%04d.txt", "id").alias("path"), F.concat(F.lit("every file has this line\nand its own "), "id").alias("text"))
    asked = spark.createDataFrame([(i, "grep", p, None, None) for i, p in enumerate(("file has this", "every file", "its own 1999"))], "request int, kind string, pattern string, path string, include string")
    answers, results = batches.searched_all(asked, files, 5)
    assert {(r["request"], r["n"], r["truncated"]) for r in answers.collect()} == {(0, 5, True), (1, 5, True), (2, 1, False)}
    assert sorted(r["path"] for r in results.where("request = 0").collect()) == [f"d/f{i:04}.txt" for i in range(5)]
    assert len(held) == 1 and held[0].count() <= 2000 // 10


def test_no_product_in_the_plan(spark, files):
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(REQUESTS)], "request int, kind string, pattern string, path string, include string")
    for df in batches.searched(asked, files, batches.index(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_glob_grams():
    assert batches.glob_grams("src/**/test_?.py") == {"src", "rc/", "tes", "est", "st_", ".py"}
    assert batches.glob_grams("[abc]def/*") == {"def", "ef/"} and not batches.glob_grams("**/*") and batches.glob_grams("a[bcd") == {"bcd"}


def test_batch_size(spark):
    rows = spark.createDataFrame([(0,), (1,), (32,), (33,), (None,)], "n int").select("n", batches.batch_error(F.col("n")).alias("e")).collect()
    assert [r["n"] for r in rows if r["e"] is None] == [1, 32]
