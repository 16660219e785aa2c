"""Column functions against the expected values of the survey's fixtures and small Python twins."""

from __future__ import annotations

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import paths, scoring, text, tokens


def test_normalized_is_posix(spark):
    rnd = random.Random(1)
    cases = ["", "a", "a//b", "./a/.", "a/../b", "../a", "a/../../b", "/", "/..", "/a/../../b", ".", "a/b/../.."]
    cases += ["/".join(rnd.choice(["a", "b", "..", ".", ""]) for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", paths.normalized(F.col("p")).alias("n")).collect()
    for r in rows:
        want = posixpath.normpath(r["p"]) if not r["p"].startswith("//") else "/" + posixpath.normpath(r["p"]).lstrip("/")
        assert r["n"] == want, r


@pytest.mark.parametrize("path,ok", [("a.py", True), ("a//b.py", True), ("/a", False), ("../a", False), ("./a", False), ("C:/a", False), (" a", False), ("", False), ("a\\..\\b", False)])
def test_path_error(spark, path, ok):
    r = spark.createDataFrame([(path,)], "p string").select(paths.path_error(F.col("p")).alias("e")).first()
    assert (r["e"] is None) == ok


@pytest.mark.parametrize(
    "pattern,yes,no",
    [("**/*.py", ["a.py", "x/y/a.py", ".h/a.py"], ["a.pyc"]), ("*.py", ["a.py"], ["x/a.py"]), ("src/**/t_?.py", ["src/t_1.py", "src/a/b/t_2.py"], ["t_1.py"]), ("a/**", [], ["a/b"]), ("[ab]*.py", ["a.py", "b1.py"], ["c.py"]), ("*.{py,md}", ["x.{py,md}"], ["x.py"])],
)
def test_glob(pattern, yes, no):
    import re

    r = re.compile(paths.glob_regex(pattern).replace(r"\z", r"\Z"))
    assert all(r.search(x) for x in yes) and not any(r.search(x) for x in no)


def test_glob_rejects():
    for bad in ("/a", "../a", "a/../b", ""):
        with pytest.raises(ValueError):
            paths.glob_regex(bad)


def test_line_models(spark):
    s = "a\r\nb\x0bc\rd\n"
    r = spark.createDataFrame([(s,)], "s string").select(*(text.lines(F.col("s"), m).alias(str(i)) for i, m in enumerate((text.READ_LINES, text.SEARCH_LINES, text.CONTEXT_LINES)))).first()
    assert r[0] == ["a", "b\x0bc", "d"] and r[1] == ["a\r", "b\x0bc\rd"] and r[2] == s.splitlines()


def test_task_key_ignores_spacing(spark):
    rows = [("o/r", "Fix  it", "p\r\n"), ("o/r", " Fix it\n", "p"), ("o/r", "Fix it", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string, s string, p string").select(text.task_key(F.col("r"), F.lit(None).cast("string"), F.col("s"), F.col("p"), F.lit(False))).collect()]
    assert got[0] == got[1] != got[2]


TURNS = "array<struct<prompt:array<bigint>,response:array<bigint>>>"


@pytest.mark.parametrize(
    "turns,error",
    [
        ([([1, 2], [3, 4]), ([1, 2, 3, 4, 5, 6], [7])], None),
        ([([1, 2], [3, 4]), ([9, 2], [7])], "does_not_extend"),
        ([([1, 2], [3]), ([1, 2], [3])], "empty_or_out_of_order"),
        ([([1, 2], [])], "empty_or_out_of_order"),
        ([([], [1])], "empty_prompt"),
        ([([1, -2], [1])], "invalid_token"),
        ([([1], [2]), ([1, 3], [4])], "response_not_preserved"),
        ([], "no_turns"),
    ],
)
def test_masks(spark, turns, error):
    df = spark.createDataFrame([(turns,)], f"t {TURNS}").withColumn("e", tokens.mask_error(F.col("t")))
    r = df.select("e", F.when(F.col("e").isNull(), tokens.merged(F.col("t"))).alias("m")).first()
    assert r["e"] == error
    if not error:
        assert (r["m"]["prompt"], r["m"]["response"], r["m"]["loss_mask"]) == ([1, 2], [3, 4, 5, 6, 7], [1, 1, 0, 0, 1])


CHANGES = "array<struct<file:string,changes:struct<added_entities:array<string>,added_modules:array<string>,edited_entities:array<string>,edited_modules:array<string>>>>"
PLACES = "array<struct<file:string,class_name:string,function_name:string>>"


@pytest.mark.parametrize("places,reward", [([("a.py", "New", "run")], 3.0), ([], 0.0), (None, 0.0), ([("a.py", "New", "run"), (None, "X", None)], 0.0), ([("a.py", None, None)], 1.0)])
def test_reward(spark, places, reward):
    truth = [("a.py", (["a.py:New.run"], ["a.py:New"], None, None))]
    r = spark.createDataFrame([(truth, places)], f"c {CHANGES}, l {PLACES}").select(scoring.localization_reward(F.col("c"), F.col("l")).alias("r")).first()["r"]
    assert r["reward"] == reward
    if reward == 3.0:
        assert r["class_f1"] == r["entity_reward"] == 1.0


def test_cost_and_penalty(spark):
    c = [float(x) for x in (3, 0, 0, 4666, 0, 0)]
    r = spark.createDataFrame([tuple(c)], "a double, b double, c double, d double, e double, f double").select(scoring.tool_cost(*map(F.col, "abcdef")).alias("k")).withColumn("p", scoring.penalized(F.lit(3.0), F.col("k"))).first()
    assert abs(r["k"] - 0.06666) < 1e-9 and abs(r["p"]["total"] - 2.986668) < 1e-9
    with pytest.raises(ValueError):
        scoring.penalized(F.lit(1.0), F.lit(1.0), 2)
