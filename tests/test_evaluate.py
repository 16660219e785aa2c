"""Rows of unknown or repeated tasks fail an evaluation."""

from __future__ import annotations

import pytest

from tracewell.operators import evaluate


def frame(spark, ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "instance_id string, score double")


def test_known_tasks_pass(spark):
    tasks = frame(spark, ["a", "b", "b", "c"])
    assert sorted(r["instance_id"] for r in evaluate.known_or_raise(frame(spark, ["b", "a", "a"]), tasks).collect()) == ["a", "a", "b"]
    assert evaluate.known_or_raise(frame(spark, []), tasks).count() == 0


@pytest.mark.parametrize("ids,message", [(["a", "z", "y"], "unknown evaluation task: y"), (["a", None], "unknown evaluation task: null")])
def test_unknown_tasks_fail(spark, ids, message):
    rows = evaluate.known_or_raise(frame(spark, ids), frame(spark, ["a", "b"]))
    for act in (rows.count, rows.collect):
        with pytest.raises(Exception, match=message):
            act()


def test_repeated_runs_fail(spark):
    runs = evaluate.unique_or_raise(evaluate.known_or_raise(frame(spark, ["a", "a"]), frame(spark, ["a"])), "instance_id", "evaluation trajectory")
    with pytest.raises(Exception, match="duplicate evaluation trajectory"):
        runs.collect()
