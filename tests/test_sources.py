"""Readers, guarded writers, export round trip and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import export
from tracewell.sources import loaders
from tracewell.streaming import metrics


def test_shards_in_order(spark, tmp_path):
    for name, lo in (("b", 10), ("a", 0)):
        spark.range(lo, lo + 5).select(*(F.col("id").cast("string").alias(c) for c in loaders.RAW_COLUMNS)).coalesce(1).write.parquet(str(tmp_path / f"x{name}"))
        part = next((tmp_path / f"x{name}").glob("*.parquet"))
        part.rename(tmp_path / f"{name}.parquet")
    rows = loaders.shards(spark, str(tmp_path), limit=7).collect()
    assert [r["instance_id"] for r in sorted(rows, key=lambda r: r["ord"])] == ["0", "1", "2", "3", "4", "10", "11"]


def test_json_forms(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"a": 1}, {"a": None}]))
    (tmp_path / "two.json").write_text(json.dumps({"b": 2}))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert loaders.load(spark, str(tmp_path)).count() == 3
    assert loaders.load(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_outcomes(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"resolved_ids": ["a"], "unresolved_ids": ["b"]}))
    assert sorted(map(tuple, loaders.outcomes(spark, str(tmp_path / "r.json")).collect())) == [("a", True, "swe-bench"), ("b", False, "swe-bench")]
    (tmp_path / "s.json").write_text(json.dumps([{"instance_id": "c", "resolved": True}]))
    assert [tuple(r) for r in loaders.outcomes(spark, str(tmp_path / "s.json")).collect()] == [("c", True, None)]
    (tmp_path / "t.json").write_text(json.dumps([{"instance_id": "c", "resolved": "false"}]))
    with pytest.raises(Exception, match="boolean"):
        loaders.outcomes(spark, str(tmp_path / "t.json")).collect()


def test_guard(spark, tmp_path):
    rows = spark.range(3).withColumn("split", F.lit("train"))
    loaders.write_dataset(rows, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "validation.parquet")).count() == 0
    with pytest.raises(FileExistsError):
        loaders.write_dataset(rows, str(tmp_path))
    loaders.write_dataset(rows, str(tmp_path), overwrite=True)


def test_export(spark, tmp_path):
    t = spark.createDataFrame([("case1", "o/r", "k", "easy", "c" * 40)], "instance_id string, repo string, task_key string, difficulty string, base_commit string")
    row = ("case1", [], 3.0, 0.1, "grep add", "m", "t", [1, 2, 3, 4], [0, 1, 0, 1])
    rows = [(1, *row), (2, *row), (3, "gone", *row[1:]), (4, "case1", ["tool_error"], *row[2:]), (5, "case1", [], 0.1, 9.0, *row[4:])]
    schema = "traj int, instance_id string, codes array<string>, quality double, cost double, steps string, messages string, tools string, input_ids array<long>, loss_mask array<long>"
    parts = export.exported(t, spark.createDataFrame(rows, schema), 0.0)
    export.write(parts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/sft/train")).first()["loss_mask"] == [0, 1, 0, 1]
    assert spark.read.parquet(str(tmp_path / "out/sft/validation")).count() == 0
    assert spark.read.parquet(str(tmp_path / "out/rl/train")).first()["base_commit"] == "c" * 40
    assert {r["traj"]: r["reasons"] for r in parts["rejected"].collect()} == {2: ["duplicate_sequence"], 3: ["unknown_task"], 4: ["tool_error"], 5: ["low_quality", "high_cost"]}


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, "ActionEvent", "glob", None), (1, "TokenEvent", None, None), (2, "ObservationEvent", "glob", True)], "traj long, kind string, tool_name string, is_error boolean").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    metrics.memory_query(metrics.running_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))), "running")
    got = {r["traj"]: r for r in spark.table("running").collect()}
    assert got[1]["num_tool_calls"] == 1 and got[1]["search_calls"] == 1 and got[1]["num_turns"] == 1 and got[2]["tool_errors"] == 1


def test_stream_of_parts(spark, tmp_path):
    """The events as a folder of parts or one file, beside other tables, by a plain path and one that only Spark reads."""
    from tracewell.plans import code

    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    want = [("0", 34, 1683.0), ("1", 33, 1617.0), ("2", 33, 1650.0)]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.streams.link./in", tmp_path.as_uri())
    for kind, parts in (("parts", 7), ("file", 1)):
        d = tmp_path / kind
        rows.repartition(parts).write.parquet(str(d / "events.parquet"))
        spark.range(7).write.parquet(str(d / "orders.parquet"))
        if kind == "file":
            (part,) = (d / "events.parquet").glob("part-*.parquet")
            part.rename(d / "part")
            for x in [*(d / "events.parquet").iterdir()]:
                x.unlink()
            (d / "events.parquet").rmdir()
            (d / "part").rename(d / "events.parquet")
        for path in (str(d), f"viewfs://streams/in/{kind}"):
            assert sorted(map(tuple, code.streaming_counts(spark, path).collect())) == want, path
