"""The keyed result cache against one in plain Python, over several runs of a stream."""

from __future__ import annotations

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tracewell.streaming import cache

SCHEMA = "shard string, seq long, at double, op string, key string, status string, value string"


def plain(rows, size, age):
    """Answers, and what is held at the end."""
    held, out = {}, []
    for shard, seq, at, op, key, status, value in rows:
        c = held.setdefault(shard, OrderedDict())
        if op == "get":
            e = c.pop(key, None)
            if e and at - e[0] < age:
                c[key] = e
                out.append((shard, seq, key, True, e[1]))
            else:
                out.append((shard, seq, key, False, None))
        elif status == "ok" and size:
            c.pop(key, None)
            c[key] = (at, value)
            while len(c) > size:
                c.popitem(last=False)
    return sorted(out, key=lambda r: r[1])


def runs(spark, folder, batches, size, age):
    """Each batch is a run of its own that goes on with the state of the one before."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA.replace("at double", "at timestamp")).parquet(f"{folder}/in")
        cache.answer_table(cache.cached(stream, size, age), f"{folder}/out", f"{folder}/state")
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("size,age", [(3, 20.0), (1, 1e6), (0, 5.0)])
def test_cache(spark, tmp_path, size, age):
    """Hits, expired entries, the size bound, failed results; state lives on between runs, after timers too."""
    rnd = random.Random(size)
    rows, at = [], 1000.0
    for seq in range(160):
        at += rnd.choice([0, 0.5, 1, 4]) + 60 * (seq in (70, 120))
        rows.append((f"s{rnd.randrange(3)}", seq, at, rnd.choice(["put", "get", "get"]), f"k{rnd.randrange(5)}", rnd.choice(["ok", "ok", "ok", "error"]), f"v{seq}"))
    # A batch ends before the next one begins, so nothing is at or behind the watermark.
    got = runs(spark, str(tmp_path), [rows[:70], rows[70:120], rows[120:]], size, age)
    want = plain(rows, size, age)
    assert got == want
    assert any(hit for *_, hit, _ in want) == bool(size)


def test_cache_rules(spark, tmp_path):
    """The last use counts, not the first; a result is a copy; age counts from the put."""
    rows = [("s", 0, 0.0, "put", "a", "ok", "1"), ("s", 1, 1.0, "put", "b", "ok", "2"), ("s", 2, 2.0, "get", "a", None, None), ("s", 3, 3.0, "put", "c", "ok", "3"), ("s", 4, 4.0, "get", "b", None, None), ("s", 5, 5.0, "get", "a", None, None), ("s", 6, 10.0, "get", "a", None, None), ("s", 7, 10.0, "put", "x", "error", "9"), ("s", 8, 10.0, "get", "x", None, None), ("s", 9, 10.5, "get", "c", None, None)]
    rows = [(a, b, 1000.0 + at, *rest) for a, b, at, *rest in rows]
    got = {r[1]: r[3:] for r in runs(spark, str(tmp_path), [rows], 2, 10.0)}
    assert got == {2: (True, "1"), 4: (False, None), 5: (True, "1"), 6: (False, None), 8: (False, None), 9: (True, "3")}
    for size, age in ((-1, 5), (1, 0)):
        with pytest.raises(ValueError):
            cache.cached(spark.createDataFrame([], SCHEMA), size, age)
