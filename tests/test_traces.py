"""Running metrics and codes against those of all events at once."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import events
from tracewell.streaming import traces

SCHEMA = "traj string, seq long, kind string, tool_name string, tool_call_id string, llm_response_id string, pattern string, path string, include string, start_line int, end_line int, text_chars int, is_error boolean, truncated boolean, response_tokens int, action_valid boolean, n_locations int"


def log(seed):
    """Trajectories with every fault now and then."""
    rnd = random.Random(seed)
    rows = []
    for t in range(40):
        seq, odd = 0, rnd.random() < 0.5
        maybe = lambda p: odd and rnd.random() < p
        for i in range(rnd.randint(1, 9)):
            tool = rnd.choice(["glob", "grep", "read_file", "read_file"]) if not maybe(0.05) else rnd.choice([None, "other"])
            call = None if maybe(0.03) else f"c{i if not maybe(0.08) else 0}"
            a = rnd.randrange(1, 60)
            about = (rnd.choice("pq"), rnd.choice(["f", "./f", "g/../f", None, ""]), rnd.choice([None, "*.py"]), a, a + rnd.choice([0, 5, 30, 700, -1, -3]))
            rows.append((f"t{t}", seq, "ActionEvent", tool, call, f"r{i // 2}", *about, None, None, None, None, not maybe(0.05), None))
            if not maybe(0.1):
                rows.append((f"t{t}", seq + rnd.choice([1, 1, 1, -5 if odd else 1]), "ObservationEvent", "glob" if maybe(0.1) else tool, call, None, *about, None if maybe(0.05) else rnd.choice([10, 9000]), None if maybe(0.4) else maybe(0.2), rnd.random() < 0.2, None, None, None))
            if rnd.random() < 0.5:
                rows.append((f"t{t}", seq + 2, "TokenEvent" if not maybe(0.05) else rnd.choice([None, "AgentErrorEvent", "ConversationErrorEvent"]), None, None, f"r{i // 2}", None, None, None, None, None, None, None, None, rnd.randrange(99), None, None))
            seq += 3
        for k in range(1 + maybe(0.2) - maybe(0.2)):
            rows += [(f"t{t}", seq, kind, events.FINISH, f"end{k}", "r0" if maybe(0.2) else "rz", None, None, None, None, None, 5, False, False, None, True, 0 if maybe(0.2) else 1) for kind in ("ActionEvent",)]
            rows.append((f"t{t}", seq + 1, "ObservationEvent", events.FINISH, f"end{k}", None, None, None, None, None, None, 5, False, False, None, None, None))
    return rows


@pytest.mark.parametrize("seed,shuffled", [(1, False), (2, True)])
def test_running_metrics(spark, tmp_path, seed, shuffled):
    """Three runs of the stream, each with a part of the events; in any order."""
    rows = log(seed)
    if shuffled:
        random.Random(0).shuffle(rows)
    folder = str(tmp_path)
    for part in (rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        traces.metrics_table(traces.running_metrics(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/state")
    whole = spark.createDataFrame(rows, SCHEMA)
    got = {r["traj"]: r for r in traces.latest(spark.read.parquet(f"{folder}/out")).collect()}
    metrics = {r["traj"]: r for r in events.tool_metrics(whole).collect()}
    codes = {r["traj"]: r["codes"] for r in events.validate(whole).collect()}
    assert got.keys() == metrics.keys() == codes.keys()
    for t, r in got.items():
        assert [r[c] for c in traces.METRICS] == pytest.approx([metrics[t][c] for c in traces.METRICS]), t
        assert r["codes"] == codes[t], t
    assert len({c for x in codes.values() for c in x}) >= 8 and [] in codes.values()


def test_added_lines():
    rnd = random.Random(3)
    for _ in range(200):
        held, seen = [], set()
        for _ in range(12):
            a = rnd.randrange(40)
            b = a + rnd.randrange(10)
            new = set(range(a, b + 1)) - seen
            assert traces.added_lines(held, a, b) == len(new)
            seen |= new
            assert {x for p, q in held for x in range(p, q + 1)} == seen and all(p[1] < q[0] for p, q in zip(held, held[1:]))


def test_call_codes():
    base = {"actions": 1, "seen": 1, "failed": False, "o": (2, "grep"), "a": (1, "grep")}
    for change, want in (({}, None), ({"seen": 0}, "unpaired_action"), ({"actions": 0}, "orphan_observation"), ({"failed": True}, "tool_error"), ({"o": (1, "grep")}, "observation_mismatch"), ({"o": (2, "glob")}, "observation_mismatch"), ({"actions": 0, "seen": 0}, None)):
        assert traces.call_code(base | change) == want


class _Store(dict):
    """A map state that counts calls."""

    calls = 0

    def getValue(self, k):
        self.calls += 1
        return self[k]

    def updateValue(self, k, x):
        self.calls += 1
        self[k] = x


def test_entries_by_bucket(monkeypatch):
    """Small maps take no call of the map state, large ones one for each bucket that is touched; nothing is lost as buckets grow."""
    monkeypatch.setattr(traces, "MOST_ENTRIES", 10)
    store, meta, want = _Store(), [1, 0, {}], {}
    for batch in range(40):
        meta = json.loads(json.dumps(meta))
        held = traces._Entries(store, meta)
        for i in range(batch * 5, batch * 5 + 10):
            held.entry(f"k{i}", [0])[0] += 1
            want[f"k{i}"] = want.get(f"k{i}", 0) + 1
        before, buckets = store.calls, meta[0]
        held.save()
        assert meta[1] == len(want) and meta[1] <= 10 * meta[0]
        if meta[0] == buckets:
            assert store.calls - before == (0 if meta[0] == 1 else len(held.held))
    last = traces._Entries(store, meta)
    assert meta[0] == 64 and {k: last.entry(k, None)[0] for k in want} == want
