"""Tool metrics and validation codes of trajectories while they run.

Each trajectory's state has what its numbers need and no events: sums; the searches
seen; the lines read, as merged intervals by file; what is known of each call and of
each response. Entries are kept by the bucket, and buckets grow in number, not in size: a
batch reads and writes each bucket once that its events touch, and costs what its events cost.
After the last batch the numbers are those of `operators.events.tool_metrics` and
`operators.events.validate` over all events, in whatever order they came.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import normalized
from ..functions.scoring import tool_cost
from ..operators.events import EXCESS_CHARS, FINISH, MOST_LINES, TOOLS, search_key
from ..shipping import ship

_SUMS = ("num_tool_calls", "search_calls", "read_calls", "repeated_searches", "read_lines", "output_chars", "excess_output_chars", "truncated_outputs", "tool_errors", "completion_tokens", "num_turns", "overlap_lines")
METRICS = (*_SUMS, "overlap_ratio", "tool_efficiency_cost")
_MAPS = ("searches", "read", "calls", "responses")
#: Entries of a bucket, on average, beyond which there are more buckets; a state call for each costs more than to read some together.
MOST_ENTRIES = 256
_STATE = f"traj string, events long, {', '.join(f'{c} double' for c in _SUMS)}, codes array<string>"


def added_lines(intervals: list[list[int]], start: int, end: int) -> int:
    """Merges [start, end] into sorted disjoint intervals, in place; how many of its lines were not there."""
    i = bisect_left(intervals, start, key=lambda x: x[1])
    j, low, high, had = i, start, end, 0
    while j < len(intervals) and intervals[j][0] <= end:
        a, b = intervals[j]
        had += min(b, end) - max(a, start) + 1
        low, high = min(low, a), max(high, b)
        j += 1
    intervals[i:j] = [[low, high]]
    return end - start + 1 - had


def call_code(c: dict) -> str | None:
    """What is wrong with a call, by its action and observations so far."""
    if not c["actions"]:
        return "orphan_observation" if c["seen"] else None
    if c["seen"] != 1:
        return "unpaired_action"
    if c["failed"]:
        return "tool_error"
    (o_seq, o_tool), (a_seq, a_tool) = c["o"], c["a"]
    late = o_seq is not None and a_seq is not None and o_seq <= a_seq
    return "observation_mismatch" if o_tool != a_tool or late else None


class _Entries:
    """Entries of a map, by the bucket in a map state; `meta` is [buckets, entries, the only bucket or null], kept with the sums."""

    def __init__(self, state, meta: list) -> None:
        self.state, self.meta = state, meta
        self.held = {} if meta[2] is None else {0: meta[2]}

    def _bucket(self, i: int) -> dict:
        if i not in self.held:
            self.held[i] = json.loads(self.state.getValue((i,))[0])
        return self.held[i]

    def entry(self, k: str, empty):
        """What is held of k; it may be changed in place until `save`."""
        b = self._bucket(crc32(k.encode("utf-8", "surrogatepass")) % self.meta[0])
        if k not in b:
            b[k] = empty
            self.meta[1] += 1
        return b[k]

    def save(self) -> None:
        """Writes the buckets that were touched; where they have become too full, all of them, in four times the number or more."""
        if self.meta[1] > MOST_ENTRIES * self.meta[0]:
            whole = {k: x for i in range(self.meta[0]) for k, x in self._bucket(i).items()}
            while self.meta[1] > MOST_ENTRIES * self.meta[0]:
                self.meta[0] *= 4
            self.held, self.meta[2] = {i: {} for i in range(self.meta[0])}, None
            for k, x in whole.items():
                self.held[crc32(k.encode("utf-8", "surrogatepass")) % self.meta[0]][k] = x
        if self.meta[2] is None:
            for i, b in self.held.items():
                self.state.updateValue((i,), (json.dumps(b),))


def _order(pair) -> tuple:
    """Nulls first, as Spark orders structs."""
    return tuple((x is not None, x if x is not None else 0) for x in pair)


class RunningTrace(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "v string")
        self.maps = {name: handle.getMapState(name, "k int", "v string") for name in _MAPS}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.sums.get()
        s = json.loads(was[0]) if was is not None else {"maps": {name: [1, 0, {}] for name in _MAPS}, "n": 0, "sums": dict.fromkeys(_SUMS, 0), "codes": {}, "finishes": 0, "finish_at": None, "last": None, "empty": 0, "odd": 0, "no_kind": 0, "no_observation": 0, "agent": 0, "doubled": 0, "mates": {}}
        held = {name: _Entries(state, s["maps"][name]) for name, state in self.maps.items()}

        m = s["sums"]
        later = lambda a, b: b if a is None else a if b is None else max(a, b)
        for row in rows:
            e = row.asDict()
            s["n"] += 1
            for c in ("num_tool_calls", "search_calls", "read_calls", "output_chars", "excess_output_chars", "truncated_outputs", "tool_errors", "completion_tokens", "num_turns"):
                m[c] += e[c]
            if e["search"] is not None:
                seen = held["searches"].entry(e["search"], [0])
                m["repeated_searches"] += seen[0]
                seen[0] = 1
            if e["read_path"] is not None:
                span = e["end_line"] - e["start_line"] + 1
                m["read_lines"] += span
                if span > 0:
                    m["overlap_lines"] += span - added_lines(held["read"].entry(e["read_path"], []), e["start_line"], e["end_line"])
            s["no_kind"] += e["kind"] is None
            s["no_observation"] += e["no_observation"]
            s["agent"] += e["agent"]
            s["odd"] += e["odd"]
            action, observation = e["kind"] == "ActionEvent", e["kind"] == "ObservationEvent"
            if not (action or observation):
                continue
            call = held["calls"].entry(json.dumps(e["tool_call_id"]), {"actions": 0, "seen": 0, "failed": False, "o": None, "a": None})
            before, at = call_code(call), [e["seq"], e["tool_name"]]
            if action:
                call["actions"] += 1
                call["a"] = at if call["a"] is None else max(call["a"], at, key=_order)
                s["doubled"] += call["actions"] > (1 if e["tool_call_id"] else 0)
                s["last"] = later(s["last"], e["seq"])
                response = held["responses"].entry(json.dumps(e["llm_response_id"]), {"actions": 0, "finishes": 0})
                response["actions"] += 1
                if e["tool_name"] == FINISH:
                    response["finishes"] += 1
                    s["finishes"] += 1
                    s["finish_at"] = later(s["finish_at"], e["seq"])
                    s["empty"] += e["n_locations"] == 0
                if response["finishes"]:
                    s["mates"][json.dumps(e["llm_response_id"])] = response["actions"]
            else:
                call["seen"] += 1
                call["failed"] |= bool(e["is_error"])
                call["o"] = at if call["o"] is None else min(call["o"], at, key=_order)
            after = call_code(call)
            if before != after:
                for code, n in ((before, -1), (after, 1)):
                    if code:
                        s["codes"][code] = s["codes"].get(code, 0) + n
        for entries in held.values():
            entries.save()
        self.sums.update((json.dumps(s),))
        yield Row(traj=key[0], events=s["n"], **{c: float(v) for c, v in m.items()}, codes=self._codes(s))

    def _codes(self, s: dict) -> list[str]:
        early = "invalid_events" if s["no_kind"] else "invalid_observation" if s["no_observation"] else "invalid_tool_call_ids" if s["doubled"] else None
        if early:
            return [early]
        if s["finishes"] != 1:
            end = "missing_or_multiple_finish"
        elif (s["finish_at"] is not None and s["last"] is not None and s["finish_at"] != s["last"]) or max(s["mates"].values()) != 1:
            end = "finish_not_sole_final_call"
        else:
            end = "empty_finish" if s["empty"] else None
        own = {c for c, n in s["codes"].items() if n} | {"agent_error" if s["agent"] else None, "invalid_action" if s["odd"] else None, end}
        return sorted(own - {None})


def running_metrics(events: DataFrame) -> DataFrame:
    """(traj, events, the metrics of tool_metrics, codes) of each trajectory with news, after each micro-batch of a stream of events.

    Events are rows as for `operators.events`; action_valid and n_locations are optional.
    The row of a trajectory with the most events is the last one.
    """
    ship(events.sparkSession)
    kind = F.col("kind")
    action, observation = F.coalesce(kind == "ActionEvent", F.lit(False)), F.coalesce(kind == "ObservationEvent", F.lit(False))
    has = lambda c, default: F.coalesce(F.col(c), default) if c in events.columns else default
    failed = F.coalesce("is_error", F.lit(False))
    search = action & F.coalesce(F.col("tool_name").isin("glob", "grep"), F.lit(False))
    shown = observation & (F.coalesce("tool_name", F.lit("")) != FINISH)
    read = observation & F.coalesce(F.col("tool_name") == "read_file", F.lit(False)) & ~failed
    span = F.col("end_line") - F.col("start_line") + 1
    sound = F.coalesce(F.col("path").isNotNull() & span.between(0, MOST_LINES), F.lit(False))
    chars = F.when(shown, F.coalesce("text_chars", F.lit(0))).otherwise(F.lit(0))
    turn = F.coalesce(kind == "TokenEvent", F.lit(False))
    one = lambda c: c.cast("long")
    told = events.select(
        F.col("traj").cast("string").alias("traj"), F.col("seq").cast("long").alias("seq"), "kind", "tool_name", "tool_call_id", "llm_response_id", "is_error",
        F.when(search, search_key()).alias("search"), F.when(read & sound, normalized(F.col("path"))).alias("read_path"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"),
        one(action).alias("num_tool_calls"), one(search).alias("search_calls"), one(action & F.coalesce(F.col("tool_name") == "read_file", F.lit(False))).alias("read_calls"), one(chars).alias("output_chars"), one(F.greatest(F.lit(0), chars - EXCESS_CHARS)).alias("excess_output_chars"),
        one(observation & F.coalesce("truncated", F.lit(False))).alias("truncated_outputs"), (one(observation & failed) + one(read & ~sound)).alias("tool_errors"), one(F.when(turn, F.coalesce("response_tokens", F.lit(0))).otherwise(F.lit(0))).alias("completion_tokens"), one(turn).alias("num_turns"),
        one(observation & F.col("text_chars").isNull() & F.col("is_error").isNull()).alias("no_observation"), one(F.coalesce(kind.isin("AgentErrorEvent", "ConversationErrorEvent"), F.lit(False))).alias("agent"),
        one(action & ~(F.coalesce(F.col("tool_name").isin(*TOOLS), F.lit(False)) & has("action_valid", F.lit(True)))).alias("odd"), has("n_locations", F.lit(1)).cast("long").alias("n_locations"),
    )
    rows = told.groupBy("traj").transformWithState(RunningTrace(), _STATE, "update", "None")
    rows = rows.withColumn("overlap_ratio", F.col("overlap_lines") / F.greatest(F.lit(1.0), F.col("read_lines")))
    cost = tool_cost(*(F.col(c) for c in ("num_tool_calls", "repeated_searches", "overlap_ratio", "output_chars", "excess_output_chars", "truncated_outputs")))
    return rows.withColumn("tool_efficiency_cost", cost).select("traj", "events", *METRICS, "codes")


def metrics_table(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of `running_metrics` over what is there now; each micro-batch adds its rows to a Parquet table."""
    from .cache import rocks

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocks(rows.sparkSession):
        rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(table: DataFrame) -> DataFrame:
    """The last row of each trajectory."""
    rest = [c for c in table.columns if c not in ("traj", "batch")]
    return table.groupBy("traj").agg(F.max_by(F.struct(*rest), "events").alias("_r")).select("traj", "_r.*")
