"""Runs of a policy over tasks: a hook for agents, with a scripted policy that searches once and finishes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

EVENTS = "instance_id string, seq int, kind string, tool_name string, tool_call_id string, llm_response_id string, action string, text string, is_error boolean, status string"
#: Of a task's row (a dict): events as dicts of EVENTS' columns but instance_id, seq and status, in order.
Policy = Callable[[dict], list[dict]]


def runs(tasks: DataFrame, policy: Policy) -> DataFrame:
    """(EVENTS) of each task, by batches. A policy that fails on a task gives an error event and the status `error`, and leaves the others alone."""
    ship(tasks.sparkSession)
    names = [x.split()[0] for x in EVENTS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for task in p.to_dict("records"):
                try:
                    made, status = policy(task), "ok"
                except Exception as e:
                    made, status = [{"kind": "ConversationErrorEvent", "text": f"{type(e).__name__}: {e}", "is_error": True}], "error"
                out += [{"instance_id": task["instance_id"], "seq": i, "status": status} | m for i, m in enumerate(made)]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    return tasks.mapInPandas(run, EVENTS)


def scripted(task: dict) -> list[dict]:
    """Greps the first word of the statement, then reports the file that the task names."""
    word = task["problem_statement"].split()[0]
    steps = [("grep", {"pattern": word}), ("localization_finish", {"locations": [{"file": task["file"]}]})]
    out: list[dict] = []
    for i, (tool, action) in enumerate(steps):
        call = {"tool_name": tool, "tool_call_id": f"c{i}", "llm_response_id": f"r{i}"}
        out += [call | {"kind": "ActionEvent", "action": json.dumps(action)}, call | {"kind": "ObservationEvent", "text": "", "is_error": False}]
    return out
