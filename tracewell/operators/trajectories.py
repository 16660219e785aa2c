"""Whole trajectories: the codes of events, tokens, chat and their agreement, in one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from . import events, schemas

#: What a run's messages look like; arguments are JSON text.
CHAT = "array<struct<role:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"


def terminal_code(chat: Column) -> Column:
    """The code that ends the check of a chat (see CHAT), else null: the first in the order of messages and calls."""
    calls = lambda m: F.when(m["role"] == "assistant", F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>"))).otherwise(F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>"))
    ids = F.flatten(F.transform(chat, lambda m: F.transform(calls(m), lambda c: F.coalesce(c["id"], F.lit("")))))
    number = F.transform(chat, lambda m, i: F.aggregate(F.slice(chat, 1, i), F.lit(0), lambda n, x: n + F.size(calls(x))))

    def of_call(c: Column, at: Column) -> Column:
        known = F.array_position(ids, c["id"]) < at + 1
        return F.when(c.isNull() | c["function"].isNull(), "invalid_chat_tool_calls").when(F.coalesce(c["id"], F.lit("")) == "", "invalid_chat_tool_ids").when(known, "invalid_chat_tool_ids")

    role = lambda m: F.when(~F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)), "invalid_chat_role")
    found = F.flatten(F.transform(chat, lambda m, i: F.concat(F.array(role(m)), F.transform(calls(m), lambda c, j: of_call(c, F.get(number, i) + j)))))
    return F.when(chat.isNull() | F.exists(chat, lambda m: m.isNull()), "invalid_chat_trace").otherwise(F.get(F.array_compact(found), F.lit(0)))


def _chat_state(chat: Column) -> Column:
    """Codes of calls that wait for their results."""
    none = F.array().cast("array<string>")
    own_ids = lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["id"]), none)

    def step(s: Column, m: Column) -> Column:
        own, tool = m["role"] == "assistant", m["role"] == "tool"
        answers = F.coalesce(F.array_contains(s["pending"], m["tool_call_id"]), F.lit(False))
        code = F.when(own & (F.size(s["pending"]) > 0), F.array(F.lit("missing_tool_result"))).when(tool & ~answers, F.array(F.lit("orphan_chat_tool_result"))).otherwise(none)
        pending = F.when(own, F.concat(s["pending"], own_ids(m))).when(tool, F.filter(s["pending"], lambda p: ~p.eqNullSafe(m["tool_call_id"]))).otherwise(s["pending"])
        return F.struct(pending.alias("pending"), F.concat(s["codes"], code).alias("codes"))

    end = F.aggregate(chat, F.struct(none.alias("pending"), none.alias("codes")), step)
    return F.concat(end["codes"], F.when(F.size(end["pending"]) > 0, F.array(F.lit("incomplete_chat_trace"))).otherwise(none))


def _arguments(text: Column) -> Column:
    """The non-null fields of a JSON object in canonical order, null if it isn't one."""
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return known_fields(fields)


def known_fields(fields: Column) -> Column:
    """A map of VARIANT values as sorted (key, JSON) pairs, without nulls and `kind`."""
    told = F.map_filter(fields, lambda k, x: (k != "kind") & (F.schema_of_variant(x) != "VOID"))
    return F.array_sort(F.transform(F.map_entries(told), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))


def validate(runs: DataFrame, log: DataFrame) -> DataFrame:
    """(traj, codes) of runs: all checks on events (see events.validate), outcome, tokens and chat; empty codes mean a sound run.

    runs: traj, status string, errors array<string>, structured_locations
    array<struct<file, class_name, function_name>>, turns array<struct<prompt: array<long>, response: array<long>>>
    (its token events), chat (see CHAT), n_tools int. log: the runs' events, with
    `action`, a VARIANT, in place of action_valid and n_locations.
    """
    log = log.withColumns({"action_valid": schemas.action_valid(F.col("tool_name"), F.col("action")), "n_locations": F.coalesce(F.size(schemas.locations(F.col("action"))), F.lit(0))})
    of_events = events.validate(log).select("traj", F.col("codes").alias("event_codes"))
    called = F.col("kind") == "ActionEvent"
    step = F.struct("seq", F.col("tool_call_id").alias("id"), F.col("tool_name").alias("name"), known_fields(F.try_variant_get("action", "$", "map<string,variant>")).alias("fields"))
    # A run's actions, of which there are as many as it made calls; they are compared with its chat, a row too.
    done = log.groupBy("traj").agg(F.array_sort(F.collect_list(F.when(called, step))).alias("actions"), F.max(F.when(called & (F.col("tool_name") == events.FINISH), F.struct("seq", schemas.locations(F.col("action")).alias("l"))))["l"].alias("found"))
    rows = runs.join(of_events, "traj", "left").join(done, "traj", "left")
    chat = F.col("chat")
    own = F.filter(chat, lambda m: m["role"] == "assistant")
    calls = F.flatten(F.transform(own, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>"))))
    calls = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), _arguments(c["function"]["arguments"]).alias("fields"), c["function"]["arguments"].alias("raw")))
    some = lambda c, code: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    ids = lambda a: F.transform(a, lambda x: x["id"])
    rows = rows.withColumns({"calls": calls, "event_codes": F.coalesce("event_codes", F.array(F.lit("missing_or_multiple_finish")))})
    first = F.concat(
        some((F.coalesce(F.size("errors"), F.lit(0)) > 0) | ~F.coalesce(F.col("status").isin("ok", "stop"), F.lit(False)), "failed_run"),
        some(~F.col("found").eqNullSafe(F.col("structured_locations")), "finish_payload_mismatch"),
        some(tokens.mask_error(F.col("turns")).isNotNull() | F.col("turns").isNull(), "invalid_token_trace"),
        some(F.exists("calls", lambda c: c["fields"].isNull() | c["name"].isNull()), "invalid_tool_arguments"),
        _chat_state(chat),
        some((F.size("calls") == 0) | (F.coalesce(F.col("n_tools"), F.lit(0)) == 0), "incomplete_chat_trace"),
        some(~ids(F.col("calls")).eqNullSafe(ids(F.col("actions"))), "chat_event_mismatch"),
    )
    rows = rows.withColumns({"first": first, "end": terminal_code(chat)})
    differs = F.exists(F.arrays_zip("calls", "actions"), lambda p: ~p["calls"]["name"].eqNullSafe(p["actions"]["name"]) | ((p["actions"]["name"] != events.FINISH) & ~p["calls"]["fields"].eqNullSafe(p["actions"]["fields"])))
    sound = F.size("first") == 0
    second = F.concat(F.col("first"), some(sound & differs, "chat_action_mismatch"))
    final = F.coalesce(F.try_element_at(own, F.lit(-1))["tool_calls"], F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>"))
    wrong_end = (F.size(own) == 0) | (F.size(final) != 1) | ~F.coalesce(F.get(final, F.lit(0))["function"]["name"] == events.FINISH, F.lit(False))
    said = schemas.locations(F.try_parse_json(F.try_element_at("calls", F.lit(-1))["raw"]))
    rows = rows.withColumn("second", second).withColumn("wrong_end", wrong_end)
    third = F.when(F.col("wrong_end"), F.concat("second", F.array(F.lit("invalid_final_chat_turn")))).when((F.size("second") == 0) & ~said.eqNullSafe(F.col("found")), F.array(F.lit("chat_finish_mismatch"))).otherwise(F.col("second"))
    codes = F.when(F.size("event_codes") > 0, F.col("event_codes")).when(F.col("end").isNotNull(), F.array("end")).otherwise(F.array_sort(F.array_distinct(third)))
    return rows.select("traj", codes.alias("codes"))
