"""Chat traces: the pending-call state, and agreement of calls with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_codes(messages: Column) -> Column:
    """Sorted distinct codes of array<struct<role, calls: array<string>, tool_call_id>>.

    Calls wait until a tool message answers them. A code that ends the check stands alone.
    """
    roles = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)))
    calls = F.flatten(F.transform(messages, lambda m: F.when(m["role"] == "assistant", F.coalesce(m["calls"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))
    bad_ids = F.exists(calls, lambda c: F.coalesce(c, F.lit("")) == "") | (F.size(F.array_distinct(calls)) != F.size(calls))
    none = F.array().cast("array<string>")

    def step(s: Column, m: Column) -> Column:
        own, tool = m["role"] == "assistant", m["role"] == "tool"
        answers = F.coalesce(F.array_contains(s["pending"], m["tool_call_id"]), F.lit(False))
        codes = F.when(own & (F.size(s["pending"]) > 0), F.array(F.lit("missing_tool_result"))).when(tool & ~answers, F.array(F.lit("orphan_chat_tool_result"))).otherwise(none)
        pending = F.when(own, F.concat(s["pending"], F.coalesce(m["calls"], none))).when(tool, F.filter(s["pending"], lambda p: ~p.eqNullSafe(m["tool_call_id"]))).otherwise(s["pending"])
        return F.struct(pending.alias("pending"), F.concat(s["codes"], codes).alias("codes"))

    end = F.aggregate(messages, F.struct(none.alias("pending"), none.alias("codes")), step)
    open_ = F.when((F.size(end["pending"]) > 0) | (F.size(calls) == 0), F.array(F.lit("incomplete_chat_trace"))).otherwise(none)
    return F.when(roles, F.array(F.lit("invalid_chat_role"))).when(bad_ids, F.array(F.lit("invalid_chat_tool_ids"))).otherwise(F.array_sort(F.array_distinct(F.concat(end["codes"], open_))))


def calls_agree(calls: DataFrame, actions: DataFrame) -> DataFrame:
    """(traj, codes) of chat calls (traj, pos, id, name, arguments) against action events (traj, pos, id, tool_name, action): same ids in order, then each call's name and non-null arguments.

    arguments and action: map<string,string> of canonical JSON values.
    """
    known = lambda m: F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(m, lambda k, x: x.isNotNull() & (k != "kind")))))
    c = calls.select("traj", "pos", F.col("id").alias("c"), F.col("name").alias("cn"), F.to_json(known(F.col("arguments"))).alias("ca"))
    a = actions.select("traj", "pos", F.col("id").alias("a"), F.col("tool_name").alias("an"), F.to_json(known(F.col("action"))).alias("aa"))
    both = c.join(a, ["traj", "pos"], "full")
    told = both.groupBy("traj").agg(
        F.max(~F.col("c").eqNullSafe(F.col("a"))).alias("ids"),
        F.max(~F.col("cn").eqNullSafe(F.col("an")) | ((F.col("cn") != "localization_finish") & ~F.col("ca").eqNullSafe(F.col("aa")))).alias("args"),
    )
    return told.select("traj", F.when(F.col("ids"), F.array(F.lit("chat_event_mismatch"))).when(F.col("args"), F.array(F.lit("chat_action_mismatch"))).otherwise(F.array().cast("array<string>")).alias("codes"))


def final_turn_codes(calls: DataFrame, locations: DataFrame) -> DataFrame:
    """(traj, code): the last assistant turn must be one finish call, with the run's locations.

    calls: (traj, turn, name, locations) of all assistant turns; locations: (traj, locations), both arrays of structs.
    """
    last = calls.groupBy("traj").agg(F.max("turn").alias("turn"))
    final = calls.join(last, ["traj", "turn"]).groupBy("traj").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.first("locations", ignorenulls=True).alias("said"))
    told = final.join(locations, "traj", "left")
    return told.select("traj", F.when((F.col("n") != 1) | (F.col("name") != "localization_finish"), "invalid_final_chat_turn").when(~F.col("said").eqNullSafe(F.col("locations")), "chat_finish_mismatch").alias("code"))
