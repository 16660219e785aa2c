"""Trajectory events: tool metrics and validation, on a long table.

Columns: traj, seq, kind (ActionEvent, ObservationEvent, TokenEvent, AgentErrorEvent,
ConversationErrorEvent), tool_name, tool_call_id, llm_response_id, pattern, path,
include, start_line, end_line, text_chars, is_error, truncated, response_tokens.
Everything is summed per trajectory with partial aggregation; repeated searches and
overlapping lines are counts less distinct counts, so no events are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalized
from ..functions.scoring import tool_cost

EXCESS_CHARS, MOST_LINES = 8000, 500
FINISH = "localization_finish"
TOOLS = ("glob", "grep", "read_file", FINISH)


def search_key() -> Column:
    path = normalized(F.when(F.coalesce("path", F.lit("")) == "", F.lit(".")).otherwise(F.col("path")))
    include = F.when((F.col("tool_name") == "grep") & (F.col("include") != ""), F.col("include"))
    return F.to_json(F.struct("tool_name", "pattern", path.alias("path"), include.alias("include")))


def tool_metrics(events: DataFrame) -> DataFrame:
    """One row a trajectory: counts, overlap ratio and tool cost, all doubles."""
    kind = F.col("kind")
    action, observation = kind == "ActionEvent", kind == "ObservationEvent"
    search = action & F.col("tool_name").isin("glob", "grep")
    shown = observation & (F.coalesce("tool_name", F.lit("")) != FINISH)
    failed = F.coalesce("is_error", F.lit(False))
    read = observation & (F.col("tool_name") == "read_file") & ~failed
    span = F.col("end_line") - F.col("start_line") + 1
    sound = F.coalesce(F.col("path").isNotNull() & span.between(0, MOST_LINES), F.lit(False))
    count = lambda c: F.count_if(c).cast("double")
    chars = F.when(shown, F.coalesce("text_chars", F.lit(0))).otherwise(F.lit(0))
    base = events.groupBy("traj").agg(
        count(action).alias("num_tool_calls"),
        count(search).alias("search_calls"),
        count(action & (F.col("tool_name") == "read_file")).alias("read_calls"),
        (F.count_if(search) - F.count_distinct(F.when(search, search_key()))).cast("double").alias("repeated_searches"),
        F.sum(F.when(read & sound, span).otherwise(F.lit(0))).cast("double").alias("read_lines"),
        F.sum(chars).cast("double").alias("output_chars"),
        F.sum(F.greatest(F.lit(0), chars - EXCESS_CHARS)).cast("double").alias("excess_output_chars"),
        count(observation & F.coalesce("truncated", F.lit(False))).alias("truncated_outputs"),
        (F.count_if(observation & failed) + F.count_if(read & ~sound)).cast("double").alias("tool_errors"),
        F.sum(F.when(kind == "TokenEvent", F.coalesce("response_tokens", F.lit(0))).otherwise(F.lit(0))).cast("double").alias("completion_tokens"),
        count(kind == "TokenEvent").alias("num_turns"),
    )
    lines = events.where(read & sound & (span > 0)).select("traj", normalized(F.col("path")).alias("path"), F.explode(F.sequence("start_line", "end_line")).alias("line"))
    seen = lines.distinct().groupBy("traj").agg(F.count("*").cast("double").alias("_lines"))
    out = base.join(seen, "traj", "left").withColumn("overlap_lines", F.col("read_lines") - F.coalesce("_lines", F.lit(0.0))).drop("_lines")
    out = out.withColumn("overlap_ratio", F.col("overlap_lines") / F.greatest(F.lit(1.0), F.col("read_lines")))
    return out.withColumn("tool_efficiency_cost", tool_cost(*(F.col(c) for c in ("num_tool_calls", "repeated_searches", "overlap_ratio", "output_chars", "excess_output_chars", "truncated_outputs"))))


def pairing(events: DataFrame) -> DataFrame:
    """Each action with its code: unpaired_action, else tool_error, else observation_mismatch, else null."""
    actions = events.where("kind = 'ActionEvent'").select("traj", "tool_call_id", F.col("seq").alias("action_seq"), F.col("tool_name").alias("action_tool"))
    seen = events.where("kind = 'ObservationEvent'").groupBy("traj", "tool_call_id").agg(
        F.count("*").alias("n"), F.max(F.coalesce("is_error", F.lit(False))).alias("failed"), F.min("seq").alias("seq"), F.min("tool_name").alias("tool")
    )
    code = (
        F.when(F.coalesce("n", F.lit(0)) != 1, "unpaired_action")
        .when(F.col("failed"), "tool_error")
        .when(~F.col("tool").eqNullSafe(F.col("action_tool")) | (F.col("seq") <= F.col("action_seq")), "observation_mismatch")
    )
    return actions.join(seen, ["traj", "tool_call_id"], "left").select("traj", "tool_call_id", "action_seq", "action_tool", code.alias("code"))


def orphans(events: DataFrame) -> DataFrame:
    """Observations without an action."""
    actions = events.where("kind = 'ActionEvent'").select("traj", "tool_call_id").distinct()
    return events.where("kind = 'ObservationEvent'").join(actions, ["traj", "tool_call_id"], "left_anti").select("traj", "seq", "tool_call_id")


def finishes(events: DataFrame) -> DataFrame:
    """Each trajectory with finish actions, and whether the only finish is the last call and alone in its response."""
    actions = events.where("kind = 'ActionEvent'")
    mates = Window.partitionBy("traj", "llm_response_id")
    whole = Window.partitionBy("traj")
    told = actions.select("traj", "seq", "tool_name", F.count("*").over(mates).alias("mates"), F.max("seq").over(whole).alias("last"))
    finish = F.col("tool_name") == FINISH
    return told.groupBy("traj").agg(F.count_if(finish).alias("n_finish"), F.max(finish & (F.col("mates") == 1) & (F.col("seq") == F.col("last"))).alias("sole_final"))


def validate(events: DataFrame) -> DataFrame:
    """(traj, codes): the sorted distinct codes of each trajectory; a code that ends validation stands alone.

    Optional columns: action_valid (whether an action fits its tool's schema) and
    n_locations (of a finish). An event goes to its call's group, an action to its
    response's too; one aggregation sums these groups up and a second one trajectories,
    so the events are read once and no group is collected.
    """
    action, observation = F.col("kind") == "ActionEvent", F.col("kind") == "ObservationEvent"
    has = lambda c, default: F.coalesce(F.col(c), default) if c in events.columns else default
    finish = action & (F.col("tool_name") == FINISH)
    # Rows are sorted by group: of an event they have what the sums need, its facts as bits of one number.
    facts = {
        "action": action,
        "seen": observation,
        "failed": observation & F.col("is_error"),
        "finish": finish,
        "empty": finish & (has("n_locations", F.lit(1)) == 0),
        "odd": action & ~(F.coalesce(F.col("tool_name").isin(*TOOLS), F.lit(False)) & has("action_valid", F.lit(True))),
        "no_kind": F.col("kind").isNull(),
        "no_observation": observation & F.col("text_chars").isNull() & F.col("is_error").isNull(),
        "agent": F.col("kind").isin("AgentErrorEvent", "ConversationErrorEvent"),
    }
    bits = {name: 1 << i for i, name in enumerate(facts)}
    told = F.when(action | observation, F.col("tool_name"))
    key = lambda of_call, c: F.struct(F.lit(of_call).alias("of_call"), c.cast("string").alias("key"), (told if of_call else F.lit(None).cast("string")).alias("tool_name"))
    call = key(True, F.when(action | observation, F.col("tool_call_id")))
    keys = F.when(action, F.array(call, key(False, F.col("llm_response_id")))).otherwise(F.array(call))
    flags = sum((F.when(c, bits[name]).otherwise(0) for name, c in facts.items()), F.lit(0))
    each = events.select("traj", "seq", flags.alias("_f"), F.explode(keys).alias("_k")).select("traj", "seq", "_f", "_k.*")
    fact = lambda name: F.col("_f").bitwiseAND(bits[name]) > 0
    calls = each.groupBy("traj", "of_call", "key").agg(
        F.count_if(fact("action")).alias("actions"),
        F.count_if(fact("seen")).alias("seen"),
        F.max(fact("failed")).alias("failed"),
        F.min(F.when(fact("seen"), F.struct("seq", "tool_name"))).alias("o"),
        F.max(F.when(fact("action"), F.struct("seq", "tool_name"))).alias("a"),
        F.count_if(fact("finish")).alias("finishes"),
        F.max(F.when(fact("finish"), F.col("seq"))).alias("finish_at"),
        *(F.count_if(fact(x)).alias(x) for x in ("empty", "odd", "no_kind", "no_observation", "agent")),
    )
    of_call, blank = F.col("of_call"), F.coalesce("key", F.lit("")) == ""
    pair = (
        F.when(F.col("actions") == 0, F.when(F.col("seen") > 0, "orphan_observation"))
        .when(F.col("seen") != 1, "unpaired_action")
        .when(F.col("failed"), "tool_error")
        .when(~F.col("o.tool_name").eqNullSafe(F.col("a.tool_name")) | (F.col("o.seq") <= F.col("a.seq")), "observation_mismatch")
    )
    count = lambda c: F.sum(F.when(of_call, F.col(c)))
    told = calls.groupBy("traj").agg(
        F.when(count("no_kind") > 0, "invalid_events").when(count("no_observation") > 0, "invalid_observation").when(F.max(of_call & (F.col("actions") > F.when(blank, 0).otherwise(1))), "invalid_tool_call_ids").alias("early"),
        F.collect_set(F.when(of_call, pair)).alias("pairs"),
        F.when(count("agent") > 0, "agent_error").alias("agent"),
        F.when(count("odd") > 0, "invalid_action").alias("odd"),
        F.when(count("finishes") != 1, "missing_or_multiple_finish")
        .when((F.max(F.when(of_call, F.col("finish_at"))) != F.max(F.when(of_call, F.col("a.seq")))) | (F.max(F.when(~of_call & (F.col("finishes") > 0), F.col("actions"))) != 1), "finish_not_sole_final_call")
        .when(count("empty") > 0, "empty_finish")
        .alias("end"),
    )
    codes = F.array_sort(F.array_union("pairs", F.array_compact(F.array("agent", "odd", "end"))))
    return told.select("traj", F.when(F.col("early").isNotNull(), F.array("early")).otherwise(codes).alias("codes"))
