"""Token masks of multi-turn trajectories, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_error(turns: Column) -> Column:
    """Why turns array<struct<prompt, response>> can't be merged, else null; the first reason in turn order by kind."""
    last = F.element_at(turns, -1)
    merged = F.concat(last["prompt"], last["response"])
    first = F.element_at(turns, 1)["prompt"]
    prefix = lambda part, at: F.slice(merged, at + 1, F.size(part)) == part
    indexed = F.transform(turns, lambda t, i: F.struct(t["prompt"].alias("p"), t["response"].alias("r"), i.alias("i")))
    ends = lambda i: F.when(i == 0, F.size(first)).otherwise(F.size(F.get(turns, i - 1)["prompt"]) + F.size(F.get(turns, i - 1)["response"]))
    # Spark's slice needs a length of at least 0 and gives what is there.
    return (
        F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, F.lit("no_turns"))
        .when(F.size(first) == 0, F.lit("empty_prompt"))
        .when(F.exists(indexed, lambda t: F.exists(F.concat(t["p"], t["r"]), lambda x: x.isNull() | (x < 0))), F.lit("invalid_token"))
        .when(F.exists(indexed, lambda t: ~prefix(t["p"], F.lit(0))) | ~prefix(first, F.lit(0)), F.lit("does_not_extend"))
        .when(F.exists(indexed, lambda t: (F.size(t["r"]) == 0) | (F.size(t["p"]) < ends(t["i"]))), F.lit("empty_or_out_of_order"))
        .when(F.exists(indexed, lambda t: ~prefix(t["r"], F.size(t["p"]))), F.lit("response_not_preserved"))
    )


def merged(turns: Column) -> Column:
    """struct(prompt, response, loss_mask) of turns without mask_error: 1 on what the assistant wrote."""
    last, first = F.element_at(turns, -1), F.element_at(turns, 1)["prompt"]
    response = F.slice(F.concat(last["prompt"], last["response"]), F.size(first) + 1, F.size(last["prompt"]) + F.size(last["response"]) - F.size(first))
    spans = F.transform(turns, lambda t: F.struct((F.size(t["prompt"]) - F.size(first)).alias("a"), (F.size(t["prompt"]) - F.size(first) + F.size(t["response"])).alias("b")))
    mask = F.transform(response, lambda _, i: F.exists(spans, lambda s: (i >= s["a"]) & (i < s["b"])).cast("long"))
    return F.struct(first.alias("prompt"), response.alias("response"), mask.alias("loss_mask"))


def rollout(prompt: Column, response: Column, mask: Column, located: Column, exhausted: Column, failed: Column, reward: Column, limit: int, eos: int = 0) -> Column:
    """A training row from a finished run: struct(prompt, response, loss_mask, stop_reason, reward)."""
    room = F.greatest(F.lit(0), F.lit(limit) - F.size(prompt))
    truncated = F.size(response) > room
    stop = located & ~failed & ~truncated
    short = F.slice(response, 1, room)
    kept = F.transform(F.slice(mask, 1, room), lambda x: F.when(stop & ~exhausted, x).otherwise(F.lit(0).cast("long")))
    empty = ~stop & (F.size(short) == 0)
    eos_row = F.array(F.lit(eos).cast("long"))
    return F.struct(
        F.when(empty, F.slice(prompt, 1, F.lit(max(1, limit - 1)))).otherwise(prompt).alias("prompt"),
        F.when(empty, eos_row).otherwise(short).alias("response"),
        F.when(empty, F.array(F.lit(0).cast("long"))).otherwise(kept).alias("loss_mask"),
        F.when(stop, F.lit("stop")).when(exhausted | truncated, F.lit("length")).otherwise(F.lit("error")).alias("stop_reason"),
        F.when(stop, reward).otherwise(F.lit(0.0)).alias("reward"),
    )
