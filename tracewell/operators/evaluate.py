"""Evaluation: means, groups, downstream outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def means(rows: DataFrame, by: str | None = None) -> DataFrame:
    """The mean of every numeric column over the rows that have it; booleans aren't numbers here."""
    numeric = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "float", "double", "smallint", "tinyint") and c != by]
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in numeric), F.count("*").alias("tasks"))


def batch_means(rows: DataFrame) -> DataFrame:
    """As means, but booleans count as 0 and 1."""
    flags = [c for c, kind in rows.dtypes if kind == "boolean"]
    return means(rows.withColumns({c: F.col(c).cast("double") for c in flags}) if flags else rows)


def outcome_rows(tasks: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """evaluated outcomes, and missing_ids and unmatched_ids in order, of (instance_id) and (instance_id, resolved, source)."""
    ids, known = tasks.select("instance_id"), outcomes.select("instance_id")
    return {
        "evaluated": outcomes.join(ids, "instance_id", "left_semi"),
        "missing_ids": ids.join(known, "instance_id", "left_anti").orderBy("instance_id"),
        "unmatched_ids": known.join(ids, "instance_id", "left_anti").orderBy("instance_id"),
    }


def unique_or_raise(rows: DataFrame, key: str, what: str) -> DataFrame:
    """rows, but evaluating it fails if a key repeats."""
    repeated = F.count("*").alias("_n")
    bad = rows.groupBy(key).agg(repeated).where("_n > 1").agg(F.count("*").alias("_bad"))
    checked = bad.select(F.when(F.col("_bad") > 0, F.raise_error(F.lit(f"duplicate {what}"))).otherwise(F.lit(True)).alias("_ok"))
    return rows.join(F.broadcast(checked), F.col("_ok")).drop("_ok")


def known_or_raise(rows: DataFrame, tasks: DataFrame, key: str = "instance_id", what: str = "evaluation task") -> DataFrame:
    """rows, but evaluating it fails if a key is null or not among those of tasks; the message names the least one."""
    strange = rows.join(tasks.select(key), key, "left_anti").agg(F.min(F.col(key).cast("string")).alias("_id"), F.count("*").alias("_n"))
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce("_id", F.lit("null")))
    checked = strange.select(F.when(F.col("_n") > 0, F.raise_error(message)).otherwise(F.lit(True)).alias("_ok"))
    return rows.join(F.broadcast(checked), F.col("_ok")).drop("_ok")


def resolve_rates(evaluated: DataFrame) -> DataFrame:
    """(source, evaluated, resolved, resolve_rate)"""
    n, good = F.count("*"), F.count_if("resolved")
    return evaluated.groupBy(F.coalesce("source", F.lit("coding_agent")).alias("source")).agg(n.alias("evaluated"), good.alias("resolved"), F.try_divide(good.cast("double"), n.cast("double")).alias("resolve_rate"))


def judged(verdicts: DataFrame) -> DataFrame:
    """Of (relevance, sufficiency): how many are sound, how many failed, and the mean relevance of the sound ones."""
    sound = F.coalesce(F.col("relevance").between(0, 1) & F.col("sufficiency").between(0, 1), F.lit(False))
    return verdicts.agg(F.count_if(sound).alias("evaluated"), F.count_if(~sound).alias("failed"), F.avg(F.when(sound, F.col("relevance"))).alias("mean_relevance"))


def token_totals(turns: DataFrame) -> DataFrame:
    """(traj, prompt_tokens, max_prompt_tokens) of (traj, prompt_tokens)."""
    return turns.groupBy("traj").agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.max("prompt_tokens"), F.lit(0)).alias("max_prompt_tokens"))


ISSUE_CHARS, ACTIONS_SHOWN = 12_000, 40


def judge_payloads(tasks: DataFrame, runs: DataFrame, actions: DataFrame) -> DataFrame:
    """(traj, payload) for a judge, as JSON: the first characters of the issue, locations, target and the first actions.

    tasks: instance_id, problem_statement, file_changes; runs: traj, instance_id,
    structured_locations; actions: traj, seq, tool_name, action.
    """
    first = actions.withColumn("_i", F.row_number().over(Window.partitionBy("traj").orderBy("seq"))).where(F.col("_i") <= ACTIONS_SHOWN)
    shown = first.groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("tool_name", "action").alias("x")))).alias("xs")).select("traj", F.transform("xs", lambda x: x["x"]).alias("tool_actions"))
    rows = runs.join(tasks, "instance_id").join(shown, "traj", "left")
    said = F.struct(F.substring("problem_statement", 1, ISSUE_CHARS).alias("issue"), F.col("structured_locations").alias("locations"), F.col("file_changes").alias("target"), F.coalesce("tool_actions", F.expr("array()")).alias("tool_actions"))
    return rows.select("traj", F.to_json(said, {"ignoreNullFields": "false"}).alias("payload"))


def verdicts(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Adds relevance, sufficiency and explanation of a judge's JSON answers, and `error` where one isn't sound."""
    v = F.try_parse_json(text)
    number = lambda c: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) != "STRING", F.try_variant_get(v, f"$.{c}", "double"))
    said = F.try_variant_get(v, "$.explanation", "string")
    told = answers.withColumns({"relevance": number("relevance"), "sufficiency": number("sufficiency"), "explanation": said})
    sound = F.coalesce(F.col("relevance").between(0, 1) & F.col("sufficiency").between(0, 1) & F.length("explanation").between(1, 300), F.lit(False))
    return told.withColumn("error", F.when(~sound, "invalid_verdict"))
