"""Task rows from raw patches: eligibility, labels, and the nine columns of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import diffs, symbols, tasks

TASK_COLUMNS = ("instance_id", "file_changes", "repo", "base_commit", "problem_statement", "patch", "target", "prompt", "use_patch")
EXAMPLES = 20


def task_rows(raw: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, skipped): the nine columns of each task, and (instance_id, reason) of what can't become one.

    raw: (instance_id, repo, patch, problem_statement); sources: (repo, path, text).
    """
    tasks._checkpoints(raw.sparkSession)
    parsed = diffs.parse(raw).join(raw.select("instance_id", "problem_statement"), "instance_id")
    told = parsed.select("instance_id", diffs.eligibility(F.col("problem_statement"), F.col("error"), F.col("lines")).alias("reason")).checkpoint()
    good = raw.join(told.where("reason IS NULL"), "instance_id", "left_semi").checkpoint()
    labels = symbols.change_labels(good.select("instance_id", "repo", "patch"), sources).checkpoint()
    reason = F.when(F.col("error").isNull(), None).otherwise(F.regexp_extract("error", r"^(\w+)", 1))
    rows = good.join(labels.where("error IS NULL").drop("error"), "instance_id").select(
        "instance_id", "file_changes", "repo", F.lit(None).cast("string").alias("base_commit"), "problem_statement", "patch",
        F.col("file_changes").alias("target"), F.array(F.struct(F.col("problem_statement").alias("content"), F.lit("user").alias("role"))).alias("prompt"), F.lit(True).alias("use_patch"),
    )
    return rows, told.where("reason IS NOT NULL").unionByName(labels.where("error IS NOT NULL").select("instance_id", reason.alias("reason")))


def report(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """(reason, n, examples) of what was kept and skipped; the first EXAMPLES ids of each reason, in their order."""
    told = skipped.unionByName(rows.select("instance_id", F.lit("kept").alias("reason")))
    counts = told.groupBy("reason").agg(F.count("*").alias("n"))
    ranked = told.where("reason <> 'kept'").withColumn("i", F.row_number().over(Window.partitionBy("reason").orderBy("instance_id"))).where(F.col("i") <= EXAMPLES)
    first = ranked.groupBy("reason").agg(F.array_sort(F.collect_list("instance_id")).alias("examples"))
    return counts.join(first, "reason", "left")
