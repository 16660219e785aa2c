"""Export of validated trajectories: quality and cost filter, sequence deduplication, nested Parquet by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalized
from .tasks import hash_split

SFT_COLUMNS = ("instance_id", "difficulty", "messages", "tools", "input_ids", "loss_mask")


def rejections(quality: Column, cost: Column, least_quality: float = 0.5, most_cost: float = 3.0) -> Column:
    """The reasons to leave a trajectory out; both may hold."""
    if not 0 <= least_quality <= 3 or most_cost < 0:
        raise ValueError("quality must be in [0, 3] and cost at least 0")
    return F.array_compact(F.array(F.when(quality < least_quality, "low_quality"), F.when(cost > most_cost, "high_cost")))


def first_of_sequence(rows: DataFrame, order: str, key: str) -> DataFrame:
    """The first row, in order, of each key: a partial aggregate, so a frequent key is no hot partition."""
    least = rows.groupBy(F.sha2(F.col(key), 256).alias("_h")).agg(F.min(order).alias(order))
    return rows.join(least.select(order), order, "left_semi")


def action_steps(log: DataFrame) -> DataFrame:
    """(traj, steps) of every trajectory of an event log: all its actions in order, as JSON; without actions `[]`.

    Call ids and responses differ between equal runs and are left out.
    """
    fields = ("tool_name", "pattern", "path", "include", "start_line", "end_line")
    step = F.struct(*((normalized(F.col(c)) if c == "path" else F.col(c)).alias(c) for c in fields))
    done = F.array_sort(F.collect_list(F.when(F.col("kind") == "ActionEvent", F.struct("seq", step.alias("x")))))
    return log.groupBy("traj").agg(done.alias("s")).select("traj", F.to_json(F.transform("s", lambda r: r["x"])).alias("steps"))


def exported(tasks: DataFrame, trajectories: DataFrame, validation: float = 0.1, least_quality: float = 0.5, most_cost: float = 3.0) -> dict[str, DataFrame]:
    """sft and rl rows with their split, and rejected (traj, reasons).

    tasks: instance_id, repo, task_key, difficulty and more; trajectories: traj (its
    order), instance_id, codes, quality, cost, steps, messages, tools, input_ids, loss_mask.
    """
    known = trajectories.join(tasks.select("instance_id", "repo", "task_key", "difficulty"), "instance_id", "left")
    reasons = F.when(F.col("task_key").isNull(), F.array(F.lit("unknown_task"))).when(F.size("codes") > 0, F.col("codes")).otherwise(rejections(F.col("quality"), F.col("cost"), least_quality, most_cost))
    told = known.withColumn("reasons", reasons)
    good = told.where("size(reasons) = 0").withColumn("_key", F.concat_ws("\x1f", "task_key", "steps"))
    kept = first_of_sequence(good, "traj", "_key").withColumn("split", hash_split(F.col("repo"), validation))
    repeated = good.join(kept.select("traj"), "traj", "left_anti").select("traj", F.array(F.lit("duplicate_sequence")).alias("reasons"))
    rl = tasks.join(kept.select("instance_id").distinct(), "instance_id", "left_semi").withColumn("split", hash_split(F.col("repo"), validation)).drop("task_key")
    return {"sft": kept.select(*SFT_COLUMNS, "split"), "rl": rl, "rejected": told.where("size(reasons) > 0").select("traj", "reasons").unionByName(repeated)}


def write(parts: dict[str, DataFrame], path: str) -> None:
    """Four Parquet data sets, empty ones too; path must not exist."""
    for kind in ("sft", "rl"):
        for split in ("train", "validation"):
            parts[kind].where(F.col("split") == split).drop("split").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{kind}/{split}")
    parts["rejected"].write.mode("errorifexists").json(f"{path}/rejected")


def write_traces(runs: DataFrame, path: str, key: str = "traj") -> None:
    """A folder of JSON for each run."""
    runs.withColumn("_run", F.col(key).cast("string")).write.mode("errorifexists").partitionBy("_run").json(path)
