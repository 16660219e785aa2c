"""Tasks: ordered validation, difficulty, keep-first deduplication on two keys, splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import path_error, stripped
from ..functions.text import task_key
from . import diffs

DETAIL_KEYS = ("added_entities", "added_modules", "edited_entities", "edited_modules")


def difficulty(files: Column, symbols: Column) -> Column:
    """From the numbers of changed files and of distinct changed entities."""
    return F.when((files == 1) & (symbols <= 1), "easy").when((files <= 3) & (symbols <= 5), "medium").otherwise("hard")


def difficulty_of(file_changes: Column) -> Column:
    none = F.array().cast("array<string>")
    symbols = F.array_distinct(F.flatten(F.transform(file_changes, lambda c: F.concat(F.coalesce(c["changes"]["edited_entities"], none), F.coalesce(c["changes"]["added_entities"], none)))))
    return difficulty(F.size(file_changes), F.size(symbols))


def from_variant(rows: DataFrame, v: str = "v") -> DataFrame:
    """Adds typed columns to rows with a task as a VARIANT, and what its types break.

    Columns: is_task, instance_id, repo, problem_statement, base_commit, patch, use_patch,
    use_patch_typed, file_changes, shape_errors (one for each change, null if it is sound).
    Text that isn't a string counts as missing.
    """
    at = lambda path, kind: F.try_variant_get(F.col(v), path, kind)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    text = lambda c: F.when(kind(at(f"$.{c}", "variant")) == "STRING", at(f"$.{c}", "string"))
    fields = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    details = lambda c: F.try_variant_get(c, "$.changes", "variant")
    listed = lambda x: F.try_variant_get(x, "$", "array<variant>")
    given = lambda c: kind(details(c)).startswith("OBJECT")
    empty = lambda c: kind(details(c)).isin("VOID") | (F.try_variant_get(details(c), "$", "string").isin("", "0", "false", "0.0")) | (F.size(listed(details(c))) == 0)

    def shape(c: Column) -> Column:
        values = F.map_values(fields(details(c)))
        odd = F.exists(values, lambda x: (kind(x) != "VOID") & listed(x).isNull())
        untyped = F.exists(values, lambda x: F.exists(F.coalesce(listed(x), F.array().cast("array<variant>")), lambda y: kind(y) != "STRING"))
        unknown = F.size(F.array_except(F.map_keys(fields(details(c))), F.array(*map(F.lit, DETAIL_KEYS)))) > 0
        return F.when(~given(c) & ~F.coalesce(empty(c), F.lit(False)), "invalid_target_details").when(given(c), F.when(unknown, "unknown_target_field").when(odd, "invalid_symbol_list").when(untyped, "invalid_symbol_target"))

    one = lambda c: F.struct(
        F.struct(*(F.try_variant_get(c, f"$.changes.{k}", "array<string>").alias(k) for k in DETAIL_KEYS)).alias("changes"), F.when(kind(F.try_variant_get(c, "$.file", "variant")) == "STRING", F.try_variant_get(c, "$.file", "string")).alias("file")
    )
    changes = at("$.file_changes", "array<variant>")
    patched = kind(at("$.use_patch", "variant"))
    return rows.withColumns(
        {
            "is_task": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
            **{c: text(c) for c in ("instance_id", "repo", "problem_statement", "base_commit", "patch")},
            "use_patch": F.when(patched == "BOOLEAN", at("$.use_patch", "boolean")),
            "use_patch_typed": at("$.use_patch", "variant").isNull() | (patched == "BOOLEAN"),
            "file_changes": F.transform(changes, one),
            "shape_errors": F.transform(changes, shape),
        }
    )


def with_patch_files(tasks: DataFrame, key: str) -> DataFrame:
    """Adds patch_files (paths), patch_moves_files and patch_error of the patches that tasks use."""
    parsed = diffs.parse(tasks.where("use_patch").select(key, "patch"), key)
    paths = F.array_distinct(F.transform(F.col("lines"), lambda x: x["path"]))
    moved = F.exists("lines", lambda x: x["is_added"] | x["is_removed"])
    told = parsed.select(F.col(key).alias("_k"), paths.alias("patch_files"), F.coalesce(moved, F.lit(False)).alias("patch_moves_files"), F.col("error").alias("patch_error"))
    return tasks.join(told, tasks[key].eqNullSafe(told["_k"]), "left").drop("_k")


def first_error(tasks: DataFrame) -> Column:
    """The first rule that a task breaks, in their fixed order, else null. Rules on columns that tasks lack are left out."""
    blank = lambda c: stripped(F.coalesce(F.col(c), F.lit(""))) == ""
    repo = F.col("repo")
    rules = [F.when(~F.col("is_task"), "invalid_task_object")] if "is_task" in tasks.columns else []
    rules += [F.when(blank(c), f"empty_{c}") for c in ("instance_id", "repo", "problem_statement")]
    rules.append(F.when(~repo.rlike(r"(?U)^[\w.-]+/[\w.-]+\z") | F.exists(F.split(repo, "/"), lambda p: p.isin(".", "..")), "invalid_repo"))
    rules.append(F.when(~F.col("instance_id").rlike(r"(?U)^[\w.-]+\z") | F.col("instance_id").isin(".", ".."), "invalid_instance_id"))
    if "base_commit" in tasks.columns:
        rules.append(F.when((F.coalesce("base_commit", F.lit("")) != "") & ~F.col("base_commit").rlike(r"^[0-9a-fA-F]{40}\z"), "base_commit_must_be_immutable"))
    if "use_patch_typed" in tasks.columns:
        rules.append(F.when(~F.col("use_patch_typed"), "use_patch_must_be_boolean"))
    if "file_changes" in tasks.columns:
        changes = F.col("file_changes")
        shape = (lambda i: [F.get(F.col("shape_errors"), i)]) if "shape_errors" in tasks.columns else lambda i: []
        rules.append(F.when(F.coalesce(F.size(changes), F.lit(0)) <= 0, "missing_targets"))
        per = F.transform(
            changes,
            lambda c, i: F.coalesce(
                F.when(c["file"].isNull(), "missing_file_key"),
                path_error(c["file"]),
                *shape(i),
                *(F.when(F.exists(F.coalesce(c["changes"][k], F.array().cast("array<string>")), lambda s: ~s.startswith(F.concat(c["file"], F.lit(":"))) | s.endswith(":")), "invalid_symbol_target") for k in DETAIL_KEYS),
            ),
        )
        rules.append(F.get(F.array_compact(per), F.lit(0)))
        rules.append(F.when(F.size(F.array_distinct(changes["file"])) != F.size(changes), "duplicate_target_file"))
    if {"use_patch", "patch_files", "patch_moves_files"} <= set(tasks.columns):
        rules.append(
            F.when(
                F.col("use_patch"),
                F.when(F.col("patch_error").isNotNull() if "patch_error" in tasks.columns else F.lit(False), "invalid_patch")
                .when((F.coalesce(F.size("patch_files"), F.lit(0)) <= 0) | F.col("patch_moves_files"), "invalid_mutation_patch").when(F.size(F.array_except(F.col("file_changes")["file"], "patch_files")) > 0, "target_patch_mismatch"),
            )
        )
    return F.coalesce(*rules, F.lit(None).cast("string"))


def greedy_two_keys(rows: DataFrame, order: str, first: str, second: str, fallback_rounds: int = 50) -> DataFrame:
    """Rows that keep-first deduplication on two keys keeps: in order, a row goes if a
    kept row has either of its keys, and a dropped row blocks nothing.

    Rounds: an undecided row that is first of both its key groups is kept; undecided
    rows that share a key with it are dropped. Every round settles the first row of
    every connected group at least. Only keys and order travel, and each round is cut
    off by a checkpoint in the shared folder. A null key clashes with no other key.
    `order` must be unique; rows are told apart by it.
    """
    _checkpoints(rows.sparkSession)
    own = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.concat(F.lit("o"), F.to_json(F.struct(order))))
    left = rows.select(F.col(order).alias("o"), own(first).alias("a"), own(second).alias("b")).checkpoint()
    if not left.groupBy("o").count().where("count > 1").isEmpty():
        raise ValueError(f"{order} isn't unique")
    kept = left.limit(0).select("o")
    i = 0
    while not left.isEmpty():
        lead = left.groupBy("a").agg(F.min("o").alias("fa"))
        lead_b = left.groupBy("b").agg(F.min("o").alias("fb"))
        won = left.join(lead, "a").join(lead_b, "b").where("o <=> fa AND o <=> fb").select("o", "a", "b").checkpoint()
        if won.isEmpty():
            raise RuntimeError("a round settled no row")
        kept = kept.unionByName(won.select("o"))
        left = left.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti").checkpoint()
        i += 1
        if i % fallback_rounds == 0:
            kept = kept.checkpoint()
    kept = kept.select(F.col("o").alias("_o"))
    return rows.join(kept, rows[order].eqNullSafe(kept["_o"]), "left_semi")


def _checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder where none is set; on a cluster it has to be a shared one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file:///tmp/tracewell-checkpoints")


def clean(tasks: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept tasks with stripped texts, task_key, and if they have targets difficulty, prompt and target; reason counts).

    Repositories and instance ids are judged and told apart without white space around them.
    """
    clear = tasks.withColumns({c: stripped(F.col(c)) for c in ("instance_id", "repo")})
    told = clear.withColumn("_reason", first_error(clear))
    col = lambda c, kind: F.col(c) if c in tasks.columns else F.lit(None).cast(kind)
    good = told.where("_reason IS NULL").drop("_reason").withColumn("task_key", task_key(F.col("repo"), col("base_commit", "string"), F.col("problem_statement"), col("patch", "string"), col("use_patch", "boolean")))
    kept = greedy_two_keys(good, order, "instance_id", "task_key")
    kept = kept.withColumns({c: stripped(F.col(c)) for c in ("instance_id", "repo", "problem_statement")})
    if "file_changes" in tasks.columns:
        prompt = F.array(F.struct(F.col("problem_statement").alias("content"), F.lit("user").alias("role")))
        kept = kept.withColumns({"difficulty": difficulty_of(F.col("file_changes")), "prompt": prompt, "target": F.col("file_changes")})
    bad = told.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).count()
    dup = good.select(order).join(kept.select(order), order, "left_anti").groupBy(F.lit("duplicate_task").alias("reason")).count()
    return kept, bad.unionByName(dup)


def hash_split(group: Column, fraction: float) -> Column:
    """`validation` for a share of groups by digest: the same for all of a group, on every run."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")
    share = F.conv(F.substring(F.sha2(F.concat(F.lit('"'), F.lower(group), F.lit('"')), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(share < fraction, "validation").otherwise("train")


def shuffled_split(rows: DataFrame, order: str, validation: int, seed: int) -> DataFrame:
    """Adds `split`: the last `validation` rows of a seeded shuffle of the row numbers.

    The permutation is drawn on the driver, for data sets of a size that such splits are
    made for; `sampled_split` is for larger ones.
    """
    n = rows.count()
    if not 0 <= validation < n:
        raise ValueError("validation must be at least 0 and less than the number of rows")
    if n > 10_000_000:
        raise ValueError("too many rows for a permutation on the driver; use sampled_split")
    numbers = list(range(n))
    random.Random(seed).shuffle(numbers)
    chosen = rows.sparkSession.createDataFrame([(i,) for i in numbers[n - validation :]], "_i long")
    ranked = rows.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    return ranked.join(chosen.withColumn("_v", F.lit(True)), "_i", "left").withColumn("split", F.when(F.col("_v"), "validation").otherwise("train")).drop("_i", "_v")


def sampled_split(rows: DataFrame, key: str, validation: int, seed: int) -> DataFrame:
    """Adds `split`: the `validation` rows of the least seeded digests, a bounded top-k and an id join."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    chosen = rows.select(F.col(key), digest.alias("_d")).orderBy("_d", key).limit(validation).select(F.col(key).alias("_k"))
    return rows.join(chosen.withColumn("_v", F.lit(True)), rows[key] == F.col("_k"), "left").withColumn("split", F.when(F.col("_v"), "validation").otherwise("train")).drop("_k", "_v")
