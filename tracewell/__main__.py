"""Command lines: python -m tracewell build | clean | evaluate | search."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import build, evaluate, search, tasks
from .sources import loaders


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewell")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="task rows from raw patches and a table of sources")
    b.add_argument("--input", required=True, help="a Parquet file, or a folder of them")
    b.add_argument("--sources", required=True, help="Parquet of repo, path, text")
    b.add_argument("--validation-size", type=int, default=100)
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--limit", type=int)
    b.add_argument("--keep-all", action="store_true")
    c = sub.add_parser("clean", help="sound tasks, each once")
    c.add_argument("--input", required=True, help="Parquet, JSON or JSON lines of tasks")
    e = sub.add_parser("evaluate", help="outcomes by source")
    e.add_argument("--tasks", required=True)
    e.add_argument("--outcomes", required=True)
    for x in (b, c, e):
        x.add_argument("--output", required=True)
    b.add_argument("--overwrite", action="store_true")
    s = sub.add_parser("search", help="lines of the files of a tree")
    s.add_argument("--tree", required=True)
    s.add_argument("--pattern", required=True)
    s.add_argument("--include")
    s.add_argument("--path")
    return top


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    if a.command == "build":
        loaders.guard(spark, a.output, a.overwrite)
        raw = loaders.shards(spark, a.input, limit=a.limit)
        rows, skipped = build.task_rows(raw.drop("ord"), spark.read.parquet(a.sources))
        rows.write.option("compression", "zstd").parquet(f"{a.output}/all.parquet")
        made = spark.read.parquet(f"{a.output}/all.parquet")
        split = tasks.shuffled_split(made, "instance_id", a.validation_size, a.seed)
        for name in ("train", "validation"):
            split.where(F.col("split") == name).drop("split").write.option("compression", "zstd").parquet(f"{a.output}/{name}.parquet")
        build.report(made.select("instance_id"), skipped).coalesce(1).write.json(f"{a.output}/cleaning_report.json")
        if not a.keep_all:
            loaders.remove(spark, f"{a.output}/all.parquet")
    elif a.command == "clean":
        rows = loaders.load(spark, a.input)
        typed = tasks.with_patch_files(tasks.from_variant(rows), "ord") if "v" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())
        kept, reasons = tasks.clean(typed, "ord")
        kept.drop("ord", "v", "is_task", "use_patch_typed", "shape_errors", "patch_files", "patch_moves_files", "patch_error").write.json(f"{a.output}/tasks.jsonl")
        reasons.coalesce(1).write.json(f"{a.output}/report.json")
    elif a.command == "evaluate":
        known = loaders.load(spark, a.tasks)
        ids = known.select(F.variant_get("v", "$.instance_id", "string").alias("instance_id")) if "v" in known.columns else known
        parts = evaluate.outcome_rows(ids, evaluate.unique_or_raise(loaders.outcomes(spark, a.outcomes), "instance_id", "outcome"))
        evaluate.resolve_rates(parts["evaluated"]).coalesce(1).write.json(f"{a.output}/resolve_rates.json")
        for name in ("missing_ids", "unmatched_ids"):
            parts[name].write.json(f"{a.output}/{name}.json")
    else:
        from .sources import tree

        tree.register(spark)
        files = spark.read.format("code_tree").load(a.tree).where("kind = 'file'").select("path", F.decode("content", "UTF-8").alias("text"))
        for r in search.grep_search(files, a.pattern, a.include, path=a.path).collect():
            print(r["match"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
