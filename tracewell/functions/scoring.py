"""Set F1 on several levels, tool cost and the penalised reward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f1_of_counts(tp: Column, predicted: Column, truth: Column) -> Column:
    """2pr / (p + r) in this order of operations; 0 without truth or hits."""
    p, r = tp / predicted.cast("double"), tp / truth.cast("double")
    return F.when((truth > 0) & (tp > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def f1(predicted: Column, truth: Column) -> Column:
    """F1 of two arrays taken as sets."""
    return f1_of_counts(F.size(F.array_intersect(predicted, truth)).cast("double"), F.size(F.array_distinct(predicted)), F.size(F.array_distinct(truth)))


def location_sets(locations: Column) -> Column:
    """struct(files, modules, entities, classes) of array<struct<file, class_name, function_name>>; one location without a file empties the first three."""
    name = lambda c: F.coalesce(c, F.lit("")) != ""
    known = ~F.exists(locations, lambda x: ~name(x["file"]))
    at = lambda x, *parts: F.concat(x["file"], F.lit(":"), *parts)
    module = F.transform(locations, lambda x: F.when(name(x["class_name"]), at(x, x["class_name"])).when(name(x["function_name"]), at(x, x["function_name"])))
    entity = F.transform(
        locations, lambda x: F.when(name(x["function_name"]), F.when(name(x["class_name"]), at(x, x["class_name"], F.lit("."), x["function_name"])).otherwise(at(x, x["function_name"])))
    )
    classes = F.transform(locations, lambda x: F.when(name(x["class_name"]), at(x, x["class_name"])))
    none = F.array().cast("array<string>")
    keep = lambda a: F.when(known, F.array_distinct(F.array_compact(a))).otherwise(none)
    return F.struct(
        keep(F.transform(locations, lambda x: x["file"])).alias("files"), keep(module).alias("modules"), keep(entity).alias("entities"), F.array_distinct(F.array_compact(classes)).alias("classes")
    )


def truth_sets(file_changes: Column) -> Column:
    """struct(files, modules, entities) of a task's labels, edited and added together."""
    none = F.array().cast("array<string>")
    both = lambda *keys: F.array_distinct(F.flatten(F.transform(file_changes, lambda x: F.concat(*(F.coalesce(x["changes"][k], none) for k in keys)))))
    files = F.array_distinct(F.filter(F.transform(file_changes, lambda x: x["file"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.struct(files.alias("files"), both("edited_modules", "added_modules").alias("modules"), both("edited_entities", "added_entities").alias("entities"))


def localization_reward(file_changes: Column, locations: Column) -> Column:
    """struct(reward in [0, 3], file_reward, module_reward, entity_reward, class_f1); no locations give 0."""
    predicted, truth = location_sets(locations), truth_sets(file_changes)
    some = F.coalesce(F.size(locations), F.lit(0)) > 0
    score = lambda level: F.when(some, f1(predicted[level], truth[level])).otherwise(F.lit(0.0))
    levels = [score(x) for x in ("files", "modules", "entities")]
    classes = F.when(some, f1(predicted["classes"], F.array_except(truth["modules"], truth["entities"]))).otherwise(F.lit(0.0))
    return F.struct(
        (levels[0] + levels[1] + levels[2]).alias("reward"), levels[0].alias("file_reward"), levels[1].alias("module_reward"), levels[2].alias("entity_reward"), classes.alias("class_f1")
    )


def tool_cost(calls: Column, repeated: Column, overlap: Column, chars: Column, excess: Column, truncated: Column) -> Column:
    return 0.01 * F.greatest(F.lit(0.0), calls - 1) + 0.10 * repeated + 0.20 * overlap + chars / 100_000 + excess / 50_000 + 0.05 * truncated


def penalized(quality: Column, cost: Column, weight: float = 0.2) -> Column:
    """struct(penalty, total)"""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be between 0 and 1")
    penalty = F.least(quality, weight * cost)
    return F.struct(penalty.alias("penalty"), (quality - penalty).alias("total"))
