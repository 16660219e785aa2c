"""Schemas of tool actions, checked on VARIANT values without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import clean_path, path_error, stripped

MOST_LOCATIONS = 64


def _kind(v: Column, path: str) -> Column:
    """The type of a field: null for one that isn't there, VOID for a null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str, required: bool, least: int = 0) -> Column:
    kind = F.coalesce(_kind(v, path), F.lit("VOID"))
    fits = (kind == "STRING") & (F.length(F.try_variant_get(v, path, "string")) >= least)
    return fits if required else fits | (kind == "VOID")


def _line(v: Column, path: str) -> Column:
    """Null, or a whole number from 1 on; text and floats that are one count as such."""
    kind = F.coalesce(_kind(v, path), F.lit("VOID"))
    said = F.try_variant_get(v, path, "string")
    return (kind == "VOID") | ((kind != "BOOLEAN") & said.rlike(r"^\s*\+?\d+(\.0+)?\s*$") & (said.try_cast("double") >= 1)) | ((kind == "BOOLEAN") & (said == "true"))


def _object(v: Column) -> Column:
    """Whether v is an object; an action may have fields that its schema doesn't know."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _keys(v: Column, known: tuple[str, ...]) -> Column:
    """Whether v is an object with no fields but known ones."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    return fields.isNotNull() & (F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))) == 0)


def location_valid(v: Column) -> Column:
    """Whether a VARIANT is a location: file, and optional class_name and function_name that aren't empty or padded."""
    name = lambda c: F.coalesce((_kind(v, f"$.{c}") == "VOID") | ((_kind(v, f"$.{c}") == "STRING") & (F.try_variant_get(v, f"$.{c}", "string") != "") & (stripped(F.try_variant_get(v, f"$.{c}", "string")) == F.try_variant_get(v, f"$.{c}", "string"))), F.lit(True))
    file = F.try_variant_get(v, "$.file", "string")
    return _keys(v, ("file", "class_name", "function_name")) & F.coalesce((_kind(v, "$.file") == "STRING") & path_error(file).isNull(), F.lit(False)) & name("class_name") & name("function_name")


def locations(v: Column) -> Column:
    """The locations of a finish action as array<struct<file, class_name, function_name>>, null if it has no such list."""
    one = lambda x: F.struct(clean_path(F.try_variant_get(x, "$.file", "string")).alias("file"), F.try_variant_get(x, "$.class_name", "string").alias("class_name"), F.try_variant_get(x, "$.function_name", "string").alias("function_name"))
    return F.transform(F.try_variant_get(v, "$.locations", "array<variant>"), one)


def action_valid(tool: Column, v: Column) -> Column:
    """Whether a VARIANT fits its tool's schema; false for a tool that isn't known."""
    listed = F.try_variant_get(v, "$.locations", "array<variant>")
    finish = F.coalesce(F.size(listed), F.lit(0)).between(1, MOST_LOCATIONS) & F.coalesce(F.forall(listed, location_valid), F.lit(False)) & F.coalesce(F.size(F.array_distinct(locations(v))) == F.size(listed), F.lit(False))
    fits = (
        F.when(tool == "glob", _object(v) & _text(v, "$.pattern", True, 1) & _text(v, "$.path", False))
        .when(tool == "grep", _object(v) & _text(v, "$.pattern", True, 1) & _text(v, "$.path", False) & _text(v, "$.include", False))
        .when(tool == "read_file", _object(v) & _text(v, "$.path", True, 1) & _line(v, "$.start_line") & _line(v, "$.end_line"))
        .when(tool == "localization_finish", _object(v) & finish)
    )
    return F.coalesce(fits, F.lit(False))
