"""Python symbols: a table of spans from source text, range joins of lines to it, and change labels."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stripped
from ..shipping import ship
from . import diffs

#: Comes after every class when a line is looked up.
_AFTER_CLASSES = 2**30
SPAN_FIELDS = "kind string, name string, module string, entity string, start int, end int, class_ord int, is_class int, member_ord int"


def decoded(payload: bytes) -> str:
    """Python source by its byte order mark or coding line."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(payload).readline)
    return payload.decode(encoding)


def span_rows(source: str) -> list[tuple]:
    """Rows of SPAN_FIELDS: classes and functions in lookup order, and `ignored` spans (docstrings, imports, module assignments, comments)."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    nodes = list(ast.walk(tree))
    is_def = lambda n: isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)
    rows: list[tuple] = []
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    members = {m.name for c in classes for m in c.body if is_def(m)}
    for k, c in enumerate(classes):
        rows += [("function", f"{c.name}.{m.name}", c.name, f"{c.name}.{m.name}", m.lineno, m.end_lineno, k, 0, j) for j, m in enumerate(filter(is_def, c.body))]
        rows.append(("class", c.name, c.name, None, c.lineno, c.end_lineno, k, 1, 0))
    free = [n for n in nodes if is_def(n) and n.name not in members]
    rows += [("function", f.name, f.name, f.name, f.lineno, f.end_lineno, _AFTER_CLASSES, 0, j) for j, f in enumerate(free)]

    def skip(first: int, last: int) -> None:
        rows.append(("ignored", None, None, None, first, last, 0, 0, 0))

    for n in nodes:
        if isinstance(n, ast.Import | ast.ImportFrom):
            skip(n.lineno, n.end_lineno)
        elif (is_def(n) or isinstance(n, ast.ClassDef)) and ast.get_docstring(n, clean=False) is not None:
            skip(n.body[0].lineno, n.body[0].end_lineno)
    for n in tree.body:
        if isinstance(n, ast.Assign | ast.AnnAssign):
            skip(n.lineno, n.end_lineno)
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip():
                skip(t.start[0], t.end[0])
    except (IndentationError, tokenize.TokenError):
        pass
    return rows


def spans(sources: DataFrame, *keys: str) -> DataFrame:
    """(keys, error, rows) of (keys, text), computed once for each row; a file that doesn't parse has an error."""
    ship(sources.sparkSession)
    names = [x.split()[0] for x in SPAN_FIELDS.split(", ")]
    struct = ", ".join(x.replace(" ", ":") for x in SPAN_FIELDS.split(", "))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            errors, found = [], []
            for t in p["text"]:
                try:
                    found.append([dict(zip(names, r, strict=True)) for r in span_rows(t)])
                    errors.append(None)
                except (SyntaxError, ValueError, TypeError, RecursionError) as e:
                    found.append(None)
                    errors.append(f"source_parse_error: {type(e).__name__}")
            yield p[list(keys)].assign(error=errors, rows=found)

    fields = ", ".join(f"{k} {sources.schema[k].dataType.simpleString()}" for k in keys)
    return sources.select(*keys, "text").mapInPandas(run, f"{fields}, error string, rows array<struct<{struct}>>")


def located(lines: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Each line (keys, line, ...) with the symbol it lies in, by lookup order, or none: an equi join on keys with a range condition."""
    s = symbols.select(*keys, F.struct("class_ord", "is_class", "member_ord").alias("_rank"), F.struct("kind", "name", "module", "entity").alias("_symbol"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = lines.select(*keys, "line").distinct().join(s, keys).where(F.col("line").between(F.col("_s"), F.col("_e")))
    best = hit.groupBy(*keys, "line").agg(F.min_by("_symbol", "_rank").alias("_b"))
    return lines.join(best.select(*keys, "line", "_b.*"), [*keys, "line"], "left")


def outside(lines: DataFrame, ignored: DataFrame, keys: list[str]) -> DataFrame:
    """Lines in no ignored span: a range anti join."""
    i = ignored.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = F.col("line").between(F.col("_s"), F.col("_e"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return lines.join(i, on, "left_anti")


def change_labels(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(instance_id, error, file_changes) of raw (instance_id, repo, patch) and sources (repo, path, text).

    What a patch removes and doesn't put back is `added` (the fix adds it), everything
    else it touches `edited`. Values keep the order of hunks, removed lines first.
    """
    ship(raw.sparkSession)
    parsed = diffs.parse(raw).join(raw.select("instance_id", "repo"), "instance_id")
    rows = parsed.where("error IS NULL").select("instance_id", "repo", F.explode("lines").alias("x")).select("instance_id", "repo", "x.*").where(F.col("path").endswith(".py"))
    per_file = rows.groupBy("instance_id", "repo", "path").agg(F.array_sort(F.collect_list(F.struct("hunk", "idx", "line_type", "source_line", "target_line", "value"))).alias("lines"))
    both = per_file.join(sources, ["repo", "path"], "left")

    def patched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, errors = [], []
            for t, lines in zip(p["text"], p["lines"], strict=True):
                if t is None:
                    texts.append(None)
                    errors.append("source_fetch_error")
                    continue
                try:
                    texts.append(diffs.apply_lines(t, list(lines)))
                    errors.append(None)
                except diffs.PatchError:
                    texts.append(None)
                    errors.append("patch_apply_error")
            yield p[["instance_id", "path"]].assign(text=texts, error=errors)

    new = both.mapInPandas(patched, "instance_id string, path string, text string, error string")
    old_spans = spans(sources.join(per_file.select("repo", "path").distinct(), ["repo", "path"], "left_semi"), "repo", "path")
    new_spans = spans(new.where("error IS NULL"), "instance_id", "path")
    old_rows = per_file.select("instance_id", "repo", "path").join(old_spans, ["repo", "path"]).select("instance_id", "path", F.explode("rows").alias("r")).select("instance_id", "path", "r.*")
    new_rows = new_spans.select("instance_id", "path", F.explode("rows").alias("r")).select("instance_id", "path", "r.*")
    keys = ["instance_id", "path"]
    text = rows.where(stripped(F.col("value")) != "")
    sides = []
    for side, mark, number, table in ((0, "-", "source_line", old_rows), (1, "+", "target_line", new_rows)):
        lines = text.where(F.col("line_type") == mark).select(*keys, "hunk", F.lit(side).alias("side"), "idx", F.col(number).alias("line"))
        sides.append(located(outside(lines, table.where("kind = 'ignored'"), keys), table.where("kind <> 'ignored'"), keys).where("name IS NOT NULL"))
    found = sides[0].unionByName(sides[1])
    there = new_rows.where("kind <> 'ignored'").select(*keys, "kind", "name").distinct()
    own = there.select(*keys, "kind", "name", F.lit(True).alias("_own"))
    of_module = there.where("kind = 'class'").select(*keys, F.col("name").alias("module"), F.lit(True).alias("_class"))
    found = found.join(own, [*keys, "kind", "name"], "left").join(of_module, [*keys, "module"], "left")
    removed = F.col("side") == 0
    separate = F.col("entity").isNotNull() & (F.col("entity") != F.col("module"))
    new_entity = removed & F.col("entity").isNotNull() & F.col("_own").isNull()
    new_module = removed & F.when(separate, F.col("_class").isNull()).otherwise(F.col("_own").isNull())
    q = lambda c: F.concat(F.col("path"), F.lit(":"), F.col(c))
    order = [F.col("hunk"), F.col("side"), F.col("idx")]
    pick = lambda c, when: F.collect_list(F.when(when & F.col(c).isNotNull(), F.struct(*order, q(c).alias("v"))))
    lists = found.groupBy(*keys).agg(
        pick("entity", new_entity).alias("added_entities"), pick("module", new_module).alias("added_modules"), pick("entity", ~new_entity).alias("edited_entities"), pick("module", ~new_module).alias("edited_modules")
    )
    distinct = lambda c: F.array_distinct(F.transform(F.array_sort(c), lambda x: x["v"]))
    some = lambda c: F.when(F.size(c) > 0, distinct(c))
    bad = new.select(*keys, "error").join(new_spans.select(*keys, F.col("error").alias("e2")), keys, "left").join(per_file.select("instance_id", "repo", "path").join(old_spans, ["repo", "path"]).select(*keys, F.col("error").alias("e3")), keys, "left")
    changes = F.struct(*(some(c).alias(c) for c in ("added_entities", "added_modules", "edited_entities", "edited_modules")))
    files = bad.join(lists, keys, "left").select("instance_id", F.coalesce("error", "e3", "e2").alias("error"), F.struct("path", changes.alias("changes")).alias("f"))
    out = files.groupBy("instance_id").agg(F.min("error").alias("error"), F.array_sort(F.collect_list("f")).alias("fs"))
    return out.select("instance_id", "error", F.when(F.col("error").isNull(), F.transform("fs", lambda f: F.struct(f["changes"].alias("changes"), f["path"].alias("file")))).alias("file_changes"))
