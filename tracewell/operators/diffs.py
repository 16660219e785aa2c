"""Unified diffs: parsing, eligibility and application."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stripped
from ..shipping import ship

_RANGE = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
LINE_SCHEMA = "path string, is_added boolean, is_removed boolean, hunk int, idx int, line_type string, source_line int, target_line int, value string"


class PatchError(ValueError):
    """A diff that can't be parsed or applied."""


def _named(raw: str) -> str | None:
    name = raw.split("\t")[0].strip()
    if name == "/dev/null":
        return None
    return name[2:] if name[:2] in ("a/", "b/") else name


def diff_lines(patch: str) -> Iterator[tuple]:
    """Rows of LINE_SCHEMA. A file without hunks gives one row with hunk -1."""
    rows = re.findall(r"[^\n]*\n|[^\n]+", patch)  # a form feed, a lone carriage return or U+2028 ends no line
    i = 0
    while i < len(rows):
        if not rows[i].startswith("--- "):
            i += 1
            continue
        if i + 1 >= len(rows) or not rows[i + 1].startswith("+++ "):
            raise PatchError("a file header lacks its second line")
        old, new = _named(rows[i][4:]), _named(rows[i + 1][4:])
        if old is None and new is None:
            raise PatchError("a file has no name")
        about = (new or old, old is None, new is None)
        i += 2
        hunk = -1
        while i < len(rows) and (m := _RANGE.match(rows[i])):
            hunk += 1
            source, target = int(m[1]), int(m[3])
            left, right = (int(m[k]) if m[k] is not None else 1 for k in (2, 4))
            i += 1
            idx = 0
            while left or right or (i < len(rows) and rows[i].startswith("\\")):
                if i >= len(rows):
                    raise PatchError("a hunk ends early")
                mark, value = rows[i][:1], rows[i][1:]
                if mark in ("\n", "\r"):
                    mark, value = " ", rows[i]
                if mark == "\\":
                    yield (*about, hunk, idx, "\\", None, None, value)
                elif mark == "-" and left:
                    yield (*about, hunk, idx, "-", source, None, value)
                    source, left = source + 1, left - 1
                elif mark == "+" and right:
                    yield (*about, hunk, idx, "+", None, target, value)
                    target, right = target + 1, right - 1
                elif mark == " " and left and right:
                    yield (*about, hunk, idx, " ", source, target, value)
                    source, target, left, right = source + 1, target + 1, left - 1, right - 1
                else:
                    raise PatchError("a hunk is longer or shorter than it says")
                i, idx = i + 1, idx + 1
        if hunk < 0:
            yield (*about, -1, 0, None, None, None, None)


def parse(patches: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, error, lines) of (key, patch): the rows of each patch as an array; an error excludes lines."""
    ship(patches.sparkSession)
    kind = patches.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in LINE_SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for k, patch in zip(p["k"], p["patch"], strict=True):
                try:
                    out.append((k, None, [dict(zip(names, r, strict=True)) for r in diff_lines(patch or "")]))
                except PatchError as e:
                    out.append((k, str(e), None))
            yield pd.DataFrame(out, columns=["k", "error", "lines"])

    struct = ", ".join(x.replace(" ", ":") for x in LINE_SCHEMA.split(", "))
    return patches.select(F.col(key).alias("k"), "patch").mapInPandas(run, f"k {kind}, error string, lines array<struct<{struct}>>").withColumnRenamed("k", key)


def eligibility(statement, parsed_error, lines):
    """Why a raw row can't become a task, in this order, else null."""
    files = F.array_distinct(F.transform(lines, lambda x: F.struct(x["path"].alias("path"), (x["is_added"] | x["is_removed"]).alias("moved"))))
    return (
        F.when(stripped(F.coalesce(statement, F.lit(""))) == "", "empty_problem_statement")
        .when(parsed_error.isNotNull() | (F.coalesce(F.size(lines), F.lit(0)) == 0), "invalid_patch")
        .when(F.exists(files, lambda f: f["moved"]), "creates_or_deletes_file")
        .when(~F.exists(files, lambda f: f["path"].endswith(".py")), "no_python_changes")
    )


def _alike(a: str, b: str) -> bool:
    return a.rstrip("\r\n") == b.rstrip("\r\n")


def apply_lines(source: str, lines: list) -> str:
    """source with one file's diff rows applied; context keeps the bytes of the source."""
    have = source.splitlines(keepends=True)
    out: list[str] = []
    at = 0
    bare_end = False
    by_hunk: dict[int, list] = {}
    for r in lines:
        if r["line_type"] is not None:
            by_hunk.setdefault(r["hunk"], []).append(r)
    for hunk in sorted(by_hunk):
        rows = by_hunk[hunk]
        anchors = [r["source_line"] - 1 for r in rows if r["line_type"] in (" ", "-")]
        start = int(anchors[0]) if anchors else min(int(r["target_line"]) - 1 for r in rows if r["line_type"] == "+") - len(out) + at
        if start < at:
            raise PatchError("hunks overlap")
        if start > len(have):
            raise PatchError("a hunk starts past the end")
        out += have[at:start]
        at = start
        for r in rows:
            kind = r["line_type"]
            if kind == "\\":
                bare_end = True
                if out and last == "+":
                    out[-1] = out[-1].rstrip("\r\n")
                continue
            last = kind
            if kind == "+":
                out.append(r["value"])
                continue
            if at >= len(have) or not _alike(have[at], r["value"]):
                raise PatchError(f"line {at + 1} differs from the source")
            if kind == " ":
                out.append(have[at])
            at += 1
    return "".join(out + have[at:])
