"""Paths: validation, normalisation, globs, component order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that a search leaves out, wherever they stand in a path.
IGNORED_PARTS = (".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "node_modules")

# The code points that count as white space when text is stripped or split.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85   -     　]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def normalized(c: Column) -> Column:
    """POSIX normal form: no `//`, `.` or resolvable `..`; empty becomes `.`."""
    rooted = F.startswith(c, F.lit("/"))
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        climbs = (part == "..") & ((F.size(done) == 0) | (F.element_at(done, -1) == ".."))
        return (
            F.when(climbs & rooted, done)
            .when(climbs, F.concat(done, F.array(part)))
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, empty, lambda a, x: F.when(F.size(a) == 0, step(F.array().cast("array<string>"), x)).otherwise(step(a, x))), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def path_error(c: Column) -> Column:
    """Why a location's path isn't acceptable, else null."""
    slashed = F.replace(c, F.lit("\\"), F.lit("/"))
    bad = (
        c.isNull()
        | (c == "")
        | (stripped(c) != c)
        | slashed.startswith("/")
        | slashed.startswith("./")
        | F.array_contains(F.split(slashed, "/"), "..")
        | slashed.rlike(r"\A[A-Za-z]:/")
    )
    return F.when(bad, F.lit("invalid_target_path"))


def clean_path(c: Column) -> Column:
    """The normal form of an acceptable path."""
    return normalized(F.replace(c, F.lit("\\"), F.lit("/")))


def ignored(c: Column) -> Column:
    return F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, IGNORED_PARTS)))


def qualified(path: Column, name: Column) -> Column:
    """`path:name`, null for no name."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(path, F.lit(":"), name))


def glob_error(pattern: str) -> str | None:
    slashed = pattern.replace("\\", "/")
    if not pattern or slashed.startswith("/"):
        return "pattern must be relative"
    return "pattern must not contain .." if ".." in slashed.split("/") else None


def bracket(glob: str, at: int) -> tuple[str, int]:
    """The regular expression of the character class that begins at glob[at], and where it ends; a bracket that isn't closed stands for itself.

    A class matches one character but a slash. `!` in front negates, a `]` in front is a
    member, ranges run from the lesser character to the greater; nothing else is special.
    """
    i = at + 1 + (glob[at + 1 : at + 2] == "!")
    close = glob.find("]", i + 1)
    if close < 0:
        return re.escape("["), at + 1
    body, members, k = glob[i:close], "", 0
    plain = lambda c: "\\" + c if c in r"\[]^-&" else c
    while k < len(body):
        if body[k + 1 : k + 2] == "-" and k + 2 < len(body):
            if body[k] <= body[k + 2]:
                members += f"{plain(body[k])}-{plain(body[k + 2])}"
            k += 3
        else:
            members += plain(body[k])
            k += 1
    if glob[at + 1] == "!":
        return f"[^/{members}]", close + 1
    return (f"(?!/)[{members}]" if members else "(?!)"), close + 1


def glob_regex(pattern: str) -> str:
    """A regular expression for whole relative paths: `**` crosses directories, `*` doesn't, no braces."""
    if error := glob_error(pattern):
        raise ValueError(error)
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(r"(?!)" if last else r"(?:[^/]+/)*")
            continue
        piece, k = "", 0
        while k < len(part):
            c = part[k]
            k += 1
            if c == "*":
                piece += "[^/]*"
            elif c == "?":
                piece += "[^/]"
            elif c == "[":
                more, k = bracket(part, k - 1)
                piece += more
            else:
                piece += re.escape(c)
        out.append(piece + ("" if last else "/"))
    return rf"\A{''.join(out)}\z"


def component_order(c: Column) -> Column:
    """Sorts like a directory walk: by component, not by character."""
    return F.split(c, "/")
