"""Ignore files of a tree: which paths a search leaves out.

An ignore file's lines are rules for what lies under its directory. They are compiled to
expressions once, and files meet them by an equi-join on the directories above them, so
work is files x depth, whatever the number of ignore files. Of the rules that fit a path
those of the stronger kind of file decide, then those of the deepest directory, then the
last one; a `!` rule admits a path again, hidden or not, but not under a directory that is
left out itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import bracket

# Names of ignore files, the strongest first. The last kind counts in version-controlled trees alone.
KINDS = (".rgignore", ".ignore", ".gitignore")


def rule(line: str) -> tuple[bool, bool, str] | None:
    """(admits, for directories alone, expression for a path relative to the file's directory) of a line, or None."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    admits = line.startswith("!")
    line = line[admits:]
    folder = line.endswith("/")
    line = line.removesuffix("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    if not anchored:
        line = f"**/{line}"
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2  # all that lies in it, not itself
        elif c == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", line[i:])[0])
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            same = line[: i + 1] + "!" + line[i + 2 :] if line[i + 1 : i + 2] == "^" else line
            more, i = bracket(same, i)
            out += more
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return admits, folder, rf"(?s)\A{out}\z"


def rules_of(files: DataFrame, *keys: str, git: bool = True) -> DataFrame:
    """(keys, dir, rules) of the ignore files among files (keys, path, text): rules as array<struct<strength, depth, ord, admits, folder, expression>>."""
    kinds = KINDS if git else KINDS[:-1]
    name = F.element_at(F.split("path", "/"), -1)
    own = files.where(name.isin(*kinds)).select(*keys, F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), (-F.array_position(F.array(*map(F.lit, kinds)), name)).alias("strength"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))

    def compiled(batches):
        for b in batches:
            got = [rule(x) for x in b["line"]]
            keep = [g is not None for g in got]
            b = b[keep]
            some = [g for g in got if g is not None]
            yield b.assign(admits=[g[0] for g in some], folder=[g[1] for g in some], expression=[g[2] for g in some]).drop(columns="line")

    from ..shipping import ship

    ship(files.sparkSession)
    kept = own.mapInPandas(compiled, own.drop("line").schema.simpleString()[7:-1] + ",admits:boolean,folder:boolean,expression:string")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    one = F.struct("strength", depth.alias("depth"), "ord", "admits", "folder", "expression")
    return kept.groupBy(*keys, "dir").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def _above(parts: Column) -> Column:
    """The directories above a path given by its parts, the root first."""
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def verdicts(files: DataFrame, *keys: str, git: bool = True, hidden: bool = False, below: str = "") -> DataFrame:
    """files (keys, path, text, ...) with `left_out`, `shut` and `admitted`.

    shut: a directory above the path is left out, those at or above `below` not counted.
    admitted: a `!` rule decides for the path, and it isn't shut. With `hidden`, names with
    a dot in front are left out too, unless they are admitted.
    """
    rules = rules_of(files, *keys, git=git).withColumnRenamed("dir", "_dir")
    parts = F.split("_entry", "/")
    own = files.select(*keys, F.col("path").alias("_entry"), F.lit(False).alias("_folder")).distinct()
    above = own.select(*keys, F.explode(_above(parts)).alias("_entry"), F.lit(True).alias("_folder")).where("_entry <> ''").distinct()
    entries = own.unionByName(above)
    met = entries.select("*", F.explode(_above(parts)).alias("_dir")).join(rules, [*keys, "_dir"])
    relative = F.when(F.col("_dir") == "", F.col("_entry")).otherwise(F.expr("substring(_entry, length(_dir) + 2)"))
    met = met.withColumn("_r", relative)
    # The rules of a directory are in order; the last that fits is its say.
    fitting = F.filter("rules", lambda r: (F.col("_folder") | ~r["folder"]) & F.rlike(F.col("_r"), r["expression"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["strength"].alias("s"), r["depth"].alias("d"), r["ord"].alias("o"), r["admits"].alias("a"))))
    said = met.select(*keys, "_entry", "_folder", best.alias("_b")).where("_b IS NOT NULL").groupBy(*keys, "_entry", "_folder").agg(F.max("_b").alias("_b"))
    dotted = F.element_at(parts, -1).startswith(".") if hidden else F.lit(False)
    judged = entries.join(said, [*keys, "_entry", "_folder"], "left").select(*keys, "_entry", "_folder", F.col("_b.a").alias("_admits"), F.coalesce("_b.a", ~dotted).alias("_open"))
    closed = judged.where("_folder AND NOT _open").select(*keys, F.col("_entry").alias("_dir"))
    if below:
        closed = closed.where(F.col("_dir").startswith(f"{below}/"))
    shut = own.select(*keys, "_entry", F.explode(_above(parts)).alias("_dir")).join(closed, [*keys, "_dir"], "left_semi").select(*keys, F.col("_entry").alias("path")).distinct().withColumn("shut", F.lit(True))
    mine = judged.where("NOT _folder").select(*keys, F.col("_entry").alias("path"), "_admits", "_open")
    told = files.join(mine, [*keys, "path"]).join(shut, [*keys, "path"], "left").withColumn("shut", F.coalesce("shut", F.lit(False)))
    return told.withColumns({"left_out": F.col("shut") | ~F.col("_open"), "admitted": ~F.col("shut") & F.coalesce("_admits", F.lit(False))}).drop("_admits", "_open")
