"""Many searches at once, over an index of short strings.

The index says which files have which strings of three characters, and which of eight; of
those it has every fourth, by a checksum, so that they cost no more room than the others.
Long ones are far rarer where words are made of few syllables. Each request looks up
the rarest ones that a match of its pattern must contain (of each of its alternatives),
by an equi-join; only the files that have them all meet the pattern. No pattern meets a
file without that: work follows how often the rarest strings occur. A request
that needs no string of three (`.*`, `a|b`, `?`) is answered with an error that says so, and
goes to a search of its own; so does one that can't be parsed, and neither touches others.

The index (`searched`) is for a tree that stands and for batches that are small beside it.
Where as many ask as there are files, `searched_all` does without: the texts are read for
the longest strings of the requests alone. Of a string that is frequent it takes the first
places in the order of the answers, and goes on only for requests whose answers aren't full,
so that a request costs about as much as it may be told, however many files match it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import component_order, glob_error, glob_regex, ignored
from ..functions.regexes import LONG, ONE_IN, SHORT, ExpressionError, strings, translated
from ..functions.text import SEARCH_LINES, fingerprint, lines
from ..shipping import ship
from ..sources.loaders import shared_folder
from . import anchors
from .search import MOST_BYTES, MOST_CHARS, MOST_RESULTS, include_regex, start_error

#: Requests of a batch.
MOST_REQUESTS = 32
#: Strings of a pattern that are looked up, the rarest first: a file must have all of them.
MOST_GRAMS = 4
#: One that is so many times as frequent as the rarest is left out: to look it up costs more than it rules out.
MOST_TIMES = 4
#: Parts that the files are cut into, in the order of their paths.
PARTS = 128
#: How often a request's strings occur where it looks first, for each line that it may be told; and how many times as often in each further round.
FIRST_TIMES, MORE_TIMES = 2, 16
TOO_BROAD = "pattern has no three characters that every match contains; search alone"


def batch_error(n: Column) -> Column:
    """Why a batch of so many requests is refused, else null."""
    return F.when(~F.coalesce(n, F.lit(0)).between(1, MOST_REQUESTS), f"a batch must contain 1..{MOST_REQUESTS} requests")


def grams(text: Column) -> Column:
    """The distinct strings of a text that the index has, as `regexes.strings`; none goes over a line feed."""
    runs = [F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=([^\n]{{{n}}}))"), F.lit(1))) for n in (SHORT, LONG)]
    return F.concat(runs[0], F.filter(runs[1], lambda g: F.crc32(g) % ONE_IN == 0))


def index(files: DataFrame) -> DataFrame:
    """(kind, gram, path): what the texts (kind `text`; none of too large files) and the paths (kind `path`) of files (path, text) contain."""
    # A file's strings are hundreds of times its row: texts are dealt out before they are cut, however few splits they come in.
    texts = files.where(F.octet_length("text") <= MOST_BYTES).repartition("path")
    both = texts.select(F.lit("text").alias("kind"), F.explode(grams(F.col("text"))).alias("gram"), "path")
    return both.unionByName(files.select(F.lit("path").alias("kind"), F.explode(grams(F.col("path"))).alias("gram"), "path"))


def glob_runs(pattern: str) -> set[str]:
    """Literal texts, long enough to be looked up, that every path under a glob contains."""
    runs, run, i = [], "", 0
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    for n, part in enumerate(parts):
        if part == "**":
            runs.append(run)
            run = ""
            continue
        i = 0
        while i < len(part):
            if part[i] in "*?[":
                runs.append(run)
                run = ""
                close = part.find("]", i + 2 + (part[i + 1 : i + 2] == "!")) if part[i] == "[" else -1
                i = close + 1 if close > 0 else i + 1
            else:
                run += part[i]
                i += 1
        run += "/" if n < len(parts) - 1 else ""
    return {r for r in [*runs, run] if len(r) >= SHORT}


def glob_grams(pattern: str) -> set[str]:
    """Strings of the index that every path under a glob contains."""
    return {g for r in glob_runs(pattern) for g in strings(r)}


def compiled(kind: str, pattern: str | None, path: str | None, include: str | None) -> tuple[str | None, str | None, str | None, list[list[str]]]:
    """(error, expression, expression of include, needed literal texts by alternative) of a request."""
    if error := start_error(path):
        return error, None, None, []
    try:
        if kind == "glob":
            if error := glob_error(pattern or ""):
                return error, None, None, []
            java, needed = glob_regex(pattern), [sorted(glob_runs(pattern))]
        elif kind == "grep":
            e = translated(pattern or "")
            java, needed = e.java, [sorted(x) for x in e.runs]
        else:
            return "unknown kind of search", None, None, []
        fits = include_regex(include.removeprefix("!")) if include else None
    except (ExpressionError, ValueError) as e:
        return str(e), None, None, []
    if not all(needed):
        return TOO_BROAD, None, None, []
    return None, java, fits, needed


def _compiled(requests: DataFrame, bounds: dict[str, list] | None = None) -> DataFrame:
    """Requests with their error, expressions and the strings of the index that they need; or, with the bounds of parts by kind, the first and last part that each looks into and its keys by alternative."""

    def places(kind: str, path: str | None) -> tuple[int, int]:
        start = [p for p in (path or "").split("/") if p not in ("", ".")]
        if not start:
            return 0, len(bounds[kind]) - 1
        # What lies under a path follows it, and comes before its successor.
        ends = ("/".join(start) + "/", "/".join(start) + "0") if kind == "glob" else (start, [*start[:-1], start[-1] + "\0"])
        return tuple(anchors.part_of(e, bounds[kind]) for e in ends)

    def run(batches: Iterable[pd.DataFrame]):
        none = lambda x: x if isinstance(x, str) else None
        for b in batches:
            got = [compiled(k, none(p), none(w), none(i)) for k, p, w, i in zip(b["kind"], b["pattern"], b["path"], b["include"], strict=True)]
            b = b.assign(error=[g[0] for g in got], java=[g[1] for g in got], fits=[g[2] for g in got])
            if bounds is None:
                yield b.assign(needed=[[sorted({s for r in runs for s in strings(r)}) for runs in g[3]] for g in got])
                continue
            of = [(0, 0) if g[0] else places(k, none(w)) for g, k, w in zip(got, b["kind"], b["path"], strict=True)]
            keys = [[anchors.alternative(runs) for runs in g[3]] for g in got]
            yield b.assign(lo=[x[0] for x in of], hi=[x[1] for x in of], lengths=[[a[0] for a in x] for x in keys], keys=[[a[1] for a in x] for x in keys])

    ship(requests.sparkSession)
    own = requests.select("request", "kind", "pattern", "path", "include")
    kind = requests.schema["request"].dataType.simpleString()
    more = "needed array<array<string>>" if bounds is None else "lo long, hi long, lengths array<int>, keys array<array<long>>"
    return own.mapInPandas(run, f"request {kind}, kind string, pattern string, path string, include string, error string, java string, fits string, {more}")


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder, so that what reads them twice computes them once."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def searched(requests: DataFrame, files: DataFrame, grams: DataFrame, limit: int = MOST_RESULTS, budget: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(answers, results) of requests (request, kind, pattern, path, include); kind is grep or glob, include is grep's.

    answers: (request, error, n, truncated), a row for each request. results: (request,
    ord, path, line, match), at most `limit` a request within `budget` characters, the last
    one clipped; line is null and match the path for a glob. grams is `index(files)`, kept as
    a table; its rows and files' are joined by what the requests need. The compiled requests
    and the matches are written to the shared folder before this returns.
    """
    asked = written(_compiled(requests))
    good = asked.where("error IS NULL")
    wanted = good.select("request", "kind", F.posexplode("needed").alias("alt", "grams")).select("request", "kind", "alt", F.explode("grams").alias("gram"))
    index_kind = F.when(F.col("kind") == "glob", "path").otherwise("text")
    wanted = wanted.select("request", "alt", index_kind.alias("kind"), "gram")
    held = grams.join(wanted.select("kind", "gram").distinct(), ["kind", "gram"], "left_semi")
    often = held.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    # The rarest strings of each alternative; one that is nowhere rules the alternative out.
    by_rarity = Window.partitionBy("request", "alt").orderBy("n", "gram")
    ranked = wanted.join(often, ["kind", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns({"rank": F.row_number().over(by_rarity), "least": F.min("n").over(by_rarity)})
    rare = ranked.where((F.col("rank") <= MOST_GRAMS) & (F.col("least") > 0) & (F.col("n") <= MOST_TIMES * F.col("least"))).select("request", "alt", "kind", "gram", F.count("*").over(Window.partitionBy("request", "alt")).alias("of"))
    found = rare.join(held, ["kind", "gram"]).groupBy("request", "alt", "path").agg(F.count("*").alias("n"), F.max("of").alias("of")).where("n = of").select("request", F.col("path").alias("_path")).distinct()
    found = found.join(good.select("request", "kind", "java", "fits", "include", "path"), "request")
    greps, globs = _greps(found), _globs(found)
    texts = greps.join(files.select(F.col("path").alias("_path"), "text"), "_path").where(F.col("_named") | ~F.contains("text", F.lit("\0")))
    # Without anchors a line that matches makes the text match: most files are done with before their lines are cut.
    texts = texts.where(F.contains("java", F.lit(r"\A")) | F.contains("java", F.lit(r"\z")) | F.rlike("text", F.col("java")))
    rows = texts.select("request", "java", "_path", F.posexplode(lines(F.col("text"), SEARCH_LINES)).alias("at", "raw"))
    rows = rows.where(F.rlike("raw", F.col("java")))
    rows = _told_lines(rows.withColumn("line", F.col("at") + 1), budget)
    return _answers(asked, rows.unionByName(_told_paths(globs)), limit, budget)


def _start() -> Column:
    return F.array_join(F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: (p != "") & (p != ".")), "/")


def _under(found: DataFrame) -> DataFrame:
    """What lies at or under the start path of its request."""
    start = _start()
    return found.where((start == "") | (F.col("_path") == start) | F.col("_path").startswith(F.concat(start, F.lit("/"))))


def _globs(found: DataFrame) -> DataFrame:
    """Of requests with paths that they may match (kind, java, path, _path), the globs that do."""
    start = _start()
    globs = _under(found).where((F.col("kind") == "glob") & (F.col("_path") != start))
    relative = F.when(start == "", F.col("_path")).otherwise(F.substring("_path", F.length(start) + 2, F.length("_path")))
    return globs.where(F.rlike(relative, F.col("java")) & ~ignored(F.col("_path")))


def _greps(found: DataFrame) -> DataFrame:
    """Of requests with paths that they may match (kind, fits, include, path, _path), the greps that look into them; `_named`: the file is the start path."""
    parts, exact = component_order(F.col("_path")), F.col("_path") == _start()
    hidden = lambda c: F.exists(c, lambda p: p.startswith("."))
    excludes = F.coalesce(F.col("include").startswith("!"), F.lit(False))
    fits = F.rlike("_path", F.col("fits"))
    inner = ~hidden(F.slice(parts, F.lit(1), F.size(parts) - 1))
    shown = F.when(F.col("include").isNull() | (F.col("include") == ""), ~hidden(parts)).when(excludes, ~hidden(parts) & ~fits).otherwise(inner & fits)
    return _under(found).where((F.col("kind") == "grep") & (exact | shown)).withColumn("_named", exact)


def _told_paths(globs: DataFrame) -> DataFrame:
    return globs.select("request", F.struct(F.array("_path").alias("p"), F.lit(0).alias("l")).alias("o"), F.col("_path").alias("path"), F.lit(None).cast("int").alias("line"), F.col("_path").alias("match"), F.lit(0).alias("size"))


def _told_lines(rows: DataFrame, budget: int) -> DataFrame:
    """Matching lines (_path, line, raw) as they are told: no more of one than the budget, and its whole size."""
    whole = F.concat_ws(":", "_path", F.col("line").cast("string"), F.regexp_replace("raw", r"[\r\n]+\z", ""))
    order = F.struct(component_order(F.col("_path")).alias("p"), F.col("line").alias("l")).alias("o")
    return rows.select("request", order, F.col("_path").alias("path"), "line", F.substring(whole, 1, budget).alias("match"), (F.length(whole) + 1).alias("size"))


def _top(rows: DataFrame, limit: int, budget: int) -> DataFrame:
    """The first limit + 1 rows of each request that start within its budget; `_full`: it ends in this one."""
    by = Window.partitionBy("request").orderBy("o")
    # The rank's bound is applied before rows are dealt out by request, so a request that matches everywhere stays small.
    top = rows.withColumn("ord", F.row_number().over(by)).where(F.col("ord") <= limit + 1)
    upto = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumns({"_before": upto - F.col("size"), "_full": upto >= budget}).where(F.col("_before") < budget)


def _answers(asked: DataFrame, rows: DataFrame, limit: int, budget: int) -> tuple[DataFrame, DataFrame]:
    told = written(_top(rows, limit, budget))
    kept = told.where(F.col("ord") <= limit)
    results = kept.select("request", "ord", "path", "line", F.when(F.col("line").isNull(), F.col("match")).otherwise(F.substring("match", F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).alias("match"))
    n = told.groupBy("request").agg(F.count_if(F.col("ord") <= limit).alias("_n"), (F.max("_full") | (F.max("ord") > limit)).alias("_t"))
    answers = asked.join(n, "request", "left").select("request", "error", F.when(F.col("error").isNull(), F.coalesce("_n", F.lit(0))).alias("n"), F.when(F.col("error").isNull(), F.coalesce("_t", F.lit(False))).alias("truncated"))
    return answers, results


def asked_as() -> Column:
    """What is the same for requests that ask the same."""
    return fingerprint(F.col("kind"), F.col("pattern"), F.col("path"), F.col("include"))


def _bounds(paths: DataFrame) -> list:
    """The first `o` of each of some parts that follow each other: a bounded number."""
    dealt = paths.repartitionByRange(PARTS, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o"))
    return sorted(r["o"] for r in dealt.collect())


def searched_all(requests: DataFrame, files: DataFrame, limit: int = MOST_RESULTS, budget: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """`searched` without an index, for as many requests as there are files; those that ask the same (`asked_as`) are better given once.

    All but the last steps are done before this returns.
    """
    files = files.where("path IS NOT NULL")
    bounds = {"grep": _bounds(files.select(component_order(F.col("path")).alias("o"))) or [[]], "glob": _bounds(files.select(F.col("path").alias("o"))) or [""]}
    asked = written(_compiled(requests, bounds))
    texts = files.where(F.octet_length("text") <= MOST_BYTES)
    rows = {"grep": texts.select("path", "text"), "glob": files.select("path", F.col("path").alias("text"))}
    every = _told_paths(asked.where("false").withColumn("_path", F.lit(None).cast("string")))
    for kind in rows:
        for found in _rounds(kind, asked, rows[kind], bounds[kind], limit, budget):
            every = every.unionByName(found)
    return _answers(asked, every, limit, budget)


def _rounds(kind: str, asked: DataFrame, rows: DataFrame, bounds: list, limit: int, budget: int) -> list[DataFrame]:
    """What the requests of a kind find in rows (path, text), by round: at most limit + 1 rows a request in each, none of them after one of the next."""
    split, good = kind == "grep", asked.where((F.col("error").isNull()) & (F.col("kind") == kind))
    alts = good.select("request", F.posexplode(F.arrays_zip("lengths", "keys")).alias("alt", "a")).select("request", "alt", F.col("a.lengths").alias("length"), F.explode("a.keys").alias("key"))
    alts = written(alts)
    if alts.isEmpty():
        return []
    often = anchors.counts(rows, written(alts.select("length", "key").distinct())).select("key", "n")
    # The rarest string of each alternative; one that is nowhere rules the alternative out.
    by_rarity = Window.partitionBy("request", "alt").orderBy("n", "key")
    ranked = alts.join(often, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(by_rarity))
    chosen = written(ranked.where("rank = 1 AND n > 0").select("request", "length", "key", "n").distinct())
    most = FIRST_TIMES * (limit + 1)
    common = F.col("n") > most
    spread = written(anchors.counts(rows, written(chosen.where(common).select("length", "key").distinct()), bounds, split))
    open_, out = good.join(chosen, "request", "left_semi").select("request", "lo", "hi"), []
    while True:
        # Where each looks in this round: from lo until its frequent strings have occurred often enough.
        own = open_.join(chosen.where(common).select("request", "key"), "request").join(spread, "key").where("part BETWEEN lo AND hi")
        by_part = Window.partitionBy("request").orderBy("part")
        summed = own.groupBy("request", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by_part))
        far = summed.where(F.col("upto") >= most).groupBy("request").agg(F.min("part").alias("to"))
        spans = written(open_.join(far, "request", "left").select("request", "lo", "hi", F.coalesce("to", "hi").alias("to")))
        looked = written(spans.join(chosen, "request"))
        rare = looked.where(~common).select("length", "key", F.lit(anchors.EVERYWHERE).cast("long").alias("part"))
        parts = looked.where(common).join(spread.select("key", "part"), "key").where("part BETWEEN lo AND to").select("length", "key", "part")
        held = written(anchors.lines_with(rows, written(rare.unionByName(parts).distinct()), bounds, split))
        about = looked.select("request", "key", "lo", "to").join(good.select("request", "kind", "java", "fits", "include", "path"), "request")
        pairs = held.select(F.col("path").alias("_path"), "part", "line", "binary", F.explode("keys").alias("key")).join(about, "key").where("part BETWEEN lo AND to").drop("key", "part", "lo", "to")
        if kind == "glob":
            told = _told_paths(_globs(pairs.distinct()))
        else:
            pairs = _greps(pairs).where(F.col("_named") | ~F.col("binary")).select("request", "java", "_path", "line").repartition("_path", "line").distinct()
            rest = pairs.join(held.select(F.col("path").alias("_path"), "line", "raw"), ["_path", "line"]).where(F.rlike("raw", F.col("java")))
            told = _told_lines(rest, budget)
        out.append(written(_top(told, limit, budget).drop("ord", "_before", "_full")))
        so_far = out[0].select("request", "size")
        for f in out[1:]:
            so_far = so_far.unionByName(f.select("request", "size"))
        full = so_far.groupBy("request").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where((F.col("n") > limit) | (F.col("size") >= budget))
        open_ = written(spans.where("to < hi").join(full, "request", "left_anti").select("request", (F.col("to") + 1).alias("lo"), "hi"))
        if open_.isEmpty():
            return out
        most *= MORE_TIMES


def index_table(files: DataFrame, path: str) -> DataFrame:
    """The index of files, kept as a table that is sorted by string, so that a look-up reads few row groups."""
    spark: SparkSession = files.sparkSession
    index(files).repartition("kind", "gram").sortWithinPartitions("kind", "gram").write.parquet(path)
    return spark.read.parquet(path)
