"""Bounded code search over a table of files (path, text): glob, grep, ranged read, context.

Each search takes one request's constants or a column of them; results are plain rows
with a `truncated` flag, so a batch of requests is a join away.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import bracket, component_order, glob_error, glob_regex, ignored
from ..functions.regexes import Expression, ExpressionError, translated
from ..functions.text import CONTEXT_LINES, READ_LINES, SEARCH_LINES, lines
from .ignores import KINDS, verdicts

MOST_RESULTS, MOST_CHARS, MOST_BYTES = 100, 30_000, 5 * 2**20
DEFAULT_LINES, MOST_LINES = 200, 500


def expression(pattern: str, spark: SparkSession) -> Expression:
    """The translated pattern; ValueError says why there is none."""
    out = translated(pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(out.java)
    except IllegalArgumentException as e:  # a script or a size that the JVM doesn't know
        raise ExpressionError(f"invalid pattern: {e}") from None
    return out


def pattern_error(pattern: str) -> str | None:
    try:
        translated(pattern)
    except ExpressionError as e:
        return str(e)
    return None


def glob_search(files: DataFrame, pattern: str, limit: int = MOST_RESULTS, path: str | None = None) -> DataFrame:
    """(path, truncated): the first `limit` matching paths in code-point order; the pattern is relative to the start path."""
    if error := glob_error(pattern) or start_error(path):
        raise ValueError(error)
    start = "/".join(p for p in (path or "").split("/") if p not in ("", "."))
    relative = F.when(F.lit(not start) | F.col("path").startswith(start + "/"), F.substring("path", F.lit(len(start) + 2 if start else 1), F.length("path")))
    found = files.select("path").where(relative.rlike(glob_regex(pattern)) & ~ignored(F.col("path")))
    top = found.orderBy("path").limit(limit + 1)
    return top.select("path", F.row_number().over(Window.orderBy("path")).alias("_i"), (F.count("*").over(Window.partitionBy()) > limit).alias("truncated")).where(F.col("_i") <= limit).drop("_i")


def include_regex(include: str) -> str:
    """A pattern for file names or, with a slash, for whole paths; braces are alternatives here, and `^` negates a class too."""
    out, depth, i = "", 0, 0
    while i < len(include):
        c = include[i]
        i += 1
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "*":
            double = include[i : i + 1] == "*"
            i += double
            if double and include[i : i + 1] == "/":
                out, i = out + "(?:[^/]+/)*", i + 1
            else:
                out += ".*" if double else "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            same = include[:i] + include[i:].replace("^", "!", 1) if include[i : i + 1] == "^" else include
            more, i = bracket(same, i - 1)
            out += more
        else:
            out += re.escape(c)
    return rf"\A{out}\z" if "/" in include else rf"(?:\A|/){out}\z"


def start_error(path: str | None) -> str | None:
    """Why a search can't start at path."""
    if path and path.startswith("/"):
        return "path must be relative"
    return "path must not contain .." if path and ".." in path.replace("\\", "/").split("/") else None


def _under(path: str | None) -> tuple[Column, Column]:
    """Whether a file lies at or under a start path, and whether it is that path itself."""
    parts = [p for p in (path or "").split("/") if p not in ("", ".")]
    if not parts:
        return F.lit(True), F.lit(False)
    exact = F.col("path") == "/".join(parts)
    return exact | F.col("path").startswith("/".join(parts) + "/"), exact


def grep_search(files: DataFrame, pattern: str, include: str | None = None, limit: int = MOST_RESULTS, budget: int = MOST_CHARS, path: str | None = None, ignore: bool = True) -> DataFrame:
    """(path, line, text, match, truncated): matching lines by path component, then line, within a number of results and characters.

    match is `path:line:text`; the last one is clipped to what is left of the budget. Hidden
    directories are left out, hidden files too unless `include` (`!` in front excludes) fits them; binary
    files are left out, and so is, with `ignore`, what ignore files leave out (`operators.ignores`;
    `include` admits a file, but not under a directory that is left out). A file that is itself the start path is searched whatever it is.
    The top `limit` + 1 lines are taken before the running sum, which is thus over a bounded number of rows.
    """
    java = expression(pattern, files.sparkSession).java
    if error := start_error(path):
        raise ValueError(error)
    within, exact = _under(path)
    named = files.where(within)
    if path and named.isEmpty():
        raise ValueError(f"search path does not exist: {path}")
    parts = component_order(F.col("path"))
    fits = F.col("path").rlike(include_regex(include.removeprefix("!"))) if include else None
    excludes = bool(include) and include.startswith("!")
    own = files.where(F.element_at(F.split("path", "/"), -1).isin(*KINDS)) if ignore else None
    rules = own is not None and not own.select("path").isEmpty()
    if rules:
        shown = F.lit(True)
    else:
        hidden = lambda c: F.exists(c, lambda p: p.startswith("."))
        shown = ~hidden(parts) if excludes or not include else ~hidden(F.slice(parts, 1, F.size(parts) - 1))
    if include:
        shown = shown & (~fits if excludes else fits)
    kept = named.where((F.octet_length("text") <= MOST_BYTES) & (exact | (shown & ~F.contains("text", F.lit("\0")))))
    # Matched as they stand, a carriage return included; one projection for what is ordered and shown, so that the limit is a top-k.
    found = kept.select("path", F.posexplode(lines(F.col("text"), SEARCH_LINES)).alias("at", "raw")).where(F.col("raw").rlike(java))
    if rules:
        # Paths alone are judged, and lines that match meet the verdict: no text is dealt out for it.
        start = "/".join(p for p in (path or "").split("/") if p not in ("", "."))
        told = verdicts(named.select("path", F.lit(None).cast("string").alias("text")).unionByName(own.select("path", "text")), hidden=True, below=start)
        out = F.col("shut") if include and not excludes else F.col("left_out")
        found = found.join(told.groupBy("path").agg(F.bool_or(out).alias("_out")), "path").where(exact | ~F.col("_out"))
    shown_text = F.regexp_replace("raw", r"[\r\n]+\z", "")
    line = F.col("at") + 1
    top = found.select("path", line.alias("line"), shown_text.alias("text"), F.struct(parts, line).alias("_o"), F.concat_ws(":", "path", line.cast("string"), shown_text).alias("match")).orderBy("_o").limit(limit + 1)
    prefix = F.length("path") + F.length(F.col("line").cast("string")) + 2
    out = within_budget(top, "_o", "match", limit, budget)
    return out.select("path", "line", F.substring("match", prefix + 1, F.length("text")).alias("text"), "match", "truncated")


def within_budget(rows: DataFrame, order: str, shown: str, limit: int, budget: int) -> DataFrame:
    """The leading rows whose `shown` texts, each with a line end, start within a budget of characters; the last one is clipped.

    `truncated`: the budget is used up, even exactly, or there are more than `limit` rows.
    """
    size = F.length(shown) + 1
    upto = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = rows.withColumns({"_i": F.row_number().over(Window.orderBy(order)), "_before": upto - size, "_full": upto >= budget, "_n": F.count("*").over(Window.partitionBy())})
    told = told.withColumn("truncated", F.max("_full").over(Window.partitionBy()) | (F.col("_n") > limit))
    kept = told.where((F.col("_i") <= limit) & (F.col("_before") < budget))
    return kept.withColumn(shown, F.substring(shown, F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_i", "_before", "_full", "_n")


def read_error(files: DataFrame, start, end, total):
    """Why a file of so many lines can't be read so, else null; columns."""
    return (
        F.when(end < start, "end before start")
        .when(end - start + 1 > MOST_LINES, "range too long")
        .when(F.octet_length("text") > MOST_BYTES, "file too large")
        .when(F.contains(F.substring("text", 1, 8192), F.lit("\0")), "binary file")
        .when((total > 0) & (start > total), "start beyond the end")
    )


def read_lines(files: DataFrame, start=None, end=None, budget: int = MOST_CHARS) -> DataFrame:
    """(path, total_lines, start_line, end_line, text, truncated, error): numbered lines of each file.

    start and end are columns or None (1, and 200 lines on). Lines are taken while their
    characters fit the budget; the one that doesn't is clipped and ends the text.
    """
    first = F.coalesce(start if start is not None else F.lit(1), F.lit(1))
    asked = end if end is not None else F.lit(None).cast("int")
    last = F.coalesce(asked, first + DEFAULT_LINES - 1)
    rows = files.select("path", "text", first.alias("_a"), last.alias("_b"), asked.isNull().alias("_open"))
    # The lines are cut once, inside a lambda: columns of them would be cut again for each mention.
    cut = lambda l: F.struct(F.size(l).alias("total"), F.slice(l, F.col("_a"), F.greatest(F.col("_b") - F.col("_a") + 1, F.lit(0))).alias("asked"))
    rows = rows.withColumn("_c", F.element_at(F.transform(F.array(lines(F.col("text"), READ_LINES)), cut), 1))
    error = read_error(rows, F.col("_a"), F.col("_b"), F.col("_c.total"))
    told = rows.withColumns({"error": error, "_p": F.when(error.isNull(), F.col("_c.asked")).otherwise(F.array().cast("array<string>"))})
    # Lines are counted while they fit; the state has no array in it.
    fold = f"aggregate(_p, named_struct('left', {budget}, 'k', 0, 'cut', false), (s, x) -> CASE WHEN s.cut THEN s WHEN length(x) <= s.left THEN named_struct('left', s.left - length(x), 'k', s.k + 1, 'cut', false) ELSE named_struct('left', s.left, 'k', s.k, 'cut', true) END)"
    told = told.withColumn("_f", F.expr(fold))
    out = F.expr("CASE WHEN _f.cut AND _f.left > 0 THEN concat(slice(_p, 1, _f.k), array(substring(_p[_f.k], 1, _f.left))) ELSE slice(_p, 1, _f.k) END")
    told = told.withColumn("_out", out)
    shown = F.transform("_out", lambda x, i: F.concat(F.lpad((F.col("_a") + i).cast("string"), 6, " "), F.lit("→"), x))
    total, good = F.col("_c.total"), F.col("error").isNull()
    end_line = F.when(total == 0, F.lit(0)).otherwise(F.col("_a") + F.size("_out") - 1)
    truncated = F.col("_f.cut") | (F.col("_open") & (F.col("_b") < total))
    return told.select(
        "path", total.alias("total_lines"), F.when(good, F.col("_a")).alias("start_line"), F.when(good, end_line).alias("end_line"), F.when(good, F.array_join(shown, "\n")).alias("text"), F.when(good, truncated).alias("truncated"), "error"
    )


def context_rows(spans: DataFrame, files: DataFrame, max_chars: int | None = 12_000, max_lines: int = 160) -> DataFrame:
    """(request, ord, path, line_numbers, text, truncated) of spans (request, ord, path, start, end).

    Locations are served in order from one budget of characters and lines; lines already
    given cost nothing and aren't repeated; a line that doesn't fit ends its location
    only. A request's locations (64 at most) are folded as one array. Without max_chars
    (None) lines alone are counted, however long they are.
    """
    if not (max_chars is None or 1 <= max_chars <= 30_000) or not 1 <= max_lines <= 500:
        raise ValueError("a context takes 1 to 30000 characters and 1 to 500 lines")
    cut = files.select("path", lines(F.col("text"), CONTEXT_LINES).alias("l"))
    rows = spans.join(cut, "path", "left").select("request", F.struct("ord", "path", "start", "end", F.expr("slice(l, start, greatest(0, end - start + 1))").alias("l")).alias("x"))
    asked = rows.groupBy("request").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    steps = F.expr("flatten(transform(xs, x -> transform(coalesce(x.l, array()), (t, i) -> named_struct('ord', x.ord, 'key', concat(x.path, chr(0), cast(x.start + i AS string)), 'n', x.start + i, 't', concat(cast(x.start + i AS string), ': ', t, chr(10))))))")
    start = f"named_struct('chars', {'cast(null AS int)' if max_chars is None else max_chars}, 'lines', {max_lines}, 'used', cast(array() AS array<string>), 'out', cast(array() AS array<struct<ord:int,n:int,t:string>>), 'ended', cast(null AS int))"
    fold = (
        f"aggregate(steps, {start}, (s, x) -> CASE WHEN s.ended <=> x.ord OR array_contains(s.used, x.key) THEN s "
        "WHEN coalesce(length(x.t) > s.chars, false) OR s.lines = 0 THEN named_struct('chars', s.chars, 'lines', s.lines, 'used', s.used, 'out', s.out, 'ended', x.ord) "
        "ELSE named_struct('chars', s.chars - length(x.t), 'lines', s.lines - 1, 'used', concat(s.used, array(x.key)), 'out', concat(s.out, array(named_struct('ord', x.ord, 'n', x.n, 't', x.t))), 'ended', s.ended) END)"
    )
    told = asked.withColumn("steps", steps).withColumn("f", F.expr(fold)).select("request", "f", F.explode("xs").alias("x"))
    mine = F.expr("filter(f.out, y -> y.ord = x.ord)")
    given = F.expr("transform(sequence(x.start, x.end), n -> array_contains(f.used, concat(x.path, chr(0), cast(n AS string))))")
    return told.select("request", "x.ord", "x.path", F.transform(mine, lambda y: y["n"]).alias("line_numbers"), F.array_join(F.transform(mine, lambda y: y["t"]), "").alias("text"), F.exists(given, lambda g: ~g).alias("truncated"))


def location_spans(locations: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds start, end and error to locations (file, class_name, function_name): the lines of the named symbol, or of the whole file.

    files: (path, text); symbols: (path, kind, name, start, end, class_ord, member_ord) with
    methods as class.method. Of several symbols of a name the first in lookup order counts.
    """
    wanted = F.concat_ws(".", F.when(F.col("class_name") != "", F.col("class_name")), F.when(F.col("function_name") != "", F.col("function_name")))
    rank = F.struct("class_ord", "member_ord", "start")
    first = symbols.groupBy(F.col("path").alias("_sp"), F.col("name").alias("_sn")).agg(F.min_by(F.struct("start", "end"), rank).alias("_s"))
    whole = files.select(F.col("path").alias("_fp"), F.greatest(F.lit(1), F.size(lines(F.col("text"), CONTEXT_LINES))).alias("_n"), (F.octet_length("text") > MOST_BYTES).alias("_large"))
    rows = locations.withColumn("_w", wanted).join(whole, F.col("file") == F.col("_fp"), "left").join(first, (F.col("file") == F.col("_sp")) & (F.col("_w") == F.col("_sn")), "left")
    named = F.col("_w") != ""
    error = (
        F.when(F.col("_fp").isNull(), "location file does not exist")
        .when(F.col("_large"), "location exceeds the size limit")
        .when(named & ~F.col("file").endswith(".py"), "symbols are known of Python files only")
        .when(named & F.col("_s").isNull(), "symbol does not exist")
    )
    good = error.isNull()
    told = rows.withColumns({"error": error, "start": F.when(good, F.when(named, F.col("_s.start")).otherwise(F.lit(1))), "end": F.when(good, F.when(named, F.col("_s.end")).otherwise(F.col("_n")))})
    return told.drop("_w", "_fp", "_n", "_large", "_sp", "_sn", "_s")


def answered(requests: DataFrame, files: DataFrame, symbols: DataFrame, max_chars: int | None = 12_000, max_lines: int = 160) -> DataFrame:
    """(request, status, errors, context) of requests (request, ord, file, class_name, function_name): the bounded context of each, or its errors alone.

    A request that fails doesn't touch the others. context: array<struct<ord, file, symbol_start, symbol_end, line_numbers, text, truncated>>.
    """
    told = location_spans(requests, files, symbols)
    bad = told.groupBy("request").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    good = told.join(bad.where("size(errors) = 0").select("request"), "request", "left_semi")
    rows = context_rows(good.select("request", "ord", F.col("file").alias("path"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), files, max_chars, max_lines)
    spans = good.select("request", "ord", F.col("start").alias("symbol_start"), F.col("end").alias("symbol_end"))
    one = F.struct("ord", F.col("path").alias("file"), "symbol_start", "symbol_end", "line_numbers", "text", "truncated")
    context = rows.join(spans, ["request", "ord"]).groupBy("request").agg(F.array_sort(F.collect_list(one)).alias("context"))
    return bad.join(context, "request", "left").select("request", F.when(F.size("errors") > 0, "error").otherwise("ok").alias("status"), "errors", "context")


def finish_errors(locations: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `error` to (file, class_name, function_name): a missing file or a symbol that isn't there.

    symbols: (path, kind, name) with kind class or function and methods as class.method.
    """
    wanted = F.concat_ws(".", "class_name", "function_name")
    known = symbols.select(F.col("path").alias("_sp"), F.col("name").alias("_sn")).distinct()
    has = files.select(F.col("path").alias("_fp")).distinct()
    rows = locations.join(has, F.col("file") == F.col("_fp"), "left").join(known, (F.col("file") == F.col("_sp")) & (wanted == F.col("_sn")), "left")
    error = F.when(F.col("_fp").isNull(), "location file does not exist").when((wanted != "") & ~F.col("file").endswith(".py"), "symbols are known of Python files only").when((wanted != "") & F.col("_sn").isNull(), "symbol does not exist")
    return rows.withColumn("error", error).drop("_fp", "_sp", "_sn")


def payload_error(locations):
    """Why an array of locations can't end a run: 1 to 64, none twice."""
    return F.when(~F.coalesce(F.size(locations), F.lit(0)).between(1, 64), "between 1 and 64 locations").when(F.size(F.array_distinct(locations)) != F.size(locations), "duplicate locations")
