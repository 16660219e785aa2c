"""Queries over files, spans, diffs, chats and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import build, chat, diffs, digest, search, symbols
from ..sources import loaders
from . import views as v

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = f"{v.CODE_FILE}, l AS (SELECT path, i AS line, rtrim(t[i], chr(13)) AS text FROM (SELECT path, t, unnest(range(1, len(t) + CASE WHEN t[-1] = '' THEN 0 ELSE 1 END)) AS i FROM (SELECT path, string_split(text, chr(10)) AS t FROM code_file WHERE text <> '')))"


@query(f"WITH {v.CODE_FILE}, g AS (SELECT path FROM code_file WHERE regexp_full_match(path, 'src1[^/]*/(?:[^/]+/)*doc_[^/]*5\\.txt')), t AS (SELECT path, row_number() OVER (ORDER BY path) AS i, count(*) OVER () AS n FROM g) SELECT path, n > 100 AS truncated FROM t WHERE i <= 100")
def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.glob_search(v.code_file(spark, d), "src1*/**/doc_*5.txt")


@query(f"WITH {v.CODE_FILE}, t AS (SELECT path, row_number() OVER (ORDER BY path) AS i, count(*) OVER () AS n FROM code_file) SELECT path, n > 100 AS truncated FROM t WHERE i <= 100")
def limit_topk_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.glob_search(v.code_file(spark, d), "**/*.txt")


_GREP = f"""WITH {_LINES}, m AS (SELECT path, line, text, path || ':' || line || ':' || text AS match, row_number() OVER (ORDER BY string_split(path, '/'), line) AS i FROM l WHERE regexp_matches(text, '{{pattern}}') {{more}}),
b AS (SELECT *, sum(length(match) + 1) OVER (ORDER BY i) - length(match) - 1 AS before, count(*) OVER () AS n FROM m WHERE i <= 101), t AS (SELECT bool_or(before + length(match) + 1 >= {{budget}}) OR max(n) > 100 AS truncated FROM b)
SELECT path, line, substr(left(match, ({{budget}} - before)::INT), length(path) + length(line::VARCHAR) + 3) AS text, left(match, ({{budget}} - before)::INT) AS match, truncated FROM b, t WHERE i <= 100 AND before < {{budget}}"""


@query(_GREP.format(pattern="tion[a-z]+ the", more="AND regexp_matches(path, '(?:^|/)doc_[^/]*[.](?:txt|md)$')", budget=30000))
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.grep_search(v.code_file(spark, d), "tion[a-z]+ the", "doc_*.{txt,md}")


@query(_GREP.format(pattern="the", more="", budget=3000))
def grep_budget(spark: SparkSession, d: str) -> DataFrame:
    return search.grep_search(v.code_file(spark, d), "the", budget=3000)


@query(_GREP.format(pattern="the", more="AND regexp_matches(path, '^src1/en/doc_[^/]*[13579][.]txt$')", budget=30000))
def grep_under(spark: SparkSession, d: str) -> DataFrame:
    """From a start path on, with a character class in the file name."""
    return search.grep_search(v.code_file(spark, d), "the", "doc_*[!02468].txt", path="src1/en")


_CLASSES = r"src[12]/e[!a-m]/doc_[0-9][^b3-5]*.txt"


@query(rf"WITH {v.CODE_FILE}, t AS (SELECT path, row_number() OVER (ORDER BY path) AS i, count(*) OVER () AS n FROM code_file WHERE regexp_full_match(path, 'src[12]/e[^/a-m]/doc_[0-9][\^b3-5][^/]*[.]txt')) SELECT path, n > 100 AS truncated FROM t WHERE i <= 100")
def glob_classes(spark: SparkSession, d: str) -> DataFrame:
    """Character classes: a negated one, and one with a caret, which stands for itself."""
    return search.glob_search(v.code_file(spark, d), _CLASSES)


@query(f"""WITH {_LINES.replace("AND text <> ''", "")}, n AS (SELECT path, count(*) AS total FROM l GROUP BY path), f AS (SELECT path, 1 + doc_id % 4 AS a FROM code_file),
p AS (SELECT path, count(*) AS got, string_agg(lpad(line::VARCHAR, 6, ' ') || '→' || text, chr(10) ORDER BY line) AS text FROM l JOIN f USING (path) WHERE line BETWEEN a AND a + 2 GROUP BY path)
SELECT f.path, coalesce(total, 0) AS total_lines, CASE WHEN ok THEN a END AS start_line, CASE WHEN ok THEN CASE WHEN coalesce(total, 0) = 0 THEN 0 ELSE a + coalesce(got, 0) - 1 END END AS end_line, CASE WHEN ok THEN coalesce(p.text, '') END AS text,
 CASE WHEN ok THEN FALSE END AS truncated, CASE WHEN NOT ok THEN 'start beyond the end' END AS error FROM (SELECT f.*, n.total, NOT (coalesce(n.total, 0) > 0 AND a > n.total) AS ok FROM f LEFT JOIN n USING (path)) f LEFT JOIN p USING (path)""")
def read_range(spark: SparkSession, d: str) -> DataFrame:
    files = v.code_file(spark, d).withColumn("a", 1 + F.col("doc_id") % 4)
    out = search.read_lines(files, F.col("a").cast("int"), (F.col("a") + 2).cast("int"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("total_lines", "start_line", "end_line")})


_LINE = """list_transform(range(x.a, least(x.b, len(l)) + 1), lambda i: {'chars': -length(i || ': ' || l[i]) - 1, 'lines': -1, 'used': [i], 'ords': [x.ord], 'ended': x.ord})"""
_STEP = """CASE WHEN s.ended = x.ended OR list_contains(s.used, x.used[1]) THEN s WHEN s.chars + x.chars < 0 OR s.lines = 0 THEN {'chars': s.chars, 'lines': s.lines, 'used': s.used, 'ords': s.ords, 'ended': x.ended}
  ELSE {'chars': s.chars + x.chars, 'lines': s.lines - 1, 'used': list_concat(s.used, x.used), 'ords': list_concat(s.ords, x.ords), 'ended': s.ended} END"""


@query(rf"""WITH {v.CODE_FILE}, f AS (SELECT doc_id, path, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\n\z', ''), chr(10)) END AS l FROM code_file WHERE NOT regexp_matches(text, '[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')),
q AS (SELECT doc_id, path, l, flatten(list_transform([{{'ord': 0, 'a': 1, 'b': 3}}, {{'ord': 1, 'a': 2, 'b': 6}}], lambda x: {_LINE})) AS steps FROM f),
r AS (SELECT doc_id, path, l, list_reduce(steps, lambda s, x: {_STEP}, {{'chars': 600, 'lines': 5, 'used': []::BIGINT[], 'ords': []::INT[], 'ended': -1}}) AS s FROM q),
o AS (SELECT doc_id, path, l, s, unnest([0, 1]) AS ord FROM r), n AS (SELECT *, list_filter(s.used, lambda u, i: s.ords[i] = ord) AS mine FROM o)
SELECT doc_id AS request, ord, path, array_to_string(mine, ',') AS line_numbers, sha256(array_to_string(list_transform(mine, lambda u: u || ': ' || l[u] || chr(10)), '')) AS text, NOT list_has_all(s.used, CASE ord WHEN 0 THEN [1, 2, 3] ELSE [2, 3, 4, 5, 6] END) AS truncated FROM n""")
def bounded_context(spark: SparkSession, d: str) -> DataFrame:
    """Each request takes two overlapping spans of one file."""
    files = v.code_file(spark, d).where(~F.col("text").rlike("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
    spans = files.select(F.col("doc_id").alias("request"), "path", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(1).alias("ord"), F.lit(2).alias("start"), F.lit(6).alias("end")))).alias("s"))
    out = search.context_rows(spans.select("request", "s.ord", "path", "s.start", "s.end"), files, 600, 5)
    return out.withColumns({"line_numbers": F.array_join(F.transform("line_numbers", lambda n: n.cast("string")), ","), "text": F.sha2("text", 256)})


# --- spans of chat turns as symbols: a turn is a span of 10 lines, a conversation a class of all its turns


def _chat_spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = v.chat(spark, d)
    turn = c.select(
        "traj", F.lit("function").alias("kind"), F.concat(F.lit("t"), "pos").alias("name"), F.lit("c").alias("module"), F.concat(F.lit("c.t"), "pos").alias("entity"), (F.col("pos") * 10 + 1).alias("start"), (F.col("pos") * 10 + 7).alias("end"),
        F.lit(0).alias("class_ord"), F.lit(0).alias("is_class"), F.col("pos").alias("member_ord"), "role",
    )
    whole = c.groupBy("traj").agg((F.max("pos") * 10 + 5).alias("end")).select(
        "traj", F.lit("class").alias("kind"), F.lit("c").alias("name"), F.lit("c").alias("module"), F.lit(None).cast("string").alias("entity"), F.lit(1).cast("long").alias("start"), "end", F.lit(0).alias("class_ord"), F.lit(1).alias("is_class"), F.lit(0).cast("long").alias("member_ord"), F.lit(None).cast("string").alias("role")
    )
    lines = c.select("traj", F.explode(F.sequence(F.col("pos") * 10 + 1, F.col("pos") * 10 + 10, F.lit(3).cast("long"))).alias("line"))
    return lines, turn.unionByName(whole)


_SPANS = f"WITH {v.CHAT}, ln AS (SELECT traj, pos, unnest(range(pos * 10 + 1, pos * 10 + 11, 3)) AS line FROM chat), mx AS (SELECT traj, max(pos) * 10 + 5 AS e FROM chat GROUP BY traj)"


@query(_SPANS + " SELECT ln.traj, line, CASE WHEN line <= pos * 10 + 7 THEN 't' || pos WHEN line <= e THEN 'c' END AS name FROM ln JOIN mx USING (traj)")
def line_symbol_range_join(spark: SparkSession, d: str) -> DataFrame:
    lines, spans = _chat_spans(spark, d)
    return symbols.located(lines, spans, ["traj"]).select("traj", "line", "name")


@query(_SPANS + " SELECT ln.traj, line FROM ln JOIN chat USING (traj, pos) WHERE NOT (role = 'user' AND line <= pos * 10 + 7)")
def ignored_span_antijoin(spark: SparkSession, d: str) -> DataFrame:
    lines, spans = _chat_spans(spark, d)
    return symbols.outside(lines, spans.where("role = 'user'"), ["traj"])


# --- chats


@query(f"""WITH {v.CHAT}, s AS (SELECT traj, pos, role, lag(role) OVER w AS before, lead(role) OVER w AS after, count(*) OVER (PARTITION BY traj) AS n FROM chat WINDOW w AS (PARTITION BY traj ORDER BY pos)),
c AS (SELECT traj, 'missing_tool_result' AS code FROM s WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM s p WHERE p.traj = s.traj AND p.role = 'assistant' AND p.pos < s.pos AND coalesce((SELECT role FROM chat x WHERE x.traj = p.traj AND x.pos > p.pos ORDER BY x.pos LIMIT 1), '') <> 'user')
 UNION SELECT traj, 'orphan_chat_tool_result' FROM s WHERE role = 'user' AND before IS DISTINCT FROM 'assistant'
 UNION SELECT traj, 'incomplete_chat_trace' FROM s GROUP BY traj HAVING count(*) FILTER (WHERE role = 'assistant') = 0 OR count(*) FILTER (WHERE role = 'assistant' AND after IS DISTINCT FROM 'user') > 0)
SELECT t.traj, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE code IS NOT NULL), '') AS codes FROM (SELECT DISTINCT traj FROM chat) t LEFT JOIN c USING (traj) GROUP BY t.traj""")
def chat_state_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every assistant message calls once; the user message after it answers."""
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    calls = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("c"), F.col("pos"))))
    rows = v.chat(spark, d).select("traj", F.struct("pos", role.alias("role"), calls.alias("calls"), F.when(F.col("role") == "user", F.concat(F.lit("c"), F.col("pos") - 1)).alias("tool_call_id")).alias("m"))
    return rows.groupBy("traj").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("traj", F.array_join(chat.chat_codes(F.col("ms")), ",").alias("codes"))


@query(f"""WITH {v.CHAT}, a AS (SELECT traj, role, row_number() OVER (PARTITION BY traj ORDER BY pos) AS i, count(*) OVER (PARTITION BY traj) AS n FROM chat)
SELECT traj, CASE WHEN traj % 3 = 0 THEN 'chat_event_mismatch' WHEN traj % 3 = 1 THEN 'chat_action_mismatch' ELSE '' END AS codes FROM a GROUP BY traj""")
def chat_event_agreement(spark: SparkSession, d: str) -> DataFrame:
    base = v.chat(spark, d).select("traj", "pos", F.concat(F.lit("c"), "pos").alias("id"), F.lit("grep").alias("name"), F.create_map(F.lit("pattern"), F.lit("x"), F.lit("include"), F.lit(None).cast("string")).alias("arguments"))
    third = F.col("traj") % 3
    action = F.create_map(F.lit("kind"), F.lit("GrepAction"), F.lit("pattern"), F.when(third == 1, "y").otherwise("x"))
    events = base.select("traj", "pos", F.when(third == 0, F.concat("id", F.lit("z"))).otherwise(F.col("id")).alias("id"), F.col("name").alias("tool_name"), action.alias("action"))
    return chat.calls_agree(base, events).select("traj", F.array_join("codes", ",").alias("codes"))


# --- digests


@query("""WITH f AS (SELECT source, sha256(lang || '/doc_' || doc_id || '.txt' || chr(31) || 'file' || chr(31) || sha256(text)) AS e FROM documents),
s AS (SELECT source, count(*) AS n, sum(('0x' || substr(e, 1, 15))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(e, 16, 15))::BIGINT::HUGEINT) AS b, sum(('0x' || substr(e, 31, 15))::BIGINT::HUGEINT) AS c, sum(('0x' || substr(e, 46, 15))::BIGINT::HUGEINT) AS d FROM f GROUP BY source)
SELECT source, sha256(n || '|' || a || '|' || b || '|' || c || '|' || d) AS digest FROM s""")
def tree_digest(spark: SparkSession, d: str) -> DataFrame:
    files = v.table(spark, d, "documents").select("source", F.concat("lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.lit("file").alias("kind"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("link_target"))
    return digest.tree_digest(files, "source")


@query("""SELECT doc_id, sha256('{"p0":"' || source || '","p1":' || CASE WHEN lang = 'en' THEN 'null' ELSE '"' || lang || '"' END || '}') AS key FROM documents""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", digest.cache_key(F.col("source"), F.when(F.col("lang") != "en", F.col("lang"))).alias("key"))


# --- diffs and symbols: small patches and sources made from document numbers


def _patched(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, repo, path, patch, problem_statement, text): a function's body line changes, a method goes, or a file comes or isn't Python. The method before has up to three lines more."""
    k, more = F.col("doc_id") % 5, (F.col("doc_id") % 4).cast("int")
    path = F.concat(F.lit("m"), "doc_id", F.when(k == 3, ".md").otherwise(".py"))
    body = F.concat(F.lit("import os\n\n\nclass A:\n    def run(self):\n"), F.repeat(F.lit("        x = 1\n"), more), F.lit("        return 1\n\n    def stop(self):\n        return 2\n\n\ndef free():\n    return 3\n"))
    at = lambda n: (more + n).cast("string")
    edit = F.concat(F.lit("@@ -"), at(12), F.lit(",2 +"), at(12), F.lit(",2 @@\n def free():\n-    return 3\n+    return 4\n"))
    drop = F.concat(F.lit("@@ -"), at(6), F.lit(",5 +"), at(6), F.lit(",2 @@\n         return 1\n \n-    def stop(self):\n-        return 2\n-\n"))
    old = F.when(k == 2, F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), path))
    hunk = F.when(k == 1, drop).when(k == 2, F.lit("@@ -0,0 +1,1 @@\n+x = 1\n")).when(k == 4, F.lit("@@ -1,9 +1,1 @@\n-broken\n")).otherwise(edit)
    return v.table(spark, d, "documents").select(
        F.concat(F.lit("i-"), "doc_id").alias("instance_id"), "doc_id", F.concat(F.lit("org/"), "source").alias("repo"), path.alias("path"), F.concat(F.lit("--- "), old, F.lit("\n+++ b/"), path, F.lit("\n"), hunk).alias("patch"),
        F.when(F.col("doc_id") % 11 == 0, " ").when(F.col("doc_id") % 11 == 1, "\n\t\u00a0").otherwise("fix").alias("problem_statement"), body.alias("text"),
    )


#: The same patches, cut into lines; a hunk is sound if its header counts its lines.
_PATCHED = r"""p AS (SELECT doc_id, source, doc_id % 4 AS more, CASE doc_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN chr(10) || chr(9) || chr(160) ELSE 'fix' END AS statement, 'm' || doc_id || CASE WHEN doc_id % 5 = 3 THEN '.md' ELSE '.py' END AS path FROM documents),
h AS (SELECT *, [CASE WHEN doc_id % 5 = 2 THEN '--- /dev/null' ELSE '--- a/' || path END, '+++ b/' || path] || CASE doc_id % 5 WHEN 1 THEN ['@@ -' || more + 6 || ',5 +' || more + 6 || ',2 @@', '         return 1', ' ', '-    def stop(self):', '-        return 2', '-']
  WHEN 2 THEN ['@@ -0,0 +1,1 @@', '+x = 1'] WHEN 4 THEN ['@@ -1,9 +1,1 @@', '-broken'] ELSE ['@@ -' || more + 12 || ',2 +' || more + 12 || ',2 @@', ' def free():', '-    return 3', '+    return 4'] END AS l FROM p),
c AS (SELECT *, l[4:] AS b, regexp_extract(l[3], '-\d+,(\d+)', 1)::INT AS n_old, regexp_extract(l[3], '\+\d+,(\d+)', 1)::INT AS n_new, regexp_extract(l[3], '-(\d+)', 1)::INT AS first FROM h),
d AS (SELECT *, len(list_filter(b, lambda x: x[1] <> '+')) = n_old AND len(list_filter(b, lambda x: x[1] <> '-')) = n_new AS sound FROM c),
e AS (SELECT *, CASE WHEN regexp_replace(statement, '[\s\x{a0}]+', '', 'g') = '' THEN 'empty_problem_statement' WHEN NOT sound THEN 'invalid_patch' WHEN l[1] LIKE '%/dev/null' OR l[2] LIKE '%/dev/null' THEN 'creates_or_deletes_file' WHEN path NOT LIKE '%.py' THEN 'no_python_changes' END AS reason FROM d)"""


@query(f"WITH {_PATCHED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM e GROUP BY 1")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _patched(spark, d)
    told = diffs.parse(rows).join(rows.select("instance_id", "problem_statement"), "instance_id")
    return told.groupBy(F.coalesce(diffs.eligibility(F.col("problem_statement"), F.col("error"), F.col("lines")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PATCHED} SELECT 'i-' || doc_id AS instance_id, CASE WHEN sound THEN len(b) ELSE 0 END::BIGINT AS n_lines, CASE WHEN sound THEN len(list_filter(b, lambda x: x[1] = '-')) ELSE 0 END::BIGINT AS n_removed FROM d""")
def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    out = diffs.parse(_patched(spark, d))
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long")
    return out.select("instance_id", n("lines").alias("n_lines"), n(F.filter("lines", lambda x: x["line_type"] == "-")).alias("n_removed"))


_SYMBOLS = """y AS (SELECT doc_id, source, path, more, s.name, s.a + CASE WHEN s.late THEN more ELSE 0 END AS "start", s.b + more AS "end" FROM p, (VALUES ('A', 4, 9, FALSE), ('A.run', 5, 6, FALSE), ('A.stop', 8, 9, TRUE), ('free', 12, 13, TRUE)) s(name, a, b, late))"""


@query(f"""WITH {_PATCHED}, {_SYMBOLS} SELECT DISTINCT source AS repo, name, "start", "end" FROM y""")
def py_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Distinct symbols of the files of each repository."""
    files = _patched(spark, d).select(F.expr("substring(repo, 5)").alias("repo"), "path", "text")
    return symbols.spans(files, "repo", "path").select("repo", F.explode("rows").alias("r")).where("r.kind <> 'ignored'").select("repo", "r.name", "r.start", "r.end").distinct()


@query(f"""WITH {_PATCHED}, {_SYMBOLS}, g AS (SELECT * FROM e WHERE reason IS NULL),
r AS (SELECT doc_id, path, first + i - 1 - len(list_filter(b[:i], lambda x: x[1] = '+')) AS line FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM g) WHERE b[i][1] = '-' AND trim(b[i][2:]) <> ''),
t AS (SELECT DISTINCT r.doc_id, r.path, y.name FROM r JOIN y ON y.doc_id = r.doc_id AND line BETWEEN y."start" AND y."end" AND y.name <> 'A'),
x AS (SELECT t.*, g.b AS b FROM t JOIN g USING (doc_id))
SELECT 'i-' || doc_id AS instance_id, CASE WHEN list_contains(b, '-    def ' || split_part(name, '.', 2) || '(self):') THEN path || ':' || name END AS added, CASE WHEN NOT list_contains(b, '-    def ' || split_part(name, '.', 2) || '(self):') THEN path || ':' || name END AS edited,
 path || ':' || split_part(name, '.', 1) AS modules FROM x""")
def change_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all patches that become a task."""
    rows = _patched(spark, d)
    made, _ = build.task_rows(rows.select("instance_id", "repo", "patch", "problem_statement"), rows.select("repo", "path", "text"))
    c = F.col("file_changes")[0]["changes"]
    return made.select("instance_id", F.array_join(c["added_entities"], ",").alias("added"), F.array_join(c["edited_entities"], ",").alias("edited"), F.array_join(c["edited_modules"], ",").alias("modules"))


@query(f"WITH {_PATCHED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, CASE WHEN reason IS NOT NULL THEN array_to_string(list_sort(list('i-' || doc_id))[:20], ',') END AS examples FROM e GROUP BY reason")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of raw rows, with the first ids of each reason."""
    rows = _patched(spark, d)
    out = build.report(*build.task_rows(rows.select("instance_id", "repo", "patch", "problem_statement"), rows.select("repo", "path", "text")))
    return out.select("reason", "n", F.array_join("examples", ",").alias("examples"))


@query(f"WITH {_PATCHED} SELECT 'i-' || doc_id AS instance_id, 'org/' || source AS repo, statement AS problem_statement, sha256(array_to_string(l, chr(10)) || chr(10)) AS patch, path AS target, 'user: ' || statement AS prompt, TRUE AS use_patch, NULL::VARCHAR AS base_commit FROM e WHERE reason IS NULL")
def task_rows(spark: SparkSession, d: str) -> DataFrame:
    """The nine columns of tasks."""
    rows = _patched(spark, d)
    made, _ = build.task_rows(rows.select("instance_id", "repo", "patch", "problem_statement"), rows.select("repo", "path", "text"))
    prompt = F.concat(F.col("prompt")[0]["role"], F.lit(": "), F.col("prompt")[0]["content"])
    return made.select("instance_id", "repo", "problem_statement", F.sha2("patch", 256).alias("patch"), F.col("target")[0]["file"].alias("target"), prompt.alias("prompt"), "use_patch", "base_commit")


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'location file does not exist' WHEN doc_id % 4 = 1 THEN 'symbol does not exist' END AS error, count(*) AS n FROM documents GROUP BY 1""")
def finish_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    rows = v.table(spark, d, "documents").select(F.when(k == 0, "gone.py").otherwise("m.py").alias("file"), F.when(k == 1, "B").when(k == 2, "A").alias("class_name"), F.when(k == 2, "run").alias("function_name"))
    files = spark.range(1).select(F.lit("m.py").alias("path"))
    known = spark.range(2).select(F.lit("m.py").alias("path"), F.when(F.col("id") == 0, "A").otherwise("A.run").alias("name"))
    return search.finish_errors(rows, files, known).groupBy("error").agg(F.count("*").alias("n"))


# --- export and streams


@query(f"""WITH {v.CHAT}, g AS (SELECT *, greatest(1, chars // 40) AS n FROM chat)
SELECT 'conv-' || traj AS instance_id, to_json(list({{'role': role, 'digest': sha256(text)}} ORDER BY pos))::VARCHAR AS messages, array_to_string(range(1, sum(n)::BIGINT + 1), ',') AS input_ids, string_agg(array_to_string(list_transform(range(n), lambda i: (role = 'assistant')::INT), ','), ',' ORDER BY pos) AS loss_mask
FROM g GROUP BY traj HAVING bool_or(role = 'assistant')""")
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    """SFT rows of chats that have an assistant message: nested messages, token ids and mask."""
    n = F.greatest(F.lit(1), F.floor(F.col("chars") / 40)).cast("int")
    rows = v.chat(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("pos", "role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), n.alias("n")))).alias("m"))
    message = F.transform("m", lambda x: F.struct(x["role"].alias("role"), text.message_text(x["content"]).alias("content")))
    mask = F.flatten(F.transform("m", lambda x: F.array_repeat((x["role"] == "assistant").cast("long"), x["n"])))
    out = rows.where(F.exists("m", lambda x: x["role"] == "assistant")).select(F.concat(F.lit("conv-"), "traj").alias("instance_id"), message.alias("messages"), F.sequence(F.lit(1).cast("long"), F.size(mask).cast("long")).alias("input_ids"), mask.alias("loss_mask"))
    path = f"{loaders.shared_folder(spark)}/nested"
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    said = F.to_json(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.sha2(m["content"], 256).alias("digest"))))
    return back.select("instance_id", said.alias("messages"), joined("input_ids").alias("input_ids"), joined("loss_mask").alias("loss_mask"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def streaming_counts(spark: SparkSession, d: str) -> DataFrame:
    """A bounded stream over the events table, counted by window and then summed up."""
    from ..streaming import metrics

    stream = v.stream(spark, d, "events")
    folder = loaders.shared_folder(spark)
    metrics.batch_query(metrics.windowed_counts(stream), f"{folder}/counts", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/counts").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
