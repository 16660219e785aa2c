"""Operators: boundary cases, and order-sensitive ones against sequential Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import chat, diffs, digest, evaluate, events, search, symbols, tasks

EVENTS = "traj long, seq int, kind string, tool_name string, tool_call_id string, llm_response_id string, pattern string, path string, include string, start_line int, end_line int, text_chars int, is_error boolean, truncated boolean, response_tokens int"


def _run(changes=()):
    """A valid trajectory: grep, read, finish."""
    rows = []
    for i, (tool, pattern, path, a, b) in enumerate((("grep", "add", None, None, None), ("read_file", None, "a.py", 1, 2), ("localization_finish", None, None, None, None))):
        rows.append([1, 3 * i, "TokenEvent", None, None, f"r{i}", None, None, None, None, None, None, None, None, 2])
        rows.append([1, 3 * i + 1, "ActionEvent", tool, str(i), f"r{i}", pattern, path, None, None, None, None, None, None, None])
        rows.append([1, 3 * i + 2, "ObservationEvent", tool, str(i), f"r{i}", None, path, None, a, b, 15, False, False, None])
    for i, column, value in changes:
        if column is None:
            rows[i] = None
        else:
            rows[i][[x.split()[0] for x in EVENTS.split(", ")].index(column)] = value
    return [tuple(r) for r in rows if r]


@pytest.mark.parametrize(
    "changes,codes",
    [
        ((), []),
        (((8, "is_error", True),), ["tool_error"]),
        (((2, None, None),), ["unpaired_action"]),
        (((5, "tool_name", "glob"),), ["observation_mismatch"]),
        (((2, "seq", 0),), ["observation_mismatch"]),
        (((1, "tool_call_id", None),), ["invalid_tool_call_ids"]),
        (((1, None, None),), ["orphan_observation"]),
        (((7, None, None), (8, None, None)), ["missing_or_multiple_finish"]),
        (((4, "llm_response_id", "r2"),), ["finish_not_sole_final_call"]),
        (((0, "kind", "AgentErrorEvent"),), ["agent_error"]),
        (((0, "kind", None),), ["invalid_events"]),
    ],
)
def test_validate(spark, changes, codes):
    assert events.validate(spark.createDataFrame(_run(changes), EVENTS)).first()["codes"] == codes


def test_metrics(spark):
    rows = _run() + [tuple([2, *r[1:]]) for r in _run()] + [tuple([2, r[1] + 100, *r[2:4], f"x{r[4]}" if r[4] else None, *r[5:]]) for r in _run()[:6]]
    got = {r["traj"]: r for r in events.tool_metrics(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got[1]["num_tool_calls"] == 3 and got[1]["read_lines"] == 2 and got[1]["output_chars"] == 30 and got[1]["completion_tokens"] == 6
    assert got[2]["repeated_searches"] == 1 and got[2]["overlap_lines"] == 2 and got[2]["overlap_ratio"] == 0.5


def test_greedy_two_keys(spark):
    rnd = random.Random(5)
    for n, keys in ((3, 0), (60, 15), (60, 40)):
        rows = [(1, "a", "k1"), (2, "b", "k1"), (3, "b", "k2")] if not keys else [(i, f"a{rnd.randrange(keys)}", f"b{rnd.randrange(keys)}") for i in range(n)]
        a, b, want = set(), set(), []
        for o, x, y in rows:
            if x not in a and y not in b:
                a.add(x), b.add(y), want.append(o)
        got = tasks.greedy_two_keys(spark.createDataFrame(rows, "o int, x string, y string"), "o", "x", "y")
        assert sorted(r["o"] for r in got.collect()) == want


def test_shuffled_split(spark):
    n, seed = 50, 3
    want = list(range(n))
    random.Random(seed).shuffle(want)
    got = tasks.shuffled_split(spark.range(n), "id", 7, seed).where("split = 'validation'").collect()
    assert sorted(r["id"] for r in got) == sorted(want[-7:])
    with pytest.raises(ValueError):
        tasks.shuffled_split(spark.range(3), "id", 3, 0)


def test_outcomes(spark):
    t, o = spark.createDataFrame([("a",), ("b",)], "instance_id string"), spark.createDataFrame([("a", True, None), ("z", False, None)], "instance_id string, resolved boolean, source string")
    parts = evaluate.outcome_rows(t, o)
    assert evaluate.resolve_rates(parts["evaluated"]).first().asDict() == {"source": "coding_agent", "evaluated": 1, "resolved": 1, "resolve_rate": 1.0}
    assert parts["missing_ids"].first()[0] == "b" and parts["unmatched_ids"].first()[0] == "z"
    assert evaluate.unique_or_raise(t, "instance_id", "task").count() == 2
    with pytest.raises(Exception, match="duplicate"):
        evaluate.unique_or_raise(t.union(t), "instance_id", "task").collect()


FILES = "path string, text string"


def test_glob_limit(spark):
    files = spark.createDataFrame([(f"file_{i:03d}.py", "") for i in range(250)] + [("__pycache__/a.py", "")], FILES)
    rows = search.glob_search(files, "*.py").collect()
    assert sorted(r["path"] for r in rows) == [f"file_{i:03d}.py" for i in range(100)] and all(r["truncated"] for r in rows)


def test_grep(spark):
    files = spark.createDataFrame([("a/x.py", "class Parser:\n"), ("a-b/x.ts", "class  Parser\r\n"), ("n.py", "class Parser\0"), (".h/x.py", "class Parser")], FILES)
    assert [(r["path"], r["line"], r["text"]) for r in search.grep_search(files, r"class\s+Parser").orderBy(F.split("path", "/")).collect()] == [("a/x.py", 1, "class Parser:"), ("a-b/x.ts", 1, "class  Parser")]
    assert [r["path"] for r in search.grep_search(files, r"class\s+Parser", "*.{ts,tsx}").collect()] == ["a-b/x.ts"]
    many = spark.createDataFrame([("m", "x\n" * 101), ], FILES)
    rows = search.grep_search(many, "x").collect()
    assert len(rows) == 100 and rows[0]["truncated"]
    long = search.grep_search(spark.createDataFrame([("m", "y" * 100_000)], FILES), "y").first()
    assert len(long["text"]) <= 30_000 and long["truncated"]
    for bad in ("[", "(?=a)", r"(a)\1", ""):
        with pytest.raises(ValueError):
            search.grep_search(files, bad)


def test_read(spark):
    read = lambda t, a=None, b=None: search.read_lines(spark.createDataFrame([("f", t)], FILES), a and F.lit(a), b and F.lit(b)).first()
    r = read("first\nsecond\nthird\nfourth\n", 2, 3)
    assert r["text"] == "     2→second\n     3→third" and r["total_lines"] == 4 and not r["truncated"]
    assert read("x\n" * 201)["truncated"] and read("z" * 30_001)["truncated"]
    e = read("")
    assert (e["start_line"], e["end_line"], e["error"]) == (1, 0, None)
    assert read("a\0b")["error"] and read("a\n", 1, 501)["error"] and read("a\n", 5, 6)["error"] and read("a\n", 2, 1)["error"]


def test_bounded_context(spark):
    rnd = random.Random(2)
    texts = {f"f{i}": "\n".join("w" * rnd.randint(0, 12) for _ in range(rnd.randint(1, 12))) for i in range(4)}
    spans = [(q, k, f"f{rnd.randrange(4)}", (a := rnd.randint(1, 8)), a + rnd.randint(0, 6)) for q in range(25) for k in range(rnd.randint(1, 4))]
    got = {(r["request"], r["ord"]): r for r in search.context_rows(spark.createDataFrame(spans, "request int, ord int, path string, start int, end int"), spark.createDataFrame(list(texts.items()), FILES), 60, 6).collect()}
    for q in range(25):
        used, chars, left = set(), 60, 6
        want = {}
        for _, k, p, a, b in sorted(s for s in spans if s[0] == q):
            out = []
            for n, line in enumerate(texts[p].splitlines(), 1):
                if not a <= n <= b or (p, n) in used:
                    continue
                s = f"{n}: {line}\n"
                if len(s) > chars or not left:
                    break
                out.append((n, s))
                used.add((p, n))
                chars, left = chars - len(s), left - 1
            want[k] = out
        for k, out in want.items():
            assert got[q, k]["line_numbers"] == [n for n, _ in out] and got[q, k]["text"] == "".join(s for _, s in out)


def test_patch_application():
    lines = [dict(zip([x.split()[0] for x in diffs.LINE_SCHEMA.split(", ")], r)) for r in diffs.diff_lines("--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n def answer():\n-    return 41\n\\ No newline at end of file\n+    return 42\n")]
    assert diffs.apply_lines("def answer():\r\n    return 41", lines) == "def answer():\r\n    return 42\n"
    with pytest.raises(diffs.PatchError):
        diffs.apply_lines("other\n", lines)
    for bad in ("--- a/x\n@@ -1 +1 @@\n", "--- a/x\n+++ b/x\n@@ -1,3 +1,1 @@\n-a\n"):
        with pytest.raises(diffs.PatchError):
            list(diffs.diff_lines(bad))


def test_symbol_lookup_order():
    rows = symbols.span_rows('"""d"""\nimport os\nX = 1\n# c\nclass A:\n    "doc"\n    def run(self):\n        return 1  # in\n\ndef f():\n    def g():\n        pass\n')
    named = [(r[1], r[4], r[5]) for r in rows if r[0] != "ignored"]
    assert named == [("A.run", 7, 8), ("A", 5, 8), ("f", 10, 12), ("g", 11, 12)]
    assert sorted((r[4], r[5]) for r in rows if r[0] == "ignored") == [(2, 2), (3, 3), (4, 4), (6, 6)]


def test_change_labels(spark):
    patch = "--- a/s.py\n+++ b/s.py\n@@ -1,4 +1,2 @@\n class Service:\n     x = 0\n-    def restore_me(self):\n-        return 1\n"
    src = "class Service:\n    x = 0\n    def restore_me(self):\n        return 1\n"
    out = symbols.change_labels(spark.createDataFrame([("i", "r", patch), ("j", "r2", patch)], "instance_id string, repo string, patch string"), spark.createDataFrame([("r", "s.py", src)], "repo string, path string, text string"))
    got = {r["instance_id"]: r for r in out.collect()}
    c = got["i"]["file_changes"][0]["changes"]
    assert (c["added_entities"], c["edited_modules"], c["added_modules"]) == (["s.py:Service.restore_me"], ["s.py:Service"], None)
    assert got["j"]["error"] == "source_fetch_error"


MSGS = "array<struct<role:string,calls:array<string>,tool_call_id:string>>"


@pytest.mark.parametrize(
    "ms,codes",
    [
        ([("user", None, None), ("assistant", ["a"], None), ("tool", None, "a")], []),
        ([("assistant", ["a"], None), ("assistant", ["b"], None), ("tool", None, "a"), ("tool", None, "b")], ["missing_tool_result"]),
        ([("assistant", ["a"], None), ("tool", None, "x")], ["incomplete_chat_trace", "orphan_chat_tool_result"]),
        ([("user", None, None)], ["incomplete_chat_trace"]),
        ([("robot", None, None), ("tool", None, "x")], ["invalid_chat_role"]),
        ([("assistant", ["a", "a"], None)], ["invalid_chat_tool_ids"]),
    ],
)
def test_chat(spark, ms, codes):
    assert spark.createDataFrame([(ms,)], f"m {MSGS}").select(chat.chat_codes(F.col("m"))).first()[0] == codes


def test_tree_digest(spark, tmp_path):
    from tracewell.sources import tree

    tree.register(spark)

    def now():
        rows = spark.read.format("code_tree").load(str(tmp_path))
        return digest.tree_digest(rows.withColumn("r", F.lit(1)), "r").first()["digest"]

    (tmp_path / "a.py").write_text("x")
    (tmp_path / ".hidden").write_text("h")
    seen = [now()]
    (tmp_path / "a.py").write_text("y")
    seen.append(now())
    (tmp_path / "empty").mkdir()
    seen.append(now())
    (tmp_path / "link").symlink_to("/etc")
    seen.append(now())
    assert len(set(seen)) == 4
    rows = {r["path"]: r for r in spark.read.format("code_tree").load(str(tmp_path)).collect()}
    assert not rows["link"]["inside"] and rows["link"]["link_target"] == "/etc" and ".hidden" in rows


def test_whole_sequences(spark):
    """Trajectories that part after the third event, act late, act in several ways, or never act."""
    from tracewell.operators import export

    def acts(traj, *actions, first=1):
        return [(traj, first + 2 * i, "ActionEvent", tool, f"c{traj}-{i}", f"r{traj}-{i}", pattern, path, None, start, start, None, None, None, None) for i, (tool, pattern, path, start) in enumerate(actions)]

    same = [("grep", "a", "x", None), ("glob", "b", "y", None), ("grep", "c", "z", None)]
    turn = lambda traj: (traj, 1, "TokenEvent", *[None] * 11, 5)
    log = acts(1, *same, ("grep", "d", "z", None)) + acts(2, *same, ("grep", "e", "z", None)) + acts(3, *same, ("grep", "d", "./z", None))
    log += acts(4, *same, first=20) + acts(5, *same[:2]) + [turn(6), turn(7)]
    log += acts(8, ("read_file", None, "x", 1)) + acts(9, ("read_file", None, "x", 2)) + acts(10, ("grep", "p q", "r", None)) + acts(11, ("grep", "p", "q r", None))
    kept = export.first_of_sequence(export.action_steps(spark.createDataFrame(log, EVENTS)), "traj", "steps")
    assert sorted(r["traj"] for r in kept.collect()) == [1, 2, 4, 5, 6, 8, 9, 10, 11]


def test_whole_sequences_of_events(spark):
    """Against plain Python over the smallest tables."""
    from tracewell.plans import relational, views

    seen = {}
    for r in views.event_log(spark, "/root/testdata/sf0.001").orderBy("traj", "seq").collect():
        seen.setdefault(r["traj"], []).extend([(r["tool_name"], r["pattern"], r["path"])] if r["kind"] == "ActionEvent" else [])
    first = {}
    for t in sorted(seen):
        first.setdefault(tuple(seen.get(t // 3 * 3, [])), t)
    assert sorted(r["traj"] for r in relational.trajectory_dedup(spark, "/root/testdata/sf0.001").collect()) == sorted(first.values())


def test_two_keys_of_many_tasks(spark, tmp_path):
    """More tasks than 900 with texts of their own; every 50th clashes with its neighbour, kept or not."""
    from tracewell.functions.text import task_key
    from tracewell.operators.tasks import first_error
    from tracewell.plans import relational, views

    rows = [(i, f"text {i if i % 7 else i // 70}", "en", "s", 9) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    told = views.task_row_clashing(spark, str(tmp_path))
    none = lambda kind: F.lit(None).cast(kind)
    keyed = told.select("ord", "instance_id", first_error(told).alias("bad"), task_key(F.col("repo"), none("string"), F.col("problem_statement"), none("string"), none("boolean")).alias("key"))
    ids, keys, want = set(), set(), []
    for r in sorted(keyed.where("bad IS NULL").collect()):
        if r["instance_id"] not in ids and r["key"] not in keys:
            ids.add(r["instance_id"])
            keys.add(r["key"])
            want.append(r["ord"])
    got = sorted(r["ord"] for r in relational.two_key_greedy_dedup(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 900
    assert told.select("instance_id").distinct().count() == 2000 - 40


def test_labels_and_symbols_of_every_row(spark, monkeypatch):
    """Patches are chosen by what they are, not by number, and every file of a repository is parsed."""
    from tracewell.plans import code

    edit = "--- {0}\n+++ b/{1}\n@@ -1,2 +1,2 @@\n def {2}():\n-    return 1\n+    return 2\n"
    files = [(2, "m2.py", edit.format("a/m2.py", "m2.py", "two"), "def two():\n    return 1\n"), (3, "m3.py", edit.format("a/m3.py", "m3.py", "three"), "def three():\n    return 1\n")]
    bad = [(5, "m5.md", edit.format("a/m5.md", "m5.md", "x"), "def five():\n    return 1\n"), (6, "m6.py", edit.format("/dev/null", "m6.py", "x"), "def six():\n    return 1\n"), (10, "m10.py", "@@ broken", "def ("), (11, "m11.py", "--- a/m11.py\n+++ b/m11.py\n@@ -1,9 +1,1 @@\n-broken\n", "x = 1\n")]
    rows = spark.createDataFrame([(f"i-{n}", n, "org/r", path, patch, "fix", text) for n, path, patch, text in files + bad], "instance_id string, doc_id long, repo string, path string, patch string, problem_statement string, text string")
    monkeypatch.setattr(code, "_patched", lambda spark, d: rows)
    assert sorted(tuple(r[c] for c in ("instance_id", "edited")) for r in code.change_labels(spark, "").collect()) == [("i-2", "m2.py:two"), ("i-3", "m3.py:three")]
    assert sorted(r["name"] for r in code.py_symbols(spark, "").collect()) == ["five", "six", "three", "two"]
