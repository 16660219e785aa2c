"""Ignore files: single rules, and whole trees against a walk in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from tracewell.operators import ignores, search


@pytest.mark.parametrize(
    "line,yes,no",
    [
        ("*.log", ["a.log", "x/y/b.log"], ["a.logs", "log"]), ("/top.txt", ["top.txt"], ["x/top.txt"]), ("a/b", ["a/b"], ["x/a/b", "a/b/c"]), ("doc/**", ["doc/a", "doc/a/b"], ["doc", "x/doc/a"]),
        ("**/cache", ["cache", "x/cache", "x/y/cache"], ["caches"]), ("a/**/z", ["a/z", "a/b/c/z"], ["az"]), ("t[0-9]?.py", ["t1x.py", "d/t23.py"], ["tx1.py", "t1/.py"]), ("[!a]b", ["xb"], ["ab", "/b"]), ("[^a]b", ["xb"], ["ab"]),
        (r"\!x", ["!x", "d/!x"], ["x"]), (r"\#y", ["#y"], []), ("z\\ ", ["z "], ["z"]), ("q  ", ["q", "a/q"], ["q  "]), ("a\\*b", ["a*b"], ["axb"]), ("f(1).txt", ["f(1).txt"], ["f1.txt"]), ("ab**c", ["abxc", "abc"], ["ab/c"]), ("x\r", ["x"], []),
    ],
)
def test_rules(line, yes, no):
    r = re.compile(ignores.rule(line)[2].replace(r"\z", r"\Z"))
    assert all(r.search(x) for x in yes) and not any(r.search(x) for x in no)


def test_rules_that_are_none():
    assert all(ignores.rule(x) is None for x in ("", "   ", "# note", "/", "!/", "\r"))
    assert ignores.rule("!keep/")[:2] == (True, True) and ignores.rule("x")[:2] == (False, False)


def walk(files, git, hidden=False, below=""):
    """{path: (left out, shut, admitted)}: down from the root, directory by directory."""
    kinds = ignores.KINDS if git else ignores.KINDS[:-1]
    texts = dict(files)

    def said(entry, folder):
        parts = entry.split("/")
        for kind in kinds:
            for n in range(len(parts) - 1, -1, -1):
                name = "/".join([*parts[:n], kind])
                for line in reversed((texts.get(name) or "").split("\n")):
                    r = ignores.rule(line)
                    if r and (folder or not r[1]) and re.search(r[2].replace(r"\z", r"\Z"), "/".join(parts[n:])):
                        return r[0]
        return None

    def closed(entry, folder):
        admits = said(entry, folder)
        return admits is False or (admits is None and hidden and entry.split("/")[-1].startswith("."))

    out = {}
    for path in texts:
        parts = path.split("/")
        above = ["/".join(parts[:n]) for n in range(1, len(parts))]
        shut = any(closed(d, True) for d in above if not below or d.startswith(below + "/"))
        out[path] = (shut or closed(path, False), shut, not shut and said(path, False) is True)
    return out


def trees(seed):
    """Nested ignore files of all kinds over two trees, and a tree without any."""
    rnd = random.Random(seed)
    rules = ["*.log", "!*.log", "/a", "a/", "!a/", "b/c", "**/c", "c/**", "!c/x.log", "x.*", "!x.txt", "[xy].txt", "# no", "", "!.h*", ".h*", "a/**/x.txt", "y.txt/", "!.h/"]
    rows = []
    for repo in ("p", "q"):
        for d in ["", "a/", "a/b/", "a/b/c/", "b/", "b/c/", "c/", "c/a/", ".h/"]:
            rows += [(repo, f"{d}{n}", f"text of {n}\n") for n in ("x.log", "x.txt", "y.txt", ".hid", "z")]
            rows += [(repo, d + kind, "\n".join(rnd.choices(rules, k=rnd.randint(1, 5)))) for kind in ignores.KINDS if rnd.random() < 0.4]
    return [*rows, ("none", "a/x.log", None)]


@pytest.mark.parametrize("git,hidden,below", [(True, False, ""), (False, True, ""), (True, True, "a")])
def test_trees(spark, git, hidden, below):
    rows = trees(int(git) + 2 * int(hidden))
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    got = {(r["repo"], r["path"]): (r["left_out"], r["shut"], r["admitted"]) for r in ignores.verdicts(df, "repo", git=git, hidden=hidden, below=below).collect()}
    want = {(repo, p): v for repo in ("p", "q", "none") for p, v in walk([r[1:] for r in rows if r[0] == repo], git, hidden, below).items()}
    assert got == want
    assert len({v for v in want.values()}) >= 3
    assert ignores.verdicts(spark.createDataFrame([], "path string, text string")).count() == 0


@pytest.mark.parametrize("path,include", [(None, None), ("a", None), ("a/b/x.txt", None), (None, "*.txt"), (None, "!*.txt"), (None, ".h*")])
def test_grep_leaves_out(spark, path, include):
    """A search keeps to ignore files; `include` admits files, but none under a directory that is left out; a file named itself is searched."""
    rows = [r[1:] for r in trees(5) if r[0] == "p"]
    got = {r["path"] for r in search.grep_search(spark.createDataFrame(rows, "path string, text string"), "text of", include, path=path).collect()}
    below = "" if path is None or path.endswith(".txt") else path
    want = set()
    for p, (out, shut, _) in walk(rows, True, True, below).items():
        fits = bool(include) and re.search(search.include_regex(include.lstrip("!")).replace(r"\z", r"\Z"), p) is not None
        ok = not out if not include else not out and not fits if include.startswith("!") else fits and not shut
        if "text of" in dict(rows)[p] and (p == path or (ok and (not below or p.startswith(below + "/")) and (path is None or below))):
            want.add(p)
    assert got == want
