"""Links against the operating system's own resolution of a tree on disk."""

from __future__ import annotations

import errno
import os
import random

import pytest

from tracewell.operators import links
from tracewell.sources import tree

SCHEMA = "path string, kind string, link_target string"


def on_disk(root):
    """{path: (status, target)} of the links of a tree, by the system; what is beyond a missing name is taken part by part."""
    out = {}
    for folder, dirs, names in os.walk(root):
        for n in [*dirs, *names]:
            full = os.path.join(folder, n)
            if not os.path.islink(full):
                continue
            path, real = os.path.relpath(full, root), os.path.realpath(full)
            try:
                os.stat(full)
            except OSError as e:
                if e.errno == errno.ELOOP or os.path.islink(real):
                    out[path] = ("cycle", None)
                    continue
            inside = real == root or real.startswith(root + os.sep)
            target = "" if real == root else os.path.relpath(real, root)
            out[path] = ("dir" if os.path.isdir(real) else "file" if os.path.isfile(real) else "missing", target) if inside else ("escape", None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_system(spark, tmp_path, seed):
    rnd = random.Random(seed)
    root = str(tmp_path / "tree")
    dirs = ["", "a", "a/b", "c", "c/d/e"]
    for d in dirs:
        os.makedirs(os.path.join(root, d), exist_ok=True)
        for n in ("f", "g"):
            open(os.path.join(root, d, n), "w").close()
    for i in range(60):
        d = rnd.choice(dirs)
        up = "/".join([".."] * (d.count("/") + 1 if d else 0))
        to = rnd.choice([f"l{rnd.randrange(60)}", "f", ".", f"{up or '.'}/{rnd.choice(dirs) or '.'}/{rnd.choice(['f', 'l3', 'l7/f', 'l1/l2', 'l5/../g', 'nothing'])}", f"./{rnd.choice(['b', 'd', 'l4'])}/../f", f"l{i}"])
        os.symlink(to, os.path.join(root, d, f"l{i}"))
    tree.register(spark)
    entries = spark.read.format("code_tree").load(root).select("path", "kind", "link_target")
    got = {r["path"]: (r["status"], r["target"]) for r in links.resolved(entries).collect()}
    want = on_disk(root)
    assert got.keys() == want.keys()
    assert got == want
    assert {s for s, _ in want.values()} >= {"file", "dir", "missing", "cycle"}


def test_chains_and_escapes(spark, monkeypatch):
    monkeypatch.setattr(links, "MOST_HOPS", 6)
    rows = [(f"k{i}", "link", f"k{i + 1}") for i in range(5)] + [("k5", "link", "end"), ("end", "file", None), ("over", "link", "k0"), ("grows", "link", "grows/x")]
    rows += [("out", "link", "../x"), ("by_out", "link", "out/y"), ("abs", "link", "/etc"), ("back", "link", "d/../../up/d"), ("d/f", "file", None), ("root", "link", "d/.."), ("through", "link", "root/root/d/f"), ("self", "link", "self"), ("p", "link", "q"), ("q", "link", "p")]
    got = {r["path"]: (r["status"], r["target"], r["hops"]) for r in links.resolved(spark.createDataFrame([("t", *r) for r in rows], f"tree string, {SCHEMA}"), "tree").collect()}
    assert got["k0"] == ("file", "end", 6) and got["k5"] == ("file", "end", 1)
    assert [got[x][0] for x in ("out", "by_out", "abs", "back")] == ["escape"] * 4
    assert got["root"] == ("dir", "", 1) and got["through"] == ("file", "d/f", 3)
    assert {got[x] for x in ("self", "p", "q", "over", "grows")} == {("cycle", None, None)}
    assert links.resolved(spark.createDataFrame([], SCHEMA)).count() == 0
