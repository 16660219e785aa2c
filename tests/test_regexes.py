"""The search dialect: what each expression matches in the JVM, what is refused, and what a match needs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions.regexes import ExpressionError, translated
from tracewell.operators import search

CASES = [
    (r"class\s+Parser", ["class  Parser:", "class Parser"], ["classParser"]), (r"^[[:alpha:]]+$", ["abc"], [":a", "é", "a1"]), (r"[[:^digit:][:punct:]]", ["a", "!"], ["12"]), (r"\p{L}+\z", ["né"], ["a1"]), (r"\pN", ["٣"], ["x"]), (r"\P{L}", ["a1"], ["ab"]),
    (r"\p{Greek}", ["λ"], ["l"]), (r"\p{sc=Cyrillic}", ["ж"], ["x"]), (r"\p{Uppercase_Letter}", ["É"], ["é"]), (r"\p{^Lu}", ["é"], ["É"]), (r"\p{gc!=Lu}", ["a"], ["A"]), (r"\p{White_Space}", ["a "], ["ab"]), (r"\p{any}", ["x"], [""]),
    (r"\w\d", ["é٣"], ["--"]), (r"[^\w]", ["-"], ["é_9"]), (r"[\w--\d]$", ["1a"], ["a1"]), (r"^[a-z&&[^aeiou]]+$", ["xyz"], ["abc"]), (r"^[a-f~~d-h]+$", ["abgh"], ["d"]), (r"^[^a-z&&[^x]]+$", ["x1"], ["a"]),
    (r"\bété\b", ["l'été!"], ["étés"]), (r"\Bb", ["ab"], ["b"]), (r"\<ab", ["ab"], ["xab"]), (r"ab\>", ["xab"], ["abx"]), (r"\b{start}ab\b{end}", ["ab"], ["abc"]), (r"a.c", ["a\rc", "a c", "a🤖c"], ["ac"]), (r"x$", ["x"], ["x\r", "x\u0085"]), (r"(?m)^x$", ["x"], ["xx"]), (r"(?R)x$", ["x\r", "x"], ["x\u0085"]),
    (r"(?i)straße", ["STRAßE", "Straße"], ["strasse"]), (r"(?i:É)t", ["ét", "Ét"], ["ÉT"]), (r"(?i)a(?-i)b", ["Ab"], ["AB"]), (r"(a(?i)b|c)D", ["aBD", "CD"], ["ABD", "Cd"]), (r"(?s).", ["x"], [""]), (r"(?U)^a+b", ["aab"], ["b"]), (r"(?x) a b # no c", ["ab"], ["a b"]),
    (r"a**", ["", "b"], []), (r"^(?:a+){2}?$", ["aa"], ["a"]), (r"^a{2,}$", ["aaa"], ["a"]), (r"^a{,2}$", ["", "aa"], ["aaa"]), (r"^x{2}{2}$", ["xxxx"], ["xx"]), (r"(?P<one>a)(?<two>b)", ["ab"], ["ba"]),
    (r"[]a]", ["]", "a"], ["b"]), (r"[^]a]", ["b"], ["]a"]), (r"[a-]", ["-"], ["b"]), (r"[-a]", ["-"], ["b"]), (r"[--a]", ["-"], ["b"]), (r"[\]\\^&~]", ["^", "&", "\\"], ["a"]), (r"]}", ["]}"], ["]"]), (r"\x41B\x{43}\U00000044", ["ABCD"], ["ABC"]), (r"\x{1F916}", ["🤖"], ["x"]), (r"\.\*\-\ \#", [".*- #"], [".x- #"]), (r"a|", ["b"], []),
]
REFUSED = ["", "[", "a)", "(a", "*a", "a|*", "a{", "a{x}", "a{2,1}", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", r"\1", r"(a)\1", r"\Z", r"\h", r"\Qa\E", r"\G", r"\R", r"\X", r"\k<a>", "(?-u)a", "(?z)a", "(?)", "[z-a]", "[a", r"[\b]", "[[:nope:]]", r"\p{}", r"\pé", r"\p{x=y}", "a\nb", r"a\n", r"\x{110000}", r"\x{D800}", r"\xZZ", "(?P<a>x)(?P<a>y)", "(?P<1>x)", "\\", r"[\d-z]x)", r"\e", "(?", "(?P"]


def test_matches(spark):
    rows = [(p, translated(p).java, t, want) for p, yes, no in CASES for some, want in ((yes, True), (no, False)) for t in some]
    got = spark.createDataFrame(rows, "p string, java string, t string, want boolean").withColumn("got", F.rlike("t", F.col("java"))).where("got <> want").collect()
    assert not got


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(ExpressionError):
        translated(pattern)


def test_what_the_jvm_lacks(spark):
    with pytest.raises(ValueError, match="invalid pattern"):
        search.expression(r"\p{Klingon}", spark)
    assert search.pattern_error("(?=x)") and search.pattern_error("x") is None


def test_needed():
    want = {
        "abcd": [{"abc", "bcd"}], "abc.*def": [{"abc", "def"}], "(abc|defg)+": [{"abc"}, {"def", "efg"}], "(abc)?": [set()], "a(bc)d": [{"abc", "bcd"}], "ab": [set()], "(?i)abc": [set()], "abc(?i)def": [{"abc"}], "x*abc": [{"abc"}], r"\babc\b": [{"abc"}], "abc|": [{"abc"}, set()], "(abc|x)def": [{"abc", "def"}, {"def"}],
    }
    for p, sets in want.items():
        assert translated(p).needed == {frozenset(s) for s in sets}, p
    assert translated("a|bcd").broad and not translated("abc|bcd").broad
    many = "|".join(f"abc{i:02d}" for i in range(40))
    assert translated(many).broad or len(translated(many).needed) <= 40


def test_needed_never_rules_out_a_match():
    """Texts that match have what is needed; the expressions are ones that Python reads alike."""
    rnd = random.Random(8)

    def made(depth):
        kind = rnd.randrange(6 if depth else 2)
        if kind < 2:
            return "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
        if kind == 2:
            return f"(?:{made(depth - 1)}|{made(depth - 1)})"
        if kind == 3:
            return f"(?:{made(depth - 1)}){rnd.choice(['*', '+', '?', '{2}', '{0,1}', '+?'])}"
        if kind == 4:
            return rnd.choice([".", "[ab]", "[^a]", r"\b"])
        return made(depth - 1) + made(depth - 1)

    hits = 0
    for _ in range(400):
        p = made(3)
        e = translated(p)
        for _ in range(20):
            t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
            if re.search(p, t):
                hits += 1
                assert any(all(g in t for g in need) for need in e.needed), (p, t)
    assert hits > 500
