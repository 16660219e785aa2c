"""Search expressions of a linear-time engine as expressions of the JVM.

The dialect: Unicode classes, class set operations (`&&`, `--`, `~~`), bracket names
(`[[:alpha:]]`), flags `imsUxR`, `\\z`, word boundaries in braces, repeats of repeats; no
look-around and no references. What the JVM reads otherwise is written out (`.`, `$`,
`\\w`, `\\b`, negated classes), what neither dialect has, or only the JVM, is refused.

`Expression.runs` has the literal texts that a match must contain, as alternatives of sets;
`Expression.needed` has their strings of three characters, and some of eight: an index of
those rules texts out before any expression runs.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

#: Alternatives that are kept apart in `needed`; beyond them, or where one needs nothing, everything may match.
MOST_ALTERNATIVES = 16
#: Characters of the strings in `needed`: all short ones, and every ONE_IN-th long one.
SHORT, LONG, ONE_IN = 3, 8, 4

# Members of bracket names, as ranges.
BRACKET_NAMES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
# Perl's classes over all of Unicode.
PERL = {"d": r"\p{Nd}", "s": r"\p{IsWhite_Space}", "w": r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}"}
# Long names of general categories.
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
# Properties that are no category and no script.
PROPERTIES = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "lowercase": "Lowercase", "lower": "Lowercase", "uppercase": "Uppercase", "upper": "Uppercase", "whitespace": "White_Space", "hexdigit": "Hex_Digit", "ideographic": "Ideographic", "joincontrol": "Join_Control"}
_ESCAPES = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_ANY = r"(?s:.)"
_SET = re.compile(r"\[(?:\\.|[^\\])+\]", re.DOTALL)

Needed = frozenset[frozenset[str]]
_NOTHING: Needed = frozenset([frozenset()])


class ExpressionError(ValueError):
    """An expression that the dialect, or its translation, doesn't have."""


@dataclass(frozen=True)
class Expression:
    java: str
    runs: Needed

    @property
    def needed(self) -> Needed:
        return frozenset(_strings(x) for x in self.runs)

    @property
    def broad(self) -> bool:
        """Whether some text without any given three characters may match."""
        return frozenset() in self.runs


@dataclass
class _Part:
    """Some of an expression: its translation; the literal that it is, if it is one; the runs that it needs beyond that."""

    java: str
    literal: str | None = None
    needed: Needed = field(default=_NOTHING)
    looks: bool = False


def strings(text: str) -> frozenset[str]:
    """The strings of a text that an index of texts knows: those of SHORT characters, and of LONG ones every ONE_IN-th by its checksum."""
    long = (text[i : i + LONG] for i in range(len(text) - LONG + 1))
    return frozenset(text[i : i + SHORT] for i in range(len(text) - SHORT + 1)) | {g for g in long if zlib.crc32(g.encode()) % ONE_IN == 0}


def _run(text: str) -> frozenset[str]:
    """A literal text as what is needed: nothing if it is too short for any string."""
    return frozenset([text] if len(text) >= SHORT else [])


def _strings(runs: frozenset[str]) -> frozenset[str]:
    return frozenset(g for r in runs for g in strings(r))


def _both(a: Needed, b: Needed) -> Needed:
    out = frozenset(x | y for x in a for y in b)
    if len(out) <= MOST_ALTERNATIVES:
        return out
    return max(a, b, key=lambda n: (frozenset() not in n, min(len(_strings(x)) for x in n)))


def _point(c: str) -> str:
    return rf"\x{{{ord(c):X}}}" if not (c.isascii() and c.isalnum()) else c


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.flags, self.names = text, 0, frozenset("u"), set()

    def fail(self, why: str):
        raise ExpressionError(f"{why} at character {self.at + 1}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, some: str) -> bool:
        if self.text.startswith(some, self.at):
            self.at += len(some)
            return True
        return False

    def skip(self) -> None:
        """White space and comments of the verbose flag."""
        while "x" in self.flags and self.at < len(self.text):
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                self.at = (self.text.find("\n", self.at) + 1) or len(self.text)
            else:
                break

    def alternatives(self) -> _Part:
        flags, parts = self.flags, [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        self.flags = flags
        if len(parts) == 1:
            return parts[0]
        needed: set[frozenset[str]] = set()
        for p in parts:
            needed |= p.needed if p.literal is None else {_run(p.literal)}
        return _Part("|".join(p.java for p in parts), None, frozenset(needed) if len(needed) <= MOST_ALTERNATIVES else _NOTHING)

    def sequence(self) -> _Part:
        java, needed, run, whole = "", _NOTHING, "", True
        while True:
            self.skip()
            if not (c := self.peek()) or c in "|)":
                break
            part = self.repeated()
            java += part.java
            if part.literal is not None:
                run += part.literal
                continue
            if not part.looks:
                needed, run = _both(needed, frozenset([_run(run)])), ""
            whole = False
            needed = _both(needed, part.needed)
        return _Part(java, run if whole else None, _both(needed, frozenset([_run(run)])))

    def repeated(self) -> _Part:
        part = self.atom()
        while True:
            self.skip()
            c = self.peek()
            if c and c in "*+?":
                self.at += 1
                least, told = int(c == "+"), c
            elif c == "{":
                m = re.compile(r"\{\s*(\d*)\s*(?:(,)\s*(\d*)\s*)?\}").match(self.text, self.at)
                if not m or not (m[1] or m[3]):
                    self.fail("a repeat needs numbers")
                low, high = int(m[1] or 0), m[1] if not m[2] else m[3]
                if high and int(high) < low:
                    self.fail("a repeat from more to less")
                self.at, least = m.end(), low
                told = f"{{{low}{',' if m[2] else ''}{high if m[2] else ''}}}"
            else:
                return part
            lazy = self.take("?") != ("U" in self.flags)
            part = _Part(f"(?:{part.java}){told}{'?' if lazy else ''}", None, (part.needed if part.literal is None else frozenset([_run(part.literal)])) if least else _NOTHING)
            # A repeat of this one is a repeat of the whole.
            if self.peek() and self.peek() in "*+?{":
                part.java = f"(?:{part.java})"

    def literal(self, c: str) -> _Part:
        if c == "\n":
            self.fail("a line has no line end")
        if "i" in self.flags and c.lower() != c.upper():
            return _Part(f"(?iu:{_point(c)})")
        return _Part(_point(c), c)

    def atom(self) -> _Part:
        c = self.peek()
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            self.at -= 1
            return _Part(self.cased(self.set()))
        if c == ".":
            return _Part(_ANY if "s" in self.flags else r"[^\n\r]" if "R" in self.flags else r"[^\n]")
        if c == "^":
            return _Part(r"(?:\A|(?<=\n))" if "m" in self.flags else r"\A", looks=True)
        if c == "$":
            return _Part(r"(?:\z|(?=\n))" if "m" in self.flags else r"(?=\r?\z)" if "R" in self.flags else r"\z", looks=True)
        if c in "*+?{":
            self.at -= 1
            self.fail("a repeat of nothing")
        if c == "\\":
            self.at -= 1
            return self.escape()
        return self.literal(c)

    def cased(self, java: str) -> str:
        return f"(?iu:{java})" if "i" in self.flags else java

    def group(self) -> _Part:
        flags = self.flags
        if self.take("?"):
            if self.peek(2) in ("<=", "<!") or self.peek() in ("=", "!", ">"):
                self.fail("look-around and back references are not supported")
            if (self.take("P<") or self.take("<")):
                m = re.compile(r"([^\W\d][\w.\[\]]*)>").match(self.text, self.at)
                if not m or m[1] in self.names:
                    self.fail("a group's name is missing or used twice")
                self.names.add(m[1])
                self.at = m.end()
            else:
                m = re.compile(r"([imsUuxR]*)(?:-([imsUuxR]+))?([:)])").match(self.text, self.at)
                if not m or (m[3] == ")" and not (m[1] or m[2])):
                    self.fail("unknown flags")
                self.at = m.end()
                self.flags = (self.flags | set(m[1])) - set(m[2] or "")
                if "u" not in self.flags:
                    self.fail("matching by bytes is not supported")
                if m[3] == ")":
                    return _Part("", "")  # they hold until the group ends
        inner = self.alternatives()
        if not self.take(")"):
            self.fail("a group isn't closed")
        self.flags = flags
        return _Part(f"(?:{inner.java})", inner.literal, inner.needed)

    def point(self, c: str) -> str | None:
        """The character of an escape that begins with x, u or U, or of a plain one."""
        if c in ("x", "u", "U"):
            m = re.compile(rf"\{{([0-9A-Fa-f]+)\}}|([0-9A-Fa-f]{{{dict(x=2, u=4, U=8)[c]}}})").match(self.text, self.at)
            if not m or int(m[1] or m[2], 16) > 0x10FFFF or 0xD800 <= int(m[1] or m[2], 16) < 0xE000:
                self.fail("no such character")
            self.at = m.end()
            return chr(int(m[1] or m[2], 16))
        if c in _ESCAPES:
            return chr(_ESCAPES[c])
        return c if c.isascii() and c and not c.isalnum() and c not in "<>" else None

    def property(self, negated: bool) -> str:
        m = re.compile(r"\{(\^?)([^{}]+)\}|()([A-Za-z])").match(self.text, self.at)
        if not m:
            self.fail("a property lacks its name")
        self.at = m.end()
        said = m[2] or m[4]
        kind, sep, value = re.match(r"([^=:!]*?)(!=|=|:|$)(.*)", said, re.DOTALL).groups()
        plain = lambda s: re.sub(r"[\s_-]", "", s).lower()
        negated ^= bool(m[1]) ^ (sep == "!=")
        name, of = (value, plain(kind)) if sep else (said, "")
        key = plain(name)
        category = CATEGORIES.get(key) or next((c for c in CATEGORIES.values() if c.lower() == key), None)
        if of in ("", "gc", "generalcategory") and key == "any":
            java = _ANY
        elif of in ("", "gc", "generalcategory") and key in ("ascii", "assigned"):
            java = r"[\x00-\x7F]" if key == "ascii" else r"\P{Cn}"
        elif of in ("", "gc", "generalcategory") and category:
            java = rf"\p{{{category}}}"
        elif not of and key in PROPERTIES:
            java = rf"\p{{Is{PROPERTIES[key]}}}"
        elif of in ("", "sc", "script") and re.fullmatch(r"\w+", name.strip()):
            java = rf"\p{{script={name.strip()}}}"
        else:
            self.fail("unknown property")
        return f"(?!{java}){_ANY}" if negated else java

    def escape(self) -> _Part:
        """One escape outside a class."""
        self.at += 1
        c = self.peek()
        self.at += 1
        word = f"[{PERL['w']}]"
        looks = {
            "A": r"\A", "z": r"\z", "b": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", "B": f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))", "<": f"(?:(?<!{word})(?={word}))", ">": f"(?:(?<={word})(?!{word}))",
        }
        if c == "b" and (m := re.compile(r"\{(start|end)(-half)?\}").match(self.text, self.at)):
            self.at = m.end()
            ahead = {"start": f"(?<!{word})", "end": f"(?!{word})"}[m[1]]
            return _Part(ahead if m[2] else looks["<" if m[1] == "start" else ">"], looks=True)
        if c and c in looks:
            return _Part(looks[c], looks=True)
        if (java := self.class_escape(c)) is not None:
            return _Part(self.cased(f"(?:{java})"))
        if c.isdigit():
            self.fail("look-around and back references are not supported")
        if (point := self.point(c) if c else None) is None:
            self.fail("unknown escape")
        return self.literal(point)

    def class_escape(self, c: str) -> str | None:
        if c and c in "dsw":
            return f"[{PERL[c]}]"
        if c and c in "DSW":
            return f"(?!{'[' + PERL[c.lower()] + ']'}){_ANY}"
        return self.property(c == "P") if c and c in "pP" else None

    def set(self) -> str:
        """A class, as an expression for one character; set operations become look-ahead before it."""
        self.at += 1
        negated = self.take("^")
        java, op = None, ""
        plain = ""
        while self.take("-"):  # hyphens in front are members
            plain = r"\-"
        first = not plain
        while True:
            items: list[str] = []
            while True:
                self.skip()
                c = self.peek()
                if not c:
                    self.fail("a class isn't closed")
                if (c == "]" and not first) or self.peek(2) in ("&&", "--", "~~"):
                    break
                first = False
                if self.peek(2) == "[:" and (m := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at)):
                    if m[2] not in BRACKET_NAMES:
                        self.fail("unknown class name")
                    self.at = m.end()
                    inside = f"[{BRACKET_NAMES[m[2]]}]"
                    items.append(f"(?!{inside}){_ANY}" if m[1] else inside)
                    continue
                if c == "[":
                    items.append(self.set())
                    continue
                low = self.member()
                if len(low) > 1:
                    items.append(low)
                    continue
                if self.peek() == "-" and self.peek(2) not in ("-]", "--"):
                    self.at += 1
                    high = self.member()
                    if len(high) > 1 or high < low:
                        self.fail("a range from more to less")
                    plain += f"{_point(low)}-{_point(high)}"
                else:
                    plain += _point(low)
            if plain:
                items.append(f"[{plain}]")
                plain = ""
            here = "(?!)" if not items else items[0] if len(items) == 1 else f"(?:{'|'.join(items)})"
            java = here if java is None else {"&&": f"(?:(?={java})(?:{here}))", "--": f"(?:(?!{here})(?:{java}))", "~~": f"(?:(?!{here})(?:{java})|(?!{java})(?:{here}))"}[op]
            if self.take("]"):
                break
            op = self.peek(2)
            self.at += 2
            first = False
        if not negated:
            return f"(?:{java})"
        return f"[^{java[1:]}" if _SET.fullmatch(java) and java[1] != "^" and "]" not in java[1:-1].replace("\\]", "") else f"(?:(?!{java}){_ANY})"

    def member(self) -> str:
        """A character of a class, or the expression of an escape that stands for many."""
        c = self.peek()
        self.at += 1
        if c != "\\":
            return c
        c = self.peek()
        self.at += 1
        if (java := self.class_escape(c)) is not None:
            return f"(?:{java})"
        if (point := self.point(c) if c else None) is None:
            self.fail("unknown escape in a class")
        return point


def translated(pattern: str) -> Expression:
    """The expression of the JVM that matches what `pattern` does in a line, or ExpressionError."""
    if not pattern:
        raise ExpressionError("pattern is empty")
    p = _Parser(pattern)
    part = p.alternatives()
    if p.at < len(pattern):
        p.fail("a bracket closes nothing")
    return Expression(part.java, part.needed if part.literal is None else frozenset([_run(part.literal)]))
