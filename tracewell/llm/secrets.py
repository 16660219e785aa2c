"""Secret scans.

Three fixed patterns find assignments, access keys and long hex strings. Beyond
them, values in a credential context are held against a guesser: the cheapest cut
of the value into dictionary words, dates, repeats, keyboard walks and brute-force
characters, by dynamic programming over its positions. A value that takes many
guesses is a secret; `password: summer2019` isn't one. Plain lower-case words take
more guesses to be one, so that prose isn't, but for words of 11 letters and more
of which the dictionary knows no part.

The dictionary is the words of a public tokenizer's vocabulary in the order of their
merges, which is about that of their frequency, behind the words that people choose
for passwords. Its path is a parameter. Neither names nor values have a length limit.

A name is judged by its words (`userPassword`, `db_pwd`, `encryption-key`). A quoted value
runs to its closing quote, another one to white space or to a bracket that closes none of
its own; the word before a header's value (`Bearer`) is stepped over. A reference to a
value that is elsewhere (`${NAME}`, `<name>`, `call(name)`) is none.

Spans are `kind:start:end` in code points of the whole text, end exclusive.

Defined results: a null text counts as empty and has no spans; null ids, equal
rows and extra columns (which aren't read, whatever their names) don't matter; an
empty table gives an empty result; a very long text or value is judged whole.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_rows
from .common import table, text_of

KINDS = ("assign", "access", "hex", "guess")
#: Least guesses, as a power of ten, that make a value in a credential context a secret.
LEAST_GUESSES = 7.0
#: Further powers of ten that plain words take: prose after a colon is such, and a letter of it counts as a random one.
MORE_FOR_WORDS = 8.0

# The words that people choose, the most frequent first.
COMMON_WORDS = (
    "password pass admin user test welcome letmein monkey dragon master login hello secret qwerty football baseball "
    "shadow superman batman trustno iloveyou sunshine princess flower summer winter spring autumn january february "
    "march april june july august september october november december monday tuesday wednesday thursday friday "
    "saturday sunday love lucky happy money freedom whatever ninja mustang michael jordan hunter ranger thomas "
    "robert daniel george charlie andrew jessica ashley pepper ginger cookie chocolate cheese coffee computer "
    "internet server database root default guest public private example sample demo temp changeme change none null "
    "true false value name string token key api data config system service access account email phone number "
    "string the and for you that with this your have from here there please enter required optional"
).split()
# Rows of the keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_KEY = {c: (y, x) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
_PLAIN = str.maketrans("@4310$5!", "aaeiossi")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0?[1-9]|1[0-2])(?:[-/.]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# A name and a sign; the name is tried from its start alone and given up whole, so the time is linear in the text.
_NAMED = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["'`]?\]?[ \t]*+(?::=|=>|[:=])[ \t]*+""", re.ASCII)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Words of names that make a credential, what such words end in when run together, and what they begin with.
CREDENTIAL_WORDS = frozenset("password passwd passphrase passcode pass pwd secret token credential auth authorization authentication".split())
CREDENTIAL_ENDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "apikey", "accesskey", "secretkey", "privatekey", "authkey")
CREDENTIAL_BEGINS = ("password", "passwd", "passphrase", "pwd")
# Words before the value of a header.
_SCHEME = re.compile(r"(?:bearer|basic|digest|token|negotiate|apikey|bot)[ \t]++(?=\S)", re.IGNORECASE | re.ASCII)
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n\r]|\\[^\n\r])*+(?={q})") for q in "\"'`"}
_UNQUOTED = re.compile(r"\S+")
_BRACKETS = re.compile(r"[()\[\]{}<>]")
_CLOSES = {")": "(", "]": "[", "}": "{", ">": "<"}
# Lower-case words, perhaps with a capital, and what may join them.
_PLAIN_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|[-_./'\u2019](?=[^\W\d_]))*[.,;:!?]*")
_INNER_CAPITAL = re.compile(r"(?<=[^\W\d_])[^\W\d_]")
# What stands for a value that is somewhere else: a variable, a template's place, a call.
_ELSEWHERE = re.compile(r"\$\{[^{}]*\}|\$\([^()]*\)|\{\{[^{}]*\}\}|\$[A-Za-z_]+|%[A-Za-z_]+%|<[A-Za-z_ -]+>|[A-Za-z_][A-Za-z_.]*\([A-Za-z_., ]*\)[;,]?")
# A structure begins, not a value.
_STRUCTURE = re.compile(r"[\[{(](?=[\s\"'`\[{(]|$)")
_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")


def _near(a: str, b: str) -> bool:
    """Whether b is a neighbour of a on the keyboard."""
    p, q = _KEY.get(a), _KEY.get(b)
    return bool(p and q) and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


class Dictionary:
    """Ranks of words by frequency."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f)["model"]["vocab"]
        end = "</w>"
        whole = (t.removesuffix(end) for t in sorted(tokens, key=tokens.get) if t.endswith(end))
        words = dict.fromkeys([*COMMON_WORDS, *(w for w in whole if len(w) >= 3 and w.isalpha())])
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        self.longest = max(map(len, self.rank))
        self.heads = {w[:3] for w in self.rank}
        # What a word or a date spans at most.
        self.reach = max(self.longest, 10)


def words_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def dictionary(path: str | None = None) -> Dictionary:
    """One for each process."""
    return Dictionary(path or words_path())


def guess_cost(value: str, enough: float = math.inf, words: Dictionary | None = None) -> float:
    """The power of ten of the guesses that the cheapest segmentation of value takes; from `enough` on it may be infinite.

    Below `enough`, segments are bounded but for repeats, so the time is linear in the
    length of value. A repeat that starts deep in its run never pays: what leads into a
    run ends within its first `reach` characters, and from there the run itself is cheapest.
    """
    words = words or dictionary()
    rank_of, longest, reach, heads = words.rank.get, words.longest, words.reach, words.heads
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    plain = low.translate(_PLAIN)
    best = [0.0] + [math.inf] * n
    run = far = 0
    for i in range(n):
        here = best[i]
        c = value[i]
        if i and value[i - 1] != c:
            run = i
        if i > far:
            break
        if here == math.inf:
            continue

        def offer(j: int, cost: float, here: float = here) -> bool:
            nonlocal far
            if here + cost >= enough:
                return False
            if here + cost < best[j]:
                best[j] = here + cost
                far = max(far, j)
            return True

        offer(i + 1, 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33))
        begins = low[i : i + 3] in heads or plain[i : i + 3] in heads
        for j in range(i + 3, min(n, i + longest) + 1) if begins else ():
            rank = rank_of(low[i:j])
            swapped = rank_of(plain[i:j])
            if rank or swapped:
                cased = low[i:j] != value[i:j]
                offer(j, math.log10((rank or swapped) * (2 if cased else 1) * (1 if rank else 2)) + 0.3)
        if m := _DATE.match(value, i):
            offer(m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120))
        j = i + 1
        while i - run <= reach and j < n and value[j] == c:
            j += 1
            if j - i >= 3 and not offer(j, math.log10(40 * (j - i))):
                break
        j = i + 1
        while j < n and _near(low[j - 1], low[j]):
            j += 1
            if j - i >= 3 and not offer(j, math.log10(47 * (j - i)) + 0.3 * (j - i)):
                break
    return best[n]


def _plain_words(value: str) -> bool:
    """Whether value is lower-case words alone, each perhaps with an initial capital."""
    parts = value.split()
    return bool(parts) and all(_PLAIN_WORDS.fullmatch(p) and not any(c.isupper() for c in _INNER_CAPITAL.findall(p)) for p in parts)


def least_cost(value: str, least: float = LEAST_GUESSES) -> float:
    """The power of ten of guesses that make value a secret: what joins plain words makes them none."""
    return least + MORE_FOR_WORDS + math.log10(33) * sum(not c.isalpha() for c in value) if _plain_words(value) else least


def is_credential(name: str) -> bool:
    """Whether a name says that its value is one: by its words, split at capitals and joints, or by `key` at its end."""
    words = [w.lower().removesuffix("s") if w.lower() != "pass" else "pass" for w in _NAME_WORD.findall(name)]
    return bool(words) and (words[-1] == "key" or any(w in CREDENTIAL_WORDS or w.endswith(CREDENTIAL_ENDS) or w.startswith(CREDENTIAL_BEGINS) for w in words))


def value_span(text: str, start: int) -> tuple[int, int]:
    """(start, end) of the value at a place: to the closing quote of the line, or, without quotes, to white space or to a bracket that closes none of the value's."""
    if m := _SCHEME.match(text, start):
        start = m.end()
    if (q := _QUOTED.get(text[start : start + 1])) and (m := q.match(text, start + 1)):
        # In quotes, too, a scheme word may come first.
        inner = _SCHEME.match(text, start + 1, m.end())
        return inner.end() if inner else start + 1, m.end()
    start += q is not None
    if _STRUCTURE.match(text, start) or not (m := _UNQUOTED.match(text, start)):
        return start, start
    end = m.end()
    opened: list[str] = []
    held = dict.fromkeys(_CLOSES.values(), 0)
    for b in _BRACKETS.finditer(text, start, end):
        c = b[0]
        if c in held:
            opened.append(c)
            held[c] += 1
        elif held[_CLOSES[c]]:
            while (last := opened.pop()) != _CLOSES[c]:
                held[last] -= 1
            held[last] -= 1
        elif c != ">":
            return start, b.start()
    return start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def guessed_spans(text: str, base: list[tuple[int, int, int]], least: float = LEAST_GUESSES, words: Dictionary | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in a credential context that base spans don't cover whole and that take at least 10^least guesses, plain words 10^MORE_FOR_WORDS times as many."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    out = []
    starts, ends = _merged(base)
    at = 0
    while m := _NAMED.search(text, at):
        at = m.end()
        if not is_credential(m[1]):
            continue
        start, end = value_span(text, at)
        at = max(at, end)
        value = text[start:end]
        k = bisect_right(starts, start) - 1
        if not value or (k >= 0 and end <= ends[k]) or _ELSEWHERE.fullmatch(value):
            continue
        needed = least_cost(value, least)
        if guess_cost(value, needed, words) >= needed:
            out.append((start, 3, end))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", least: float = LEAST_GUESSES, words: str | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base, spans) of each document."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator[dict]:
        known = dictionary(words)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                more = guessed_spans(text, base, least, known)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), len(more), _said(base), _said(sorted(base + more))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield {"id": b.column(0)} | dict(zip(("n_assign", "n_access", "n_hex", "n_guess", "base", "spans"), map(list, columns), strict=True))

    rows = docs.select(docs[id_column].alias("id"), text_of().alias("text"))
    return map_rows(rows, run, f"id {id_type}, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string").withColumnRenamed("id", id_column)


def redact(text: str, mask: str = "[secret]", least: float = LEAST_GUESSES) -> str:
    """text with every span masked."""
    base = base_spans(text)
    out, at = [], 0
    for s, _, e in sorted(base + guessed_spans(text, base, least)):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
