"""URL filters by a bit-parallel wildcard automaton.

Rules and globs are compiled into one Shift-And automaton over 64-bit words. A
state may loop on a class of bytes, which is how wildcards are held. All patterns
run at once over a URL, and all URLs of a batch at once: a step takes the next
byte of every URL that is still that long. The state is as wide as the rules, not
the URLs, and nothing is shuffled.

Globs are matched against the whole canonical URL, host then path: `*` stands for
any run without a slash, `**` for any run, `?` for one character.

Defined results: a null URL, or one without `://`, has an empty host and path and
fits no rule; its verdict is the globs', which match nothing there, so `allow`;
null ids and repeated rows are kept as they are; an empty table gives an empty
result; other columns are not read, whatever their names; a very long URL takes as many
steps as it has bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_rows
from .common import ascii_lower, table


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains if the path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Blocked where no rule fits: advertising and tracking hosts, logins, downloads of programs.
BLOCK_GLOBS = ("ads.*/**", "*.ads.*/**", "track*.*/**", "**/login/**", "**/cart/**", "**.exe", "**.zip", "**/cgi-bin/**")

_ANY = np.ones(256, dtype=bool)
_NO_SLASH = _ANY.copy()
_NO_SLASH[47] = False
_MORE = np.zeros(256, dtype=bool)
_MORE[0x80:0xC0] = True


class _Pattern:
    """Symbols (byte classes) and, for each of the states around them, the class it loops on."""

    def __init__(self) -> None:
        self.symbols: list[np.ndarray] = []
        self.loops: list[np.ndarray] = [np.zeros(256, dtype=bool)]

    def text(self, s: str) -> _Pattern:
        for byte in s.encode():
            self.symbols.append(np.arange(256) == byte)
            self.loops.append(np.zeros(256, dtype=bool))
        return self

    def run(self, of: np.ndarray) -> _Pattern:
        self.loops[-1] = self.loops[-1] | of
        return self

    def one(self) -> _Pattern:
        self.symbols.append(~_MORE)
        self.loops.append(_MORE.copy())
        return self


def glob(pattern: str) -> _Pattern:
    out, i = _Pattern(), 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.run(_ANY)
            i += 2
            continue
        c = pattern[i]
        if c == "*":
            out.run(_NO_SLASH)
        elif c == "?":
            out.one()
        else:
            out.text(c)
        i += 1
    return out


def of_rule(rule: Rule) -> list[_Pattern]:
    """A rule's patterns: the host itself, and any subdomain."""
    tails = [lambda p: p.text(rule.path).run(_ANY)] if rule.path else [lambda p: p, lambda p: p.text("/").run(_ANY)]
    return [tail(start) for tail in tails for start in (_Pattern().text(rule.host), _Pattern().run(_NO_SLASH).text(f".{rule.host}"))]


class Automaton:
    """All patterns packed into words; `owner` says which pattern a final bit belongs to."""

    def __init__(self, patterns: list[_Pattern]) -> None:
        bits = sum(len(p.loops) for p in patterns)
        self.width = max(1, -(-bits // 64))
        step, loop = (np.zeros((256, 64 * self.width), dtype=bool) for _ in range(2))
        start = np.zeros(64 * self.width, dtype=bool)
        self.final: list[int] = []
        at = 0
        for p in patterns:
            start[at] = True
            for j, s in enumerate(p.symbols):
                step[:, at + j + 1] = s
            for j, s in enumerate(p.loops):
                loop[:, at + j] = s
            at += len(p.loops)
            self.final.append(at - 1)
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8")
        self.step, self.loop, self.start = pack(step), pack(loop), pack(start)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns): whether each pattern fits each whole text."""
        n = len(texts)
        length = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        ends = np.cumsum(length)
        begin, raw = (ends - length)[order], np.frombuffer(b"".join(texts), dtype=np.uint8)
        state = np.repeat(self.start[None, :], n, axis=0)
        live = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
        one, top = np.uint64(1), np.uint64(63)
        for i, k in enumerate(live.tolist()):
            byte, s = raw[begin[:k] + i], state[:k]
            moved = s << one
            if self.width > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:k] = (moved & self.step[byte]) | (s & self.loop[byte])
        out = np.empty((n, len(self.final)), dtype=bool)
        for j, bit in enumerate(self.final):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def filter_urls(pages: DataFrame, id_column: str = "page_id", rules: tuple[Rule, ...] = RULES, block: tuple[str, ...] = BLOCK_GLOBS, allow: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, path, rule, glob, verdict) of each page's url. The longest fitting rule decides;
    else a page is blocked if a block glob fits and no allow glob does."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    patterns = [(i, p) for i, r in enumerate(ranked) for p in of_rule(r)]
    globs = [*allow, *block]
    id_type = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator[dict]:
        automaton = Automaton([p for _, p in patterns] + [glob(g) for g in globs])
        owner = np.array([i for i, _ in patterns], dtype=np.int64)
        for b in batches:
            host, path = b.column(1).to_pylist(), b.column(2).to_pylist()
            fits = automaton.matches([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(host, path, strict=True)])
            by_rule, by_glob = fits[:, : len(patterns)], fits[:, len(patterns) :]
            first = np.where(by_rule.any(axis=1), owner[by_rule.argmax(axis=1)] if len(patterns) else 0, -1).tolist()
            allowed = by_glob[:, : len(allow)].any(axis=1).tolist()
            hit = [globs[len(allow) + int(r.argmax())] if r.any() else None for r in by_glob[:, len(allow) :]]
            yield {
                "id": b.column(0),
                "host": host,
                "path": path,
                "rule": [ranked[i].name if i >= 0 else None for i in first],
                "glob": hit,
                "verdict": [ranked[i].verdict if i >= 0 else "block" if g and not a else "allow" for i, g, a in zip(first, hit, allowed, strict=True)],
            }

    cut = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(F.col(id_column).alias("id"), ascii_lower(F.regexp_extract(url, cut, 1)).alias("host"), F.regexp_extract(url, cut, 2).alias("path"))
    out = map_rows(parts, run, f"id {id_type}, host string, path string, rule string, glob string, verdict string")
    return out.withColumnRenamed("id", id_column)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("glob")


def oracle() -> str:
    fit = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    ranked = sorted(RULES, key=lambda r: -len(r.name))
    regex = "|".join(g.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*") for g in BLOCK_GLOBS)
    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fit(r)} THEN '{r.name}'" for r in ranked)} END AS rule,
       CASE {' '.join(f"WHEN {fit(r)} THEN '{r.verdict}'" for r in ranked)}
            WHEN regexp_full_match(host || path, '(?s)({regex})') THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""
