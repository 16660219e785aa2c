"""Token counts of every prefix of a text.

For each prefix there is exactly one token that may end its encoding: the one that the
tokenizer keeps apart from the token that ends the prefix before it. So the counts
follow by dynamic programming over positions, count(i) = count(i - length) + 1, with the
pairs of tokens that stay apart looked up and remembered, and no prefix is encoded.
Byte-level BPE never merges across the words that its pattern cuts, and sentencepiece's
across a space after other characters (if no piece of its vocabulary does), so each
distinct word is worked out once while it is remembered. Only where a prefix ends inside
white space does the pattern cut it otherwise than the whole text; that place is mended.

The counts of all prefixes are stored as differences, one a code point, which says how
many tokens a truncated text has, and how long a prefix fits a budget, without encoding
again. Counts may fall as a prefix grows (`a` and `b`, then `ab`), so the longest prefix
that fits is sought among all.

Tokenizers: byte-level BPE as a `.json` file, BPE as a `.model` file of sentencepiece;
others are refused. Strings of special tokens are taken as the library takes them by
default: the tokenizers library makes one token of each (and plain text of a part of it),
sentencepiece plain text.

Defined results: a null text counts as empty, and an empty text has no tokens; null ids,
ids of any type and equal rows stay rows of their own; extra columns are not read (they
are kept by `truncated`); an empty table gives an empty result; a very long text, or a
very long stretch without white space, is counted whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_rows
from .common import table, text_of, written
from .tokens import Encoder, _Words, tokenizer_path

#: Pairs of tokens that a worker remembers; words that are longer are not remembered.
KNOWN_PAIRS, KNOWN_LENGTH = 2_000_000, 64


class _Counter:
    """Counts by dynamic programming over tokens given as strings of symbols."""

    def __init__(self, vocabulary: set[str]) -> None:
        #: All endings of tokens, and whether they are tokens: what isn't here ends no token.
        self.ends = {t[i:]: False for t in vocabulary for i in range(1, len(t))} | dict.fromkeys(vocabulary, True)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: str) -> list[str]:
        raise NotImplementedError

    def fits(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens stay apart."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        got = self.pairs[pair] = self.merged(pair[0] + pair[1]) == list(pair)
        return got

    def single(self, symbol: str) -> int:
        """Tokens of a symbol that no token of the vocabulary has."""
        raise NotImplementedError

    def prefixes(self, symbols: str) -> list[int]:
        """Tokens of symbols[:1], symbols[:2], and so on."""
        last: list[str | None] = [None]
        count = [0]
        ends, pairs = self.ends.get, self.pairs.get
        for j in range(1, len(symbols) + 1):
            i = j - 1
            t = symbols[i]
            while (token := ends(t)) is not None:
                if token:
                    p = last[i]
                    if p is None or (ok := pairs((p, t))) or (ok is None and self.fits((p, t))):
                        last.append(t)
                        count.append(count[i] + 1)
                        break
                i -= 1
                if i < 0:
                    raise AssertionError(f"no token ends {symbols[:j]!r}")
                t = symbols[i:j]
            else:
                if i < j - 1:
                    raise AssertionError(f"no token ends {symbols[:j]!r}")
                last.append(None)  # nothing merges with it
                count.append(count[-1] + self.single(t))
        return count[1:]


class ByteLevel(_Counter):
    """Byte-level BPE; symbols are the letters that stand for bytes."""

    def __init__(self, path: str) -> None:
        import json

        import regex

        self.encoder = Encoder(path)
        if self.encoder.pattern is None:
            raise ValueError("only byte-level BPE without a normalizer can be counted")
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take white space along can't be counted")
        super().__init__(set(self.encoder.whole.get_vocab(with_added_tokens=False)))
        self.special = regex.compile("|".join(map(re.escape, sorted(self.encoder.special, key=len, reverse=True)))) if self.encoder.special else None
        self.spaces, self.ascii_spaces = regex.compile(r"\s{2,}"), re.compile(r"\s{2,}", re.ASCII)
        self.words = _Words(self._word)

    def merged(self, symbols: str) -> list[str]:
        return [t.value for t in self.encoder.merges.tokenize(symbols)]

    def _counts(self, word: str) -> list[int]:
        """Tokens of every prefix of what the pattern doesn't cut, were it not cut either."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.prefixes(raw.decode("latin-1").translate(self.encoder.letters))
        return counts if word.isascii() else [c for c, b in zip(counts, [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def _word(self, word: str) -> bytes:
        """Differences of the counts of a word's prefixes."""
        counts = self._counts(word)
        if word in ("'re", "'ve", "'ll"):
            counts[1] = counts[0] + self._counts(word[1])[0]  # the pattern knows the whole ending alone
        return array("i", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Differences of a text without special tokens."""
        known, ascii_ = self.words, text.isascii()
        words = (self.encoder.ascii if ascii_ else self.encoder.pattern).findall(text)
        out = np.frombuffer(b"".join([known[w] if len(w) <= KNOWN_LENGTH else self._word(w) for w in words]), dtype=np.int32)
        # The pattern leaves the last of several white spaces to what follows; a prefix that ends there has them all as one word.
        fixed = None
        for m in (self.ascii_spaces if ascii_ else self.spaces).finditer(text):
            at = m.end() - 1
            if at + 1 < len(text):
                run = np.frombuffer(known[m[0]] if len(m[0]) <= KNOWN_LENGTH else self._word(m[0]), dtype=np.int32)
                fixed = out.copy() if fixed is None else fixed
                more = run[-1] - out[at]
                fixed[at] += more
                fixed[at + 1] -= more
        return out if fixed is None else fixed

    def __call__(self, text: str) -> np.ndarray:
        if self.special is None or not any(s in text for s in self.encoder.special):
            return self._plain(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            # Up to the special token's last character it is plain text; there it becomes one token.
            plain = self._plain(text[at : m.end() - 1])
            before = int(plain[: m.start() - at].sum(dtype=np.int64))
            parts += [plain, np.array([before + 1 - int(plain.sum(dtype=np.int64))], dtype=np.int32)]
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])])


class Pieces(_Counter):
    """BPE of sentencepiece; symbols are characters, and bytes of those that its vocabulary lacks."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = {m.id_to_piece(i): i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        super().__init__(set(pieces))
        self.score = {p: m.get_score(i) for p, i in pieces.items()}
        self.bytes = any(m.is_byte(i) for i in range(m.vocab_size()))
        cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.cut = re.compile("▁+[^▁]*" if cuts else r"(?s:.+)")
        self.stretches = _Words(self._stretch)

    def single(self, symbol: str) -> int:
        return len(symbol.encode("utf-8", "surrogatepass")) if self.bytes else 1

    def merged(self, symbols: str) -> list[str]:
        """The two neighbours of the best score become one, the first ones at ties."""
        parts = list(symbols)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _stretch(self, symbols: str) -> bytes:
        counts = self.prefixes(symbols)
        return array("i", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        cut = self.cut.findall("▁" + text.replace(" ", "▁"))
        out = np.frombuffer(b"".join([self.stretches[s] if len(s) <= KNOWN_LENGTH else self._stretch(s) for s in cut]), dtype=np.int32)
        # The space that sentencepiece puts first is no prefix of the text's own.
        out = np.concatenate([[out[0] + out[1]], out[2:]]).astype(np.int32)
        n = len(self.model.encode(text, num_threads=1))
        if n != out.sum(dtype=np.int64):
            raise ValueError(f"the model changes the text, or isn't BPE: {n} tokens, not {out.sum()}")
        return out


_COUNTERS: dict[str, _Counter] = {}


def counter(path: str) -> _Counter:
    """One for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return _COUNTERS[path]


def packed(steps: np.ndarray) -> bytes:
    """Differences in as few bytes as they take, behind their width."""
    for width in (1, 2):
        if not len(steps) or -(2 ** (8 * width - 1)) <= steps.min() and steps.max() < 2 ** (8 * width - 1):
            return bytes([width]) + steps.astype(f"<i{width}").tobytes()
    return b"\4" + steps.astype("<i4").tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    """Token counts of text[:0], text[:1], and so on."""
    steps = np.frombuffer(stored, dtype=f"<i{stored[0]}", offset=1)
    out = np.zeros(len(steps) + 1, dtype=np.int64)
    np.cumsum(steps, out=out[1:])
    return out


def longest_within(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most so many tokens."""
    return int(np.flatnonzero(counts <= limit)[-1])


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, steps): steps has the token counts of all prefixes, to be read by `unpacked`."""
    where = path or tokenizer_path()

    def run(batches: Iterator) -> Iterator[tuple]:
        count = counter(where)
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                steps = count(t)
                yield d, len(t.encode("utf-8", "surrogatepass")), int(steps.sum(dtype=np.int64)), packed(steps)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, steps binary")


def within(stored: DataFrame, limits: list[int]) -> DataFrame:
    """The rows of prefix_counts with `fits`: for each limit of tokens, in order, the code points of the longest prefix that keeps to it."""
    limits = [int(x) for x in limits]
    if not limits or min(limits) < 0:
        raise ValueError("limits must be numbers of tokens")

    def run(batches: Iterator) -> Iterator[tuple]:
        for b in batches:
            for d, size, n, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = unpacked(steps)
                yield d, size, n, [longest_within(counts, x) for x in limits]

    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_rows(stored.select("doc_id", "n_bytes", "n_tokens", "steps"), run, f"doc_id {kind}, n_bytes long, n_tokens long, fits array<long>")


def truncated(docs: DataFrame, limit: int, path: str | None = None) -> DataFrame:
    """docs with each text cut to its longest prefix of at most `limit` tokens."""
    where = path or tokenizer_path()
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator) -> Iterator[tuple]:
        count = counter(where)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = list(row)
                if row[at]:
                    row[at] = row[at][: longest_within(unpacked(packed(count(row[at]))), limit)]
                yield tuple(row)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs.select(*[F.col(f"`{c}`") for c in names]), run, schema)


def tokens_at(stored: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, place) with n_tokens: the tokens of the document's first `place` code points; null where it has fewer."""

    def run(batches: Iterator) -> Iterator[tuple]:
        for b in batches:
            for d, place, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = unpacked(steps)
                yield d, place, int(counts[place]) if place is not None and 0 <= place < len(counts) else None

    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = places.select("doc_id", "place").join(stored.select("doc_id", "steps"), "doc_id")
    return map_rows(rows, run, f"doc_id {kind}, place long, n_tokens long")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are stored for every prefix, then read for the answers; n_fit is the length of the longest prefix of 1,024 tokens."""
    stored = written(prefix_counts(table(spark, sf_dir, "documents")))
    return within(stored, [1024]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("fits")[0].alias("n_fit"))
