"""Alignment of the tokens of two tokenizers on the same texts.

A is a byte-level BPE (a `.json` file of the tokenizers library), B a sentencepiece
model. Both encode a space and the text. Where tokens of A and of B end at the same
byte, the tokens since the last such place are a group; its ids alone say which of its
tokens overlap, as every id stands for fixed bytes. Inside a group no two ends meet, so
it has len(A) + len(B) - 1 links.

Groups repeat as words do. Documents are therefore read in blocks, each with a
dictionary of its distinct groups; the blocks' dictionaries are summed to that of the
corpus; links are expanded once for each distinct group and weighed by how often the
group occurs, or in how many documents; and what a group's links come to goes back to
the blocks by the group's key, whatever the number of documents. The hottest group is
one row a block.

Texts are cut where both tokenizers cut, before a space that follows other than white
space, and each distinct piece is encoded once while it is remembered. The pieces of a
document that are new are joined, encoded in one call of each tokenizer and cut into
groups with array operations. Where the vocabulary of B has a piece that goes on beyond
such a place, texts are not cut.

Defined results: texts that are null, empty, or whose tokens don't join to a space and
the text (a text with U+2581, which B takes for a space) have no tokens; strings of
special tokens are plain text; null ids, ids of any type and equal rows stay rows of
their own; extra columns are not read; an empty table gives an empty result; a very
long text is a block by itself and is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import bounded, map_rows
from .common import table, written
from .tokens import Encoder, _Words, tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Groups of a block, but for a longer document; its dictionary stands in a task's memory.
BLOCK_GROUPS = 2**20
#: Longer pieces, their space included, are not remembered.
CACHE_LENGTH = 64
#: Words of A, and distinct groups, that a worker remembers.
KNOWN_WORDS, KNOWN_GROUPS = 200_000, 2**20
#: Fixed value: the bit that tells ids of B from those of A.
OF_B = np.uint32(2**31)


def ids_of(key: str) -> tuple[list[int], list[int]]:
    """The ids of A and of B of a group's key, which is written `a1,a2|b1`."""
    a, b = key.split("|")
    return list(map(int, a.split(","))), list(map(int, b.split(",")))


class _Numbers(dict):
    """Numbers of groups in the order of their first occurrence, and their keys.

    A group is known by its ids as unsigned 32-bit integers, those of B with the highest bit set.
    """

    def __init__(self) -> None:
        self.keys_of: list[str] = []

    def __missing__(self, group: bytes) -> int:
        ids = np.frombuffer(group, dtype=np.uint32)
        own = ids < OF_B
        self.keys_of.append(f"{','.join(map(str, ids[own].tolist()))}|{','.join(map(str, (ids[~own] - OF_B).tolist()))}")
        n = self[group] = len(self)
        return n


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        import re

        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(a_path)
        if self.a.pattern is None:
            raise ValueError("A must be a byte-level BPE")
        self.a.special = []
        self.a.words.limit = KNOWN_WORDS
        self.a.whole.encode_special_tokens = True
        byte_of = {c: b for b, c in self.a.letters.items()}
        self.a_bytes = [b""] * self.a.whole.get_vocab_size()
        for t, i in self.a.whole.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([*map(len, x)], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # A piece, which is known without its first space: from a space up to the next that follows other than white space. One that ends the text stays: B, which puts a space first, would see an empty text.
        cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.pattern = re.compile(r" \s*(?:\S++[^\S ]\s*)*\S*(?: \Z)?" if cuts else r"(?s:.+)")
        # In most texts no space stands first, last or behind white space, so that each begins a piece.
        self.other = re.compile(r"\A | \Z|\s " if cuts else "")
        self.forget()

    def forget(self) -> None:
        """Groups are numbered anew."""
        self.number = _Numbers()
        self.keys = self.number.keys_of
        self.known = _Words(self._aligned)

    def _aligned(self, piece: str) -> bytes:
        """Numbers of a piece's groups as unsigned 32-bit integers; none if tokens don't join to it."""
        return self._groups([piece]).get(piece, b"")

    def _groups(self, pieces: list[str]) -> dict[str, bytes]:
        """Numbers of the groups of each piece; empty if the tokens of any don't join to it. A piece that ends in white space must be the last."""
        joined = " " + " ".join(pieces)
        raw = joined.encode("utf-8", "surrogatepass")
        a, b = self.a(joined), np.array(self.b.encode(joined[1:], num_threads=1), dtype=np.uint32)  # B puts a space first itself
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return {}
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Behind the last tokens of each group.
        to_b = np.searchsorted(b_ends, a_ends)
        to_a = np.flatnonzero(b_ends[to_b] == a_ends)
        ends, to_a, to_b = a_ends[to_a], to_a + 1, to_b[to_a] + 1
        # The ids of each group one after another, those of A first.
        ids = np.empty(len(a) + len(b), dtype=np.uint32)
        ids[np.arange(len(a)) + np.repeat(np.append(0, to_b[:-1]), np.diff(to_a, prepend=0))] = a
        ids[np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = b | OF_B
        groups, at = ids.tobytes(), [0, *(4 * (to_a + to_b)).tolist()]
        numbers = np.array([self.number[groups[i:j]] for i, j in zip(at, at[1:])], dtype=np.uint32).tobytes()
        sizes = map(len, pieces if len(joined) == len(raw) else [p.encode("utf-8", "surrogatepass") for p in pieces])
        at = [0, *(4 * np.searchsorted(ends, np.cumsum([1 + n for n in sizes]), side="right")).tolist()]
        return {p: numbers[i:j] for p, i, j in zip(pieces, at, at[1:])}

    def __call__(self, text: str) -> np.ndarray:
        """Numbers of the text's groups; none if tokens don't join to it."""
        known = self.known
        pieces = [p[1:] for p in self.pattern.findall(f" {text}")] if self.other.search(text) else text.split(" ")
        parts = [*map(known.get, pieces)]
        if missing := [i for i, x in enumerate(parts) if x is None]:
            # In the order of the text: only its last piece may end in white space.
            new = [p for p in dict.fromkeys([pieces[i] for i in missing]) if p not in known.old]
            made = self._groups(new) if new else {}
            if len(made) < len(new):
                return np.zeros(0, dtype=np.uint32)
            known.encode = lambda p: made[p] if p in made else self._aligned(p)
            for i in missing:
                p = pieces[i]
                parts[i] = made[p] if len(p) >= CACHE_LENGTH else known[p]
        return np.frombuffer(b"".join(parts), dtype=np.uint32)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


class _Block:
    """Documents, with the numbers that their groups have in the worker."""

    def __init__(self, align: Aligner) -> None:
        if len(align.keys) > KNOWN_GROUPS:
            align.forget()
        self.align, self.docs, self.n = align, [], 0

    def add(self, doc_id, text: str | None) -> None:
        numbers = self.align(text) if text else np.zeros(0, dtype=np.uint32)
        groups, times = np.unique(numbers, return_counts=True)
        sha = hashlib.sha256(";".join(map(self.align.keys.__getitem__, numbers.tolist())).encode()).hexdigest() if len(numbers) else ""
        self.docs.append((doc_id, sha, groups, times))
        self.n += len(numbers)

    def rows(self, block: int) -> Iterator[tuple]:
        """A row for each document, and one for each of the block's groups."""
        here = np.unique(np.concatenate([g for _, _, g, _ in self.docs])) if self.docs else np.zeros(0, dtype=np.uint32)
        keys = [self.align.keys[i] for i in here.tolist()]
        n_a = np.array([k.count(",", 0, k.index("|")) + 1 for k in keys], dtype=np.int64)
        n_b = np.array([k.count(",") + 2 for k in keys], dtype=np.int64) - n_a
        freq, docs = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for doc_id, sha, groups, m in self.docs:
            at = np.searchsorted(here, groups)
            freq[at] += m
            docs[at] += 1
            yield block, doc_id, int(m @ n_a[at]), int(m @ n_b[at]), int(m.sum()), sha, at.astype("<u4").tobytes(), m.astype("<u4").tobytes(), None, None, None, None
        for i, (k, f, d) in enumerate(zip(keys, freq.tolist(), docs.tolist(), strict=True)):
            yield block, None, None, None, None, None, None, None, i, k, f, d


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """Documents and groups of each block, in one table.

    Documents: block, doc_id, n_a, n_b, n_groups, groups_sha256,
    groups and times (the numbers of their distinct groups in the block, and how often
    each occurs, as little-endian unsigned 32-bit integers). Groups: block, number, key,
    freq, in_docs.
    """
    a, b = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)

    def run(batches: Iterator) -> Iterator[tuple]:
        align, part, n = aligner(a, b), TaskContext.get().partitionId(), 0
        block = _Block(align)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(row, text)
                if block.n >= block_groups:
                    yield from block.rows(part * 2**32 + n)
                    block, n = _Block(align), n + 1
        yield from block.rows(part * 2**32 + n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups binary, times binary, number int, key string, freq long, in_docs long"
    return written(map_rows(docs.select("doc_id", "text"), run, schema))


def dictionary(blocks: DataFrame) -> DataFrame:
    """(key, freq, in_docs): the distinct groups of the corpus, how often each occurs and in how many documents."""
    return blocks.where("number IS NOT NULL").groupBy("key").agg(F.sum("freq").alias("freq"), F.sum("in_docs").alias("in_docs"))


def links(groups: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(key, freq, in_docs, a, b, n): the distinct links of each group and how often each occurs in it."""
    a_file, b_file = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)

    def run(batches: Iterator) -> Iterator[tuple]:
        align = aligner(a_file, b_file)
        for batch in batches:
            for key, freq, in_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = ids_of(key)
                found: dict[tuple[int, int], int] = {}
                i = j = 0
                at_a, at_b = len(align.a_bytes[a[0]]), len(align.b_bytes[b[0]])
                while True:
                    found[a[i], b[j]] = found.get((a[i], b[j]), 0) + 1
                    if at_a < at_b:
                        i += 1
                        at_a += len(align.a_bytes[a[i]])
                    elif at_b < at_a:
                        j += 1
                        at_b += len(align.b_bytes[b[j]])
                    else:  # ends meet at the end alone
                        break
                for (x, y), n in found.items():
                    yield key, freq, in_docs, x, y, n

    return map_rows(groups.select("key", "freq", "in_docs"), run, "key string, freq long, in_docs long, a int, b int, n long")


def counts(linked: DataFrame, weight: str = "freq") -> DataFrame:
    """(a, b, count, best): links of each pair of ids corpus-wide, and whether no other pair of its B id has more.

    weight is `freq`, which counts all links, or `in_docs`, which counts those of a group once a document.
    """
    if weight not in ("freq", "in_docs"):
        raise ValueError("weight must be freq or in_docs")
    pairs = linked.groupBy("a", "b").agg(F.sum(F.col("n") * F.col(weight)).alias("count"))
    top = pairs.groupBy("b").agg(F.max("count").alias("_top"))
    return pairs.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def best_matches(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, weight: str = "freq") -> DataFrame:
    """(b, b_bytes, a, a_bytes, count): for each id of B that occurs, the ids of A it is linked with most."""
    a, b = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)

    def run(batches: Iterator) -> Iterator[tuple]:
        align = aligner(a, b)
        for batch in batches:
            for x, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield y, align.b_bytes[y], x, align.a_bytes[x], n

    best = counts(links(dictionary(aligned(docs, a, b)), a, b), weight).where("best")
    return map_rows(best.select("a", "b", "count"), run, "b int, b_bytes binary, a int, a_bytes binary, count long")


def measured(blocks: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Each document of `aligned` with n_links, n_best and count_sum."""
    linked = written(links(dictionary(blocks), a_path, b_path))
    pairs = counts(linked)
    groups = (
        linked.join(pairs, ["a", "b"])
        .groupBy("key")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    )
    back = blocks.where("number IS NOT NULL").select(F.col("block").alias("of"), "number", "key").join(groups, "key").select("of", "number", "n_best", "count_sum")
    docs = blocks.where("number IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times")
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded(docs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a block."""
        size = (max(right["number"].to_pylist()) + 1) if len(right) else 0
        best, total = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        if size:
            at = right["number"].to_numpy()
            best[at], total[at] = right["n_best"].to_numpy(), right["count_sum"].to_numpy()
        n_best, sums = [], []
        for g, t in zip(left["groups"].to_pylist(), left["times"].to_pylist(), strict=True):
            g, t = np.frombuffer(g, dtype="<u4"), np.frombuffer(t, dtype="<u4").astype(np.int64)
            n_best.append(int(t @ best[g]))
            sums.append(int(t @ total[g]))
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    rows = docs.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(aligned(table(spark, sf_dir, "documents")))
