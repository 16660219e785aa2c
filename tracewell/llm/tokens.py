"""Token ids in a compact binary file format.

Texts are encoded with a public tokenizer, an end id is appended to each, and the
ids go to files in ascending document order. In a file the ids are replaced by
their frequency rank in that file (its header lists the ids by rank) and coded
like Stream VByte: two control bits an integer, four integers a control byte,
apart from one to four little-endian data bytes an integer. Reading looks the
control bytes up in a table of 256 entries and needs no loop over integers.

Layout, little-endian: magic `TWTK`, version u32, docs u64, tokens u64, ranked ids
u64; ids by rank u32; doc ids i64; a null flag u8 for each doc id; document
lengths u64; control bytes; data bytes.

The files are rows of a Parquet table in the shared folder, as workers share no
other file system; `export_files` copies them out as plain files.

Defined results: null text is empty and gets the end id alone; null ids come last
in the order; rows equal in id are ordered by text; an empty table gives no file
and an empty result; extra columns are not read. Strings of special tokens in a
text are taken as the tokenizer takes them by default. Files hold ids of documents as 64-bit
numbers, so ids of another type are refused. A very long text is encoded whole, and is a file by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .arrowmap import map_rows
from .common import table, text_of, written

MAGIC, VERSION = b"TWTK", 1
END_ID = 2
FILE_TOKENS = 2**21
#: Distinct words that a worker keeps encoded, twice.
CACHE_WORDS = 400_000

_HEAD = struct.Struct("<4sIQQQ")
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
_PLACES = np.arange(4)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def vbyte(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned integers below 2^32."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << (2 * _PLACES).astype(np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[size[:, None] > _PLACES].tobytes()


def unvbyte(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[size[:, None] > _PLACES] = data
    return out.reshape(-1).view("<u4")


def packed_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file of documents."""
    count = np.bincount(ids)
    seen = np.flatnonzero(count)
    order = np.argsort(-count[seen], kind="stable")
    rank = np.zeros(len(count), dtype=np.uint32)
    rank[seen[order]] = np.arange(len(seen), dtype=np.uint32)
    control, data = vbyte(rank[ids])
    return b"".join(
        (
            _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(seen)),
            seen[order].astype("<u4").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
            np.array(lengths, dtype="<u8").tobytes(),
            control,
            data,
        )
    )


def unpacked_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, lengths and ids of a file."""
    magic, version, docs, tokens, ranked = _HEAD.unpack_from(content)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    by_rank, ids, null, lengths = take("<u4", ranked), take("<i8", docs), take("u1", docs), take("<u8", docs)
    control = take("u1", -(-tokens // 4))
    ranks = unvbyte(control, take("u1", len(content) - at), tokens)
    return [None if z else int(d) for d, z in zip(ids, null, strict=True)], lengths.astype(np.int64), by_rank[ranks]


class _Words(dict):
    """Ids of a word's text as bytes; words of the last two generations are kept."""

    def __init__(self, encode, limit: int = CACHE_WORDS) -> None:
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}


class Encoder:
    """Encodes as the tokenizer does. Byte-level BPE never merges across the words
    that its pattern cuts, so each distinct word is encoded once and remembered; a
    tokenizer of another kind, and a text with a special token, goes through it whole."""

    def __init__(self, path: str) -> None:
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = "<u2" if self.whole.get_vocab_size() <= 2**16 else "<u4"
        # Fixed value: the classes by which byte-level BPE cuts words. No two of the first three begin alike, so the frequent ones are tried first.
        self.pattern = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") if plain else None
        # The same for texts in ASCII, where the classes are plain.
        self.ascii = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
        self.letters, self.merges = _byte_letters(), self.whole.model
        self.coded = [np.array([i], dtype=self.kind).tobytes() for i in range(self.whole.get_vocab_size())]
        self.words = _Words(self._word)

    def _word(self, word: str) -> bytes:
        """The ids of one word, by the tokenizer's merges alone."""
        coded = self.coded
        plain = word.isascii() and word.isprintable()
        shown = word.replace(" ", self.letters[32]) if plain else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([coded[t.id] for t in self.merges.tokenize(shown)])

    def __call__(self, text: str) -> np.ndarray:
        if self.pattern is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind)
        return np.frombuffer(b"".join(map(self.words.__getitem__, (self.ascii if text.isascii() else self.pattern).findall(text))), dtype=self.kind)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """The table of files: part and number in ascending document order, offset (tokens of
    its part before it), docs, tokens, content."""
    where = path or tokenizer_path()
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")

    def run(batches: Iterator) -> Iterator[tuple]:
        encode, part = encoder(where), TaskContext.get().partitionId()
        number = offset = n = 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(np.append(encode(t), end_id).astype("<u4"))
                doc_ids.append(d)
                n += len(ids[-1])
                if n >= file_tokens:
                    yield part, number, offset, len(doc_ids), n, packed_file(doc_ids, [len(x) for x in ids], np.concatenate(ids))
                    number, offset, n, ids, doc_ids = number + 1, offset + n, 0, [], []
        if doc_ids:
            yield part, number, offset, len(doc_ids), n, packed_file(doc_ids, [len(x) for x in ids], np.concatenate(ids))

    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    sorted_ = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), order[0]).sortWithinPartitions(*order)
    return written(map_rows(sorted_, run, "part int, number int, offset long, docs long, tokens long, content binary", flush=4))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from its file; start counts the tokens of all documents before it."""

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            for part, offset, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc_ids, lengths, ids = unpacked_file(content)
                ends = np.cumsum(lengths)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                yield {
                    "part": np.full(len(doc_ids), part, dtype=np.int32),
                    "doc_id": doc_ids,
                    "at": offset + ends - lengths,
                    "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)],
                }

    # One row for each range partition, so this table is small by construction.
    parts = files.groupBy("part").agg(F.sum("tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = map_rows(files.select("part", "offset", "content"), run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> int:
    """Copies the files to a local folder, one at a time; returns their number."""
    from pathlib import Path

    n = 0
    Path(folder).mkdir(parents=True, exist_ok=True)
    for r in files.orderBy("part", "number").toLocalIterator():
        Path(folder, f"tokens-{r['part']:05d}-{r['number']:05d}.twtk").write_bytes(bytes(r["content"]))
        n += 1
    return n


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents")))
