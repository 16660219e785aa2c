"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every position with `depth` bytes from it on is a suffix, and only its first `depth`
bytes (its window) count. Suffixes are ordered by most-significant-digit passes of 8
bytes of the text each (`radix_groups`); after a pass a suffix that is alone in its group
drops out, and groups that are left after the last pass are exactly the repeated windows:
bytes decide, never a hash. To sort every suffix where it lies would take rows of many
times the input, so suffixes are dealt to buckets in which equal windows must meet:

1. A window's anchor is the least-hash `block`-byte part of it, the leftmost if there
   are several. Equal windows have equal anchors in equal places, and neighbours share
   theirs, so a run of about 30 suffixes is one row. Runs whose anchor's digest occurs
   once in all documents can't repeat and drop out.
2. The runs that are left travel with all bytes of their windows to their anchor's bucket.
   Runs of equal bytes are equal window by window; where an anchor has runs of different
   bytes, the suffixes of one of each kind are radix-sorted.
3. An anchor with very many different runs (the edge of a passage that a third of all
   documents share) is no bucket of its own: its windows are dealt one by one, first as
   digests, of which those that occur once drop out, then with their bytes by digest.

A unit of some documents (a few MB, by hash) combines its equal rows before they are
dealt out, so a passage in a third of all documents is a row a unit, not a row a
document. Replies go back to units as bit masks. Digests and hashes only choose buckets
and drop what can't repeat. Buckets are as many as the text needs, at least the session's
number of shuffle partitions.

Earlier means a smaller doc_id, or the same row and an earlier start.

Defined results: null text is empty; rows with a null id come after all others, and
neither they nor rows that repeat an id are earlier than one another; an empty table
gives an empty result; extra columns are not read, whatever their names; ids may be of
any type that can be ordered. A very long text is a unit by itself and takes about 50 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .arrowmap import bounded, map_rows, ship
from .common import mix64, numbered, prefix_hash, span_hash, step_hash, table, text_of, written

DEPTH = 100
BLOCK = 40
UNIT_BYTES = 2 * 2**20
#: Text whose runs meet in a bucket, about.
BUCKET_BYTES = 8 * 2**20
#: Windows of a bucket that are sorted at once.
SORTED = 2**18
#: Different runs of an anchor from which on its windows are dealt one by one.
HOT_RUNS = 2000
_LAST = 2**63 - 1
#: Bits of a place in a unit: a text has less than 2^31 bytes.
_PLACE_BITS = np.uint64(34)
_DIGIT = 8


def radix_groups(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, group): the suffixes, as indexes into starts, that share their first `depth` bytes with another one,
    ordered by those bytes and then as given, and the number of the group that each is in.

    Most significant digits first; after each pass groups of one drop out.
    """
    live, group = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for at in range(0, depth, _DIGIT):
        digit = np.zeros(len(live), dtype=np.uint64)
        for i in range(at, min(at + _DIGIT, depth)):
            digit = (digit << np.uint64(8)) | raw[starts[live] + i]
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        several = (np.bincount(number) > 1)[number] if len(live) else new
        live, group = live[several], number[several]
    return live, group


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of columns first stands, and the number of each row among them."""
    order = np.lexsort(columns)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    entry = np.empty(len(order), dtype=np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def _first_in_row(entry: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether no earlier item of the same row has the same entry; items stand in text order."""
    order = np.lexsort((row, entry))
    first = np.ones(len(order), dtype=bool)
    first[order[1:]] = (entry[order][1:] != entry[order][:-1]) | (row[order][1:] != row[order][:-1])
    return first


def _masks(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unmasked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    return (digit >> np.uint64(20)) % np.uint64(buckets)


def _dealt(bucket_of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its items in order) of the buckets that have some."""
    order = np.argsort(bucket_of, kind="stable")
    edges = np.searchsorted(bucket_of[order], np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, order[edges[k] : edges[k + 1]]


def _six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


class Unit:
    """The suffixes of some documents, as runs that share an anchor."""

    def __init__(self, rows: pa.Table, depth: int, block: int) -> None:
        ids = rows.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (_LAST if ids[i] is None else ids[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.depth, self.block = depth, block
        self.doc = np.array([_LAST if d is None else d for d in self.ids], dtype=np.int64)
        self.bytes = b"".join(texts[i] for i in order)
        self.raw = np.frombuffer(self.bytes, dtype=np.uint8)
        size = np.array([len(texts[i]) for i in order], dtype=np.int64)
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        windows = np.maximum(size - depth + 1, 0)
        self.prefix = prefix_hash(self.raw)
        total = int(windows.sum())
        if not total:
            self.g = self.ctx = np.zeros(0, dtype=np.uint64)
            self.start = self.stop = self.row = self.anchor = np.zeros(0, dtype=np.int64)
        else:
            # Arrays of 8 bytes for each byte of text: as few at a time as can be.
            ranked = step_hash(self.prefix, block)
            ranked >>= _PLACE_BITS
            ranked <<= _PLACE_BITS
            ranked |= np.arange(len(ranked), dtype=np.uint64)
            ranked = _sliding_min(ranked, depth - block + 1)
            ranked &= (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
            first = np.arange(total)
            first += np.repeat(self.begins - np.cumsum(windows) + windows, windows)
            anchor = ranked[first].view(np.int64)
            del ranked
            cut = np.flatnonzero(np.diff(anchor, prepend=-1))
            self.start, self.stop = first[cut], first[np.append(cut[1:], total) - 1]
            self.anchor = anchor[cut]
            del first, anchor
            self.g = span_hash(self.prefix, self.anchor, self.anchor + block)
            shape = ((self.anchor - self.start) * 4096 + (self.stop - self.start)).astype(np.uint64)
            self.ctx = mix64(span_hash(self.prefix, self.start, self.stop + depth) ^ (shape * np.uint64(0x9E3779B97F4A7C15)))
            self.row = np.searchsorted(self.ends, self.start, side="right")
        # What the first deal says: anchors with a digest of the run around them, each pair once.
        self.pair, self.pair_of = _distinct(self.ctx, self.g)
        self.pair_bucket = lambda buckets: _bucket(self.g[self.pair], buckets)

    def told(self, replies: list[tuple[int, bytes, bytes]], buckets: int) -> None:
        """Takes the replies to the first deal: which runs are left, and which of these have hot anchors."""
        left, hot = np.zeros(len(self.pair), dtype=bool), np.zeros(len(self.pair), dtype=bool)
        there = {k: (a, b) for k, a, b in replies}
        for k, mine in _dealt(self.pair_bucket(buckets), buckets):
            if k in there:
                left[mine], hot[mine] = (_unmasked(x, len(mine)) for x in there[k])
        _, by_anchor = np.unique(self.g, return_inverse=True)
        left, hot = left[self.pair_of], hot[self.pair_of]
        left |= (np.bincount(by_anchor) > 1)[by_anchor]
        self.runs, self.hot = np.flatnonzero(left & ~hot), np.flatnonzero(left & hot)

    def gather(self) -> None:
        """The entries of the runs that are left: `kinds` of place and bytes, where each first stands, and its least document."""
        # Runs of equal bytes around anchors in equal places are one entry.
        numbers: dict[tuple[int, bytes], int] = {}
        raw, depth = self.bytes, self.depth
        begin, end, place = self.start[self.runs], self.stop[self.runs] + depth, self.anchor[self.runs]
        self.entry = np.array([numbers.setdefault((a - i, raw[i:j]), len(numbers)) for i, j, a in zip(begin.tolist(), end.tolist(), place.tolist(), strict=True)], dtype=np.int64)
        self.kinds = list(numbers)
        _, head = np.unique(self.entry, return_index=True)
        self.head = self.runs[head]
        self.entry_doc = self.doc[self.row[self.head]]

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, rows and places within all windows of some runs."""
        n = self.stop[runs] - self.start[runs] + 1
        begin = np.cumsum(n) - n
        at = np.repeat(self.start[runs] - begin, n) + np.arange(n.sum())
        return at, np.repeat(self.row[runs], n), begin

    def repeated_in_row(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of windows by start, whether the same row has an equal one among them that starts earlier."""
        which, group = radix_groups(self.raw, at, self.depth)
        out = np.zeros(len(at), dtype=bool)
        out[which] = ~_first_in_row(group, row[which])
        return out

    def hot_windows(self) -> None:
        """The windows of hot runs: starts, rows, and an entry for each distinct window."""
        self.hot_at, self.hot_row, _ = self.windows(self.hot)
        which, group = radix_groups(self.raw, self.hot_at, self.depth)
        number = np.arange(len(self.hot_at)) + len(which)
        number[which] = group
        _, head, self.hot_entry = np.unique(number, return_index=True, return_inverse=True)
        self.hot_head = self.hot_at[head]
        self.hot_doc = self.doc[self.hot_row[head]]
        self.hot_digest = mix64(span_hash(self.prefix, self.hot_head, self.hot_head + self.depth))


def _joined(held: list[tuple], i: int, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[i], dtype=kind) for r in held])


def _edges(sizes: list[int]) -> list[tuple[int, int]]:
    e = np.cumsum([0, *sizes]).tolist()
    return list(zip(e[:-1], e[1:], strict=True))


def _least(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each item's group."""
    least = np.full(int(group.max(initial=-1)) + 1, _LAST, dtype=np.int64)
    np.minimum.at(least, group, doc)
    return least[group]


def _anchors(held: list[tuple], hot_runs: int) -> Iterator[tuple]:
    """Reply to the first deal: which anchors occur in other units too, and which have very many different runs."""
    g = np.concatenate([_of_six(r[3]) for r in held])
    ctx = _joined(held, 4, "<u4")
    unit = np.repeat(np.arange(len(held)), [len(r[4]) // 4 for r in held])
    _, by_g = np.unique(g, return_inverse=True)
    first, _ = _distinct(unit, by_g)
    left = (np.bincount(by_g[first]) > 1)[by_g]
    first, _ = _distinct(ctx, by_g)
    hot = (np.bincount(by_g[first]) >= hot_runs)[by_g]
    for r, (i, j) in zip(held, _edges([len(r[4]) // 4 for r in held]), strict=True):
        if left[i:j].any() or hot[i:j].any():
            yield r[0], r[1], 0, _masks(left[i:j]), _masks(hot[i:j]), b""


def _runs(held: list[tuple], depth: int, block: int) -> Iterator[tuple]:
    """Reply to runs with their bytes: which entries have all windows in a smaller document, which are open, and the windows of those."""
    numbers: dict[tuple[int, bytes], int] = {}
    blocks: dict[bytes, int] = {}
    kind, block_of = [], []
    for r in held:
        size, place, raw = np.frombuffer(r[3], dtype="<u4").tolist(), np.frombuffer(r[4], dtype="<u4").tolist(), _unzipped(r[6])
        at = 0
        for n, a in zip(size, place, strict=True):
            key = (a, raw[at : at + n])
            at += n
            k = numbers.setdefault(key, len(numbers))
            kind.append(k)
            if k == len(block_of):
                block_of.append(blocks.setdefault(key[1][a : a + block], len(blocks)))
    doc, kind = _joined(held, 5, "<i8"), np.array(kind, dtype=np.int64)
    least = np.full(len(numbers), _LAST, dtype=np.int64)
    np.minimum.at(least, kind, doc)
    block_of = np.array(block_of, dtype=np.int64)
    mixed = (np.bincount(block_of) > 1)[block_of]
    earlier = doc > least[kind]
    # Anchors with different runs: a radix sort of the suffixes of one run of each kind, some anchors at a time.
    which = np.flatnonzero(mixed)
    which = which[np.argsort(block_of[which], kind="stable")]
    texts = [text for _, text in numbers]
    n = np.array([len(texts[k]) - depth + 1 for k in which.tolist()], dtype=np.int64)
    begin = np.cumsum(n) - n
    before = np.repeat(least[which], n)
    last_of_block = np.flatnonzero(np.append(np.diff(block_of[which]) != 0, True)) + 1 if len(which) else which
    at = 0
    while at < len(which):
        more = last_of_block[last_of_block > at]
        fits = more[begin[more - 1] + n[more - 1] - begin[at] <= SORTED]
        to = int(fits[-1]) if len(fits) else int(more[0])
        part = slice(int(begin[at]), int(begin[to - 1] + n[to - 1]))
        raw = np.frombuffer(b"".join([texts[k] for k in which[at:to].tolist()]), dtype=np.uint8)
        starts = np.arange(part.stop - part.start) + np.repeat(np.arange(to - at), n[at:to]) * (depth - 1)
        found, group = radix_groups(raw, starts, depth)
        before[part.start + found] = _least(group, before[part.start + found])
        at = to
    slot = np.full(len(numbers), -1, dtype=np.int64)
    slot[which] = np.arange(len(which))
    for r, (i, j) in zip(held, _edges([len(r[5]) // 8 for r in held]), strict=True):
        gone, open_, bits = earlier[i:j].copy(), np.zeros(j - i, dtype=bool), []
        for e in np.flatnonzero(~gone & mixed[kind[i:j]]).tolist():
            s = slot[kind[i + e]]
            mine = before[begin[s] : begin[s] + n[s]] < doc[i + e]
            gone[e] = mine.all()
            open_[e] = not gone[e]
            if open_[e]:
                bits.append(mine)
        if gone.any() or open_.any():
            yield r[0], r[1], 1, _masks(gone), _masks(open_), _zipped(_masks(np.concatenate(bits))) if bits else b""


def _digests(held: list[tuple]) -> Iterator[tuple]:
    """Reply to digests of the windows of hot anchors: which occur in other units too."""
    digest = np.concatenate([_of_six(r[3]) for r in held])
    _, by = np.unique(digest, return_inverse=True)
    left = (np.bincount(by) > 1)[by]
    for r, (i, j) in zip(held, _edges([len(r[3]) // 6 for r in held]), strict=True):
        if left[i:j].any():
            yield r[0], r[1], 2, _masks(left[i:j]), b"", b""


def _windows(held: list[tuple], depth: int) -> Iterator[tuple]:
    """Reply to windows of hot anchors with their bytes: which a smaller document has."""
    raw = np.frombuffer(b"".join(_unzipped(r[6]) for r in held), dtype=np.uint8)
    doc = _joined(held, 5, "<i8")
    which, group = radix_groups(raw, np.arange(len(doc)) * depth, depth)
    earlier = np.zeros(len(doc), dtype=bool)
    earlier[which] = doc[which] > _least(group, doc[which])
    for r, (i, j) in zip(held, _edges([len(r[5]) // 8 for r in held]), strict=True):
        if earlier[i:j].any():
            yield r[0], r[1], 3, _masks(earlier[i:j]), b"", b""


_REPLY = "unit int, bucket int, kind int, a binary, b binary, c binary"
_DEAL = "unit int, bucket int, kind int, a binary, b binary, doc binary, raw binary"


def _grouped(df: DataFrame, depth: int, block: int, hot_runs: int, buckets: int) -> DataFrame:
    """The replies to what units deal out, bucket by bucket and kind by kind, kept as a table; a bucket is sized by BUCKET_BYTES, and there is a task for each."""
    answer = {0: lambda held: _anchors(held, hot_runs), 1: lambda held: _runs(held, depth, block), 2: _digests, 3: lambda held: _windows(held, depth)}

    def run(batches: Iterator) -> Iterator[tuple]:
        key, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[1:3] != key:
                    if held:
                        yield from answer[key[1]](held)
                    key, held = r[1:3], []
                held.append(r)
        if held:
            yield from answer[key[1]](held)

    return written(map_rows(df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind"), run, _REPLY))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, block: int = BLOCK, with_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document without the bytes of repeated windows, and `text` if asked for."""
    spark = docs.sparkSession
    bounded(docs)
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    units = max(1, -(-total // UNIT_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    docs, back = numbered(docs, "text")
    text = text_of()
    rows = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(units)).cast("int").alias("unit"), "doc_id", text.alias("text"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    arrow = {x: to_arrow_schema(_parse_datatype_string(x)) for x in (_DEAL, result)}

    def table_of(schema: str, rows: Iterator[tuple]) -> pa.Table:
        fields = arrow[schema]
        columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def by_kind(replies: pa.Table) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {k: [] for k in range(4)}
        for bucket, kind, *said in zip(*(replies.column(c).to_pylist() for c in ("bucket", "kind", "a", "b", "c")), strict=True):
            out[kind].append((bucket, *said))
        return out

    def unit_of(part: pa.Table, said: dict[int, list[tuple]], gathered: bool = True) -> Unit:
        u = Unit(part, depth, block)
        u.told([r[:3] for r in said[0]], buckets)
        if len(u.hot):
            u.hot_windows()
        if gathered:
            u.gather()
        return u

    def by_anchor(key, part):
        u = Unit(part, depth, block)
        g, ctx = u.g[u.pair], (u.ctx[u.pair] >> np.uint64(32)).astype("<u4")
        return table_of(_DEAL, ((key[0].as_py(), k, 0, _six(g[mine]), ctx[mine].tobytes(), b"", b"") for k, mine in _dealt(u.pair_bucket(buckets), buckets)))

    def by_run(key, part, replies):
        if not len(part):
            return table_of(_DEAL, iter(()))
        u, unit = unit_of(part, by_kind(replies)), key[0].as_py()

        def each() -> Iterator[tuple]:
            size = np.array([len(t) for _, t in u.kinds], dtype="<u4")
            place = np.array([a for a, _ in u.kinds], dtype="<u4")
            for k, mine in _dealt(_bucket(u.g[u.head], buckets), buckets):
                yield unit, k, 1, size[mine].tobytes(), place[mine].tobytes(), u.entry_doc[mine].astype("<i8").tobytes(), _zipped(b"".join([u.kinds[i][1] for i in mine.tolist()]))
            if len(u.hot):
                for k, mine in _dealt(_bucket(u.hot_digest, buckets), buckets):
                    yield unit, k, 2, _six(u.hot_digest[mine]), b"", b"", b""

        return table_of(_DEAL, each())

    def hot_left(u: Unit, said: dict[int, list[tuple]]) -> np.ndarray:
        """Hot windows, by entry, that other units have too."""
        left, there = np.zeros(len(u.hot_head), dtype=bool), {r[0]: r[1] for r in said[2]}
        for k, mine in _dealt(_bucket(u.hot_digest, buckets), buckets):
            if k in there:
                left[mine] = _unmasked(there[k], len(mine))
        return np.flatnonzero(left)

    def by_window(key, part, replies):
        said = by_kind(replies)
        if not len(part) or not said[2]:
            return table_of(_DEAL, iter(()))
        u = unit_of(part, said, gathered=False)
        left = hot_left(u, said)
        return table_of(
            _DEAL,
            (
                (key[0].as_py(), k, 3, b"", b"", u.hot_doc[left[mine]].astype("<i8").tobytes(), _zipped(b"".join([u.bytes[i : i + depth] for i in u.hot_head[left[mine]].tolist()])))
                for k, mine in _dealt(_bucket(u.hot_digest[left], buckets), buckets)
            ),
        )

    def cleaned(key, part, replies):
        if not len(part):
            return table_of(result, iter(()))
        said = by_kind(replies)
        u = unit_of(part, said)
        drop = np.zeros(len(u.raw) + 1, dtype=np.int64)

        def remove(start: np.ndarray, stop: np.ndarray) -> None:
            np.add.at(drop, start, 1)
            np.add.at(drop, stop, -1)

        gone, open_ = np.zeros(len(u.kinds), dtype=bool), np.zeros(len(u.kinds), dtype=bool)
        bits: dict[int, np.ndarray] = {}
        there = {r[0]: r[1:] for r in said[1]}
        for k, mine in _dealt(_bucket(u.g[u.head], buckets), buckets):
            if k not in there:
                continue
            a, b, c = there[k]
            gone[mine], open_[mine] = _unmasked(a, len(mine)), _unmasked(b, len(mine))
            opened = mine[open_[mine]]
            if len(opened):
                n = u.stop[u.head[opened]] - u.start[u.head[opened]] + 1
                every = _unmasked(_unzipped(c), int(n.sum()))
                bits |= {e: every[i:j] for e, (i, j) in zip(opened.tolist(), _edges(n.tolist()), strict=True)}
        whole = gone[u.entry] | (u.doc[u.row[u.runs]] > u.entry_doc[u.entry]) | ~_first_in_row(u.entry, u.row[u.runs])
        remove(u.start[u.runs[whole]], u.stop[u.runs[whole]] + depth)
        rest = np.flatnonzero(open_[u.entry] & ~whole)
        if len(rest):
            at, row, begin = u.windows(u.runs[rest])
            earlier = np.zeros(len(at), dtype=bool)
            for i, e in zip(begin.tolist(), u.entry[rest].tolist(), strict=True):
                if e in bits:
                    earlier[i : i + len(bits[e])] = bits[e]
            hit = at[earlier | u.repeated_in_row(at, row)]
            remove(hit, hit + depth)
        if len(u.hot):
            earlier = np.zeros(len(u.hot_head), dtype=bool)
            left, there = hot_left(u, said), {r[0]: r[1] for r in said[3]}
            for k, mine in _dealt(_bucket(u.hot_digest[left], buckets), buckets):
                if k in there:
                    earlier[left[mine]] = _unmasked(there[k], len(mine))
            hit = u.hot_at[earlier[u.hot_entry] | (u.doc[u.hot_row] > u.hot_doc[u.hot_entry]) | ~_first_in_row(u.hot_entry, u.hot_row)]
            remove(hit, hit + depth)
        hit = np.cumsum(drop[:-1]) > 0

        def each() -> Iterator[tuple]:
            for d, i, j in zip(u.ids, u.begins.tolist(), u.ends.tolist(), strict=True):
                mine = hit[i:j]
                left = u.raw[i:j][~mine].tobytes()
                spans = int(mine[:1].sum()) + int((np.diff(mine.view(np.int8)) == 1).sum())
                yield d, j - i, int(mine.sum()), spans, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] * with_text)

        return table_of(result, each())

    units_ = rows.groupBy("unit")
    first = _grouped(units_.applyInArrow(by_anchor, _DEAL), depth, block, hot_runs, buckets)
    second = _grouped(units_.cogroup(first.groupBy("unit")).applyInArrow(by_run, _DEAL), depth, block, hot_runs, buckets)
    so_far = first.unionByName(second)
    third = _grouped(units_.cogroup(so_far.groupBy("unit")).applyInArrow(by_window, _DEAL), depth, block, hot_runs, buckets)
    return back(units_.cogroup(so_far.unionByName(third).groupBy("unit")).applyInArrow(cleaned, result), "doc_id")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
