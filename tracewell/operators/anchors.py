"""Where given strings occur in many texts, without an index of all strings.

A string is known by a 64-bit hash of some bytes of it (LENGTHS); a filter of the wanted
hashes, of bounded size, is sent to the tasks, and each reads its texts at every position.
A hash may stand for other strings, so what is found holds all occurrences, and perhaps more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes that are hashed: the most that a string has.
LENGTHS = (3, 6, 8, 12, 16)
#: The most bits of a filter, as a power of two: 16 MiB.
FILTER_BITS = 27
#: Positions that are hashed at once, and hits that a task holds before it adds them up.
SLAB, HELD = 2**18, 2**21
#: The part of a hash that is wanted in every part.
EVERYWHERE = -1
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def hashes(buffer: np.ndarray, n: int, length: int) -> np.ndarray:
    """Hashes of the `length` bytes at each of the first n positions of a buffer that goes on for 16 bytes."""
    eight = lambda at: np.ndarray((n,), "<u8", buffer, at, (1,))
    if length < 8:
        return (eight(0) & np.uint64(2 ** (8 * length) - 1)) * _MULTIPLIERS[0]
    return eight(0) * _MULTIPLIERS[0] if length == 8 else eight(0) * _MULTIPLIERS[0] + eight(length - 8) * _MULTIPLIERS[1]


def _in_part(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Hashes of keys in a part of the files."""
    h = (keys ^ (part.astype(np.int64) + 1).view(np.uint64) * _MULTIPLIERS[2]) * _MULTIPLIERS[1]
    return (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[0]


def alternative(runs: list[str]) -> tuple[int, list[int]]:
    """(bytes hashed, keys) of the longest strings that a text with all these runs contains."""
    coded = [r.encode("utf-8", "replace") for r in runs]
    length = max(n for n in LENGTHS if n <= max(map(len, coded)))
    keys: set[int] = set()
    for r in coded:
        if len(r) >= length:
            keys.update(hashes(np.frombuffer(r + bytes(16), dtype=np.uint8), len(r) - length + 1, length).view(np.int64).tolist())
    return length, sorted(keys)


def part_of(order, bounds: list) -> int:
    """The part of the files that a path lies in, or would; bounds are the parts' first paths, in order."""
    return max(0, bisect_right(bounds, order) - 1)


def _mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _filter(keys: DataFrame, n: int, places: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """A filter, as bytes, of n keys (key, part): the highest bits of the hashes that `places` makes of them."""
    bits = min(FILTER_BITS, max(16, (64 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate(places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)))
            at = (h >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "bit"])

    # At most 2^bits / 64 rows, however many keys.
    rows = _mapped(keys.select("key", "part"), run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(2**bits // 64, dtype="<u8")
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _everywhere(h: np.ndarray) -> np.ndarray:
    return _in_part(h, np.full(len(h), EVERYWHERE))


def _plain(keys: DataFrame, n: int) -> np.ndarray:
    """A filter of n keys, whatever their parts, with two places for each."""
    return _filter(keys.withColumn("part", F.lit(0).cast("long")), n, lambda h, _: [h, _everywhere(h)])


def _passes(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - (8 * len(held)).bit_length() + 1)).view(np.int64)
    return np.flatnonzero((held[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _hits(data: np.ndarray, offsets: np.ndarray, lengths: list[int], held: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, positions, their rows, keys) of what the filter lets through, a slab at a time."""
    buffer = np.zeros(SLAB + 16, dtype=np.uint8)
    for start in range(int(offsets[0]), int(offsets[-1]), SLAB):
        n = min(SLAB, int(offsets[-1]) - start)
        more = data[start : start + n + 16]
        buffer[: len(more)], buffer[len(more) :] = more, 0
        for length in lengths:
            h = hashes(buffer, n, length)
            at = _passes(h, held)
            at = at[_passes(_everywhere(h[at]), held)]
            pos = at + start
            row = np.searchsorted(offsets, pos, "right") - 1
            ok = pos + length <= offsets[row + 1]
            yield length, pos[ok], row[ok], h[at[ok]]


def _sizes(keys: DataFrame) -> tuple[list[int], int]:
    """(lengths, number) of keys."""
    of = {r["length"]: r["count"] for r in keys.groupBy("length").count().collect()}
    return sorted(of), sum(of.values())


def _summed(key: np.ndarray, part: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return key, part, n
    order = np.lexsort((part, key)) if part.any() else np.argsort(key)
    key, part = key[order], part[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    return key[first], part[first], np.add.reduceat(n[order], first)


def counts(rows: DataFrame, keys: DataFrame, bounds: list | None = None, split: bool = True) -> DataFrame:
    """(key, part, n): how often keys (length, key) occur in rows (path, text); by part of the paths if there are bounds, which are lists of components with `split`, else in part 0."""
    lengths, size = _sizes(keys)
    shared = rows.sparkSession.sparkContext.broadcast(_plain(keys, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, parts, size = empty, [], 0
        for b in batches:
            data, offsets = _texts(b.column(1))
            of = None if bounds is None else np.array([part_of(p.split("/") if split else p, bounds) for p in b.column(0).to_pylist()], dtype=np.int64)
            for _, _, row, key in _hits(data, offsets, lengths, shared.value):
                parts.append((key, np.zeros(len(key), np.int64) if of is None else of[row], np.ones(len(key), np.int64)))
                size += len(key)
                if size >= HELD:
                    sums = _summed(*(np.concatenate(x) for x in zip(sums, *parts, strict=True)))
                    parts, size = [], 0
                    if len(sums[0]) >= HELD:
                        yield made(sums)
                        sums = empty
        yield made(_summed(*(np.concatenate(x) for x in zip(sums, *parts, strict=True))))

    def made(sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums[0].view(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["key", "part", "n"])

    found = _mapped(rows.select("path", "text"), run, "key long, part long, n long")
    return found.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key", "part").agg(F.sum("n").alias("n"))


def lines_with(rows: DataFrame, keys: DataFrame, bounds: list, split: bool = True) -> DataFrame:
    """(path, part, binary, line, raw, keys) of the lines of rows (path, text) that have any of keys (length, key, part) in their parts, or, if part is EVERYWHERE, in any."""
    lengths, size = _sizes(keys)
    context = rows.sparkSession.sparkContext
    shared, by_part = context.broadcast(_plain(keys, size)), context.broadcast(_filter(keys, size, lambda h, part: [_in_part(h, part)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _texts(b.column(1))
            paths = b.column(0).to_pylist()
            of = np.array([part_of(p.split("/") if split else p, bounds) for p in paths], dtype=np.int64)
            ends = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
            stops = np.r_[ends, offsets[-1]]
            found = []
            for length, pos, row, key in _hits(data, offsets, lengths, shared.value):
                ok = np.union1d(_passes(_in_part(key, of[row]), by_part.value), _passes(_everywhere(key), by_part.value))
                pos, row, key = pos[ok], row[ok], key[ok]
                k = np.searchsorted(ends, pos)  # line ends before the position
                ok = pos + length <= stops[k]
                found.append((row[ok], k[ok], key[ok]))
            if not sum(len(f[0]) for f in found):
                continue
            row, k, key = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((key, k, row))
            row, k, key = row[order], k[order], key[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (k[1:] != k[:-1])]
            ok = new | np.r_[True, key[1:] != key[:-1]]
            row, k, key, new = row[ok], k[ok], key[ok], new[ok]
            first = np.flatnonzero(new)
            row, k, upto = row[first], k[first], np.r_[first, len(key)]
            begin = np.maximum(offsets[row], np.where(k > 0, stops[k - 1] + 1, 0))
            end = np.minimum(offsets[row + 1], stops[k])
            line = k - np.searchsorted(ends, offsets[row]) + 1
            binary = np.zeros(len(paths), dtype=bool)
            binary[np.searchsorted(offsets, np.flatnonzero(data[offsets[0] : offsets[-1]] == 0) + offsets[0], "right") - 1] = True
            step = 4096
            for i in range(0, len(row), step):
                j = min(len(row), i + step)
                raw = pa.array([data[s:e].tobytes() for s, e in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)], pa.binary())
                held = pa.ListArray.from_arrays(pa.array((upto[i : j + 1] - upto[i]).astype(np.int32)), pa.array(key[upto[i] : upto[j]].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([paths[r] for r in row[i:j].tolist()], pa.string()), pa.array(of[row[i:j]]), pa.array(binary[row[i:j]]), pa.array(line[i:j].astype(np.int32)), raw, held],
                    names=["path", "part", "binary", "line", "raw", "keys"],
                )

    found = _mapped(rows.select("path", "text"), run, "path string, part long, binary boolean, line int, raw binary, keys array<long>")
    return found.withColumn("raw", F.col("raw").cast("string"))
