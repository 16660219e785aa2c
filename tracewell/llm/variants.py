"""Spelling variants: words one edit apart, hung on the more frequent one.

Every word of the vocabulary puts out its full neighbourhood: all distinct deletions,
replacements and insertions over the letters that the vocabulary has. What of it equals a
word of the vocabulary is a near word, by an equi-join; nothing has to be compared.

A neighbourhood has about 2 x letters x length members, nearly none of them words. Their
64-bit hashes follow from sums over the word's prefixes, without spelling them, and those
that a Bloom filter of the vocabulary rules out go no further; the others are spelled and
joined. The filter has 32 bits a word up to FILTER_BITS, a fixed bound; beyond it more
candidates are joined and the result is the same.

A word's form is its near word of the largest count (ties: the smallest in code-point
order) if that is at least `ratio` times its own; its root is where following forms ends,
found by doubling the steps. Counts at least double on the way, so it takes few rounds.

Defined results: null texts have no words, null words and equal words of a given
vocabulary are dropped and summed; a null id stands for the empty text in a query's hash;
extra columns are not read; an empty table gives an empty result; very long words are
worked out in slabs of positions; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_rows
from .common import ascii_lower, mix64, table, written

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Bits of the filter at most, as a power of two: 16 MiB.
FILTER_BITS = 27
#: Hashes of candidates that a task works out at a time.
SLAB = 2**20
#: Words whose neighbourhoods one task puts out, about.
TASK_WORDS = 20_000
#: Letters of a word, and every which hash loses a letter in the query.
LETTERS, DROPPED = "A-Za-zÀ-ÿ", 97

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _symbols(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    return mix64(h + np.uint64((length + 1) * 0xD6E8FEB86659FD93 % 2**64))


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, words of it, their code points)."""
    of: dict[int, list[str]] = {}
    for w in words:
        of.setdefault(len(w), []).append(w)
    for n, some in of.items():
        yield n, some, np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(some), n)


def _powers(n: int) -> np.ndarray:
    up = np.full(n, _RADIX, dtype=np.uint64)
    up[0] = 1
    return np.cumprod(up, dtype=np.uint64)


def word_hashes(points: np.ndarray) -> np.ndarray:
    n = points.shape[1]
    return _finish((_symbols(points) * _powers(n + 1)[:n]).sum(axis=1, dtype=np.uint64), n)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Four places of the filter for each hash."""
    for k in range(4):
        yield (h >> np.uint64(64 - bits)).astype(np.int64)
        h = mix64(h + np.uint64(k + 1))


def passes(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes that the filter lets through."""
    left = np.arange(len(h))
    for k in range(4):
        at = (h >> np.uint64(64 - bits)).astype(np.int64)
        ok = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        left, h = left[ok], h[ok]
        h = mix64(h + np.uint64(k + 1))
    return left


def neighbourhood(some: list[str], points: np.ndarray, alphabet: str, words: np.ndarray, bits: int) -> Iterator[tuple[int, str]]:
    """(row, candidate): distinct words one edit from each of some words of one length that the filter lets through."""
    n = points.shape[1]
    letters = np.frombuffer(alphabet.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    s, a, up = _symbols(points), _symbols(letters), _powers(n + 2)
    slab = max(1, SLAB // len(a))
    step = max(1, slab // (n + 1))  # words at a time, and positions of one word
    for r in range(0, len(some), step):
        own, own_points = s[r : r + step], points[r : r + step]
        head = np.zeros((len(own), n + 1), dtype=np.uint64)
        np.cumsum(own * up[:n], axis=1, dtype=np.uint64, out=head[:, 1:])
        total = head[:, n:]
        # Deletions: of equal letters in a row the first goes.
        h = _finish(head[:, :n] + (total - head[:, 1:]) * _INVERSE, n - 1)
        distinct = np.ones(h.shape, dtype=bool)
        distinct[:, 1:] = own_points[:, 1:] != own_points[:, :-1]
        row, at = np.nonzero(distinct)
        for k in passes(h[row, at], words, bits).tolist():
            w = some[r + row[k]]
            yield r + int(row[k]), w[: at[k]] + w[at[k] + 1 :]
        for i in range(0, n + 1, slab):
            j = min(n + 1, i + slab)
            # Insertions before position i: not behind an equal letter, which would be the same.
            h = _finish(head[:, i:j, None] + a * up[i:j, None] + ((total - head[:, i:j]) * _RADIX)[:, :, None], n + 1)
            distinct = np.ones(h.shape, dtype=bool)
            first = max(i, 1)
            distinct[:, first - i :] = own_points[:, first - 1 : j - 1, None] != letters
            row, at, c = np.nonzero(distinct)
            for k in passes(h[row, at, c], words, bits).tolist():
                w, x = some[r + row[k]], i + int(at[k])
                yield r + int(row[k]), w[:x] + alphabet[c[k]] + w[x:]
            j = min(n, j)
            if i >= j:
                continue
            # Replacements by another letter.
            h = _finish(total[:, :, None] + (a - own[:, i:j, None]) * up[i:j, None], n)
            row, at, c = np.nonzero(own_points[:, i:j, None] != letters)
            for k in passes(h[row, at, c], words, bits).tolist():
                w, x = some[r + row[k]], i + int(at[k])
                yield r + int(row[k]), w[:x] + alphabet[c[k]] + w[x + 1 :]


def _filter(vocabulary: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(64-bit words of a Bloom filter of the vocabulary, its size as a power of two)."""
    bits = min(FILTER_BITS, max(16, (32 * n - 1).bit_length()))

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            for _, _, points in _by_length(b.column(0).to_pylist()):
                at = np.concatenate(list(_probes(word_hashes(points), bits)))
                yield {"at": at >> 6, "bit": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)}

    # At most 2^bits / 64 rows, whatever the vocabulary.
    rows = map_rows(vocabulary.select("word"), run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(2**bits // 64, dtype=np.uint64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words, bits


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of different words of a vocabulary (word, n) that are one edit apart, either way round."""
    spark = vocabulary.sparkSession
    n = vocabulary.count()
    if not n:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # One row a letter: a bounded number.
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))
    words, bits = _filter(vocabulary, n)
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator) -> Iterator[tuple]:
        held = shared.value
        for b in batches:
            count = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for _, some, points in _by_length(list(count)):
                for row, candidate in neighbourhood(some, points, alphabet, held, bits):
                    yield some[row], count[some[row]], candidate

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_WORDS))
    candidates = map_rows(vocabulary.select("word", "n").repartition(tasks), run, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): where following forms ends; each round doubles the steps."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = at.join(further, F.col("root") == F.col("_at"), "left")
        at = written(moved.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        if at.where("_moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variant_groups(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    vocabulary = written(vocabulary.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(vocabulary).select("word", "n", F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")).alias("_near"))
    every = vocabulary.select("word", "n", F.lit(None).cast(near.schema["_near"].dataType).alias("_near")).unionByName(near)
    best = every.groupBy("word", "n").agg(F.count("_near").alias("n_near"), F.min("_near").alias("_best"))
    has = -F.col("_best.m") >= ratio * F.col("n")
    rows = written(best.select("word", "n", "n_near", F.when(has, F.col("_best.w")).alias("form"), F.when(has, -F.col("_best.m")).alias("form_n")))
    found = roots(rows.where("form IS NOT NULL"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change=None) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased; change(run) says what a run counts as."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    if change:
        words = words.select(change(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def misspelt(run: Column) -> Column:
    """A run of the row's document with a letter lost, for about every 97th of them: the query's own test errors."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROPPED == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(vocabulary(table(spark, sf_dir, "documents"), change=misspelt))
