"""MinHash near-deduplication on SetSketch registers.

A document's sketch holds, for each register, the least of exponential variates of
its shingles, truncated to a whole power of the base. Sketches of equal seeds merge
by maximum and agree on a register with about the chance of the Jaccard similarity.
Steps:

1. One scan: the set's size, a digest of the set, and its registers. Documents of
   equal sets are one class from here on.
2. Bands of registers put classes into buckets. Every member of a bucket is paired
   with its smallest member only; a joint likelihood of the two sketches drops pairs
   that are far below the threshold, and the rest is confirmed on full sets.
3. Components of the confirmed links. A bucket whose members still have several labels
   gets a further centre, from the largest label but the main one, that is held against
   the members of other labels in the same way; again, as long as that brings the members
   outside the main labels down by a quarter a round.
4. In buckets that still have several labels the members outside the main one are a query
   set that is held against all members, in blocks of bounded size, on full sets; a block
   returns no more links than it takes to connect what it found.
5. Components of all confirmed links; each class takes its label.

With 48 bands of 6 registers a pair at similarity 0.85 shares no bucket with a
chance of about 1e-10 (0.8: 5e-7).

Defined results: null and empty texts have no shingles and are linked with nothing;
texts of fewer words than a shingle are one shingle; rows with a null id are linked
with nothing (component null, kept); rows that repeat an id are one document, and
all get its result; ids may be of any type that can be ordered, and the smallest names
a component; a very long text is a set like any other; an empty table gives an empty
result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_rows
from .common import mix64, ngram_hashes, numbered, table, text_of, word_hashes, written
from .components import components

BANDS, ROWS = 48, 6
BASE = 1.01
#: Levels above the register of one element.
_LEVELS = 4096
#: How much less likely (as a natural logarithm) the threshold may be than the best fit before a pair is dropped.
MARGIN = 12.0
#: Shingles in a block of step 4.
BLOCK = 2**16
#: Step 3 ends when more than this share of the members outside the main labels is left.
PROGRESS = 0.75
#: Ids (8 bytes each) that are broadcast at most; beyond, the same join shuffles.
BROADCAST_ROWS = 2_000_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(width, len(words))))


def _factors(m: int) -> np.ndarray:
    return mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def registers(elements: np.ndarray, m: int, base: float = BASE) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: exponentially spaced truncated minima."""
    least = np.full(m, 2**64 - 1, dtype=np.uint64)
    factors = _factors(m)
    step = max(1, 2**16 // m)
    for i in range(0, len(elements), step):
        np.minimum(least, (elements[i : i + step, None] * factors[None, :]).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(exponential) / np.log(base)), 0, _LEVELS).astype(np.uint16)


def _loglik(similarity, u, v, above, below, same, base: float = BASE):
    """Joint log likelihood of two sketches whose sets have shares u and v = 1 - u of the summed sizes."""

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)

    j = np.minimum(similarity, np.minimum(u / v, v / u))
    up, down = p(u - v * j), p(v - u * j)
    return above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


def may_link(n_a, n_b, a: np.ndarray, b: np.ndarray, threshold: float, margin: float = MARGIN) -> np.ndarray:
    """Whether pairs of sketches (rows of a and b) may reach the threshold, by likelihood."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    fits = np.stack([_loglik(np.full(len(u), j), u, v, above, below, same) for j in np.linspace(0.0, 0.999, 60)])
    best = np.linspace(0.0, 0.999, 60)[fits.argmax(axis=0)]
    at = _loglik(np.full(len(u), threshold), u, v, above, below, same)
    sizes_allow = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    return sizes_allow & ((best >= threshold) | (fits.max(axis=0) - at <= margin))


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, digest, registers, bands) of each document, in one scan."""
    m = bands * rows

    def run(batches: Iterator) -> Iterator[tuple]:
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, width)
                if not len(s) or d is None:
                    yield d, len(s), None, None
                    continue
                yield d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s, m).tobytes()

    return map_rows(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, "doc_id long, n long, digest binary, registers binary", flush=1024)


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, h, rep): the bucket of each class in each band."""

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            reps = np.array(b.column(0).to_pylist(), dtype=np.int64)
            if not len(reps):
                continue
            r = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(len(reps), bands, rows)
            h = np.zeros((len(reps), bands), dtype=np.uint64)
            for i in range(rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + r[:, :, i].astype(np.uint64) + np.uint64(1))
            yield {"band": np.tile(np.arange(bands, dtype=np.int32), len(reps)), "h": h.reshape(-1).view(np.int64), "rep": np.repeat(reps, bands)}

    return map_rows(classes.select("rep", "registers"), run, "band int, h long, rep long")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes that the sketches don't rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator) -> Iterator[dict]:
        for x in batches:
            a, n_a, r_a, b, n_b, r_b = (x.column(i).to_pylist() for i in range(6))
            if not a:
                continue
            of = lambda r: np.frombuffer(b"".join(r), dtype=np.uint16).reshape(len(a), -1)  # noqa: B023, E731
            ok = may_link(np.array(n_a, dtype=float), np.array(n_b, dtype=float), of(r_a), of(r_b), threshold)
            yield {"a": np.array(a)[ok], "b": np.array(b)[ok]}

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "n_a", "r_a", "b", "n_b", "r_b")
    return map_rows(both, run, "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, s): the full shingle sets of some documents (rep, digest), computed again from their texts."""
    few = reps.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text")).join((F.broadcast(reps) if few else reps).select("rep"), "rep", "left_semi")

    def run(batches: Iterator) -> Iterator[tuple]:
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, width).tobytes()
                yield d, hashlib.blake2b(s, digest_size=16).digest(), s

    # A repeated id may have other texts too; the digest says which one is meant.
    return map_rows(rows, run, "rep long, digest binary, s binary", flush=1024).dropDuplicates(["rep", "digest"]).join(reps, ["rep", "digest"], "left_semi").select("rep", "s")


def _linked(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, on full sets."""

    def run(batches: Iterator) -> Iterator[dict]:
        for x in batches:
            a, b, sa, sb = (x.column(i).to_pylist() for i in range(4))
            ok = []
            for p, q in zip(sa, sb, strict=True):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(_linked(shared, len(p), len(q), percent))
            yield {"a": [v for v, k in zip(a, ok, strict=True) if k], "b": [v for v, k in zip(b, ok, strict=True) if k]}

    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    return map_rows(full.select("a", "b", "sa", "sb"), run, "a long, b long")


def block_links(rows: list[tuple[int, int, bool, bytes]], percent: int) -> list[tuple[int, int]]:
    """Links between query rows and other rows (rep, label, is_query, set) of one block, as few as connect their labels."""
    rows = [(r, label, q, np.frombuffer(s, dtype=np.uint64)) for r, label, q, s in rows]
    members = {r: (label, s) for r, label, q, s in rows if not q}
    queries = {r: (label, s) for r, label, q, s in rows if q}
    if not members or not queries:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    names = list(members)
    label = [members[r][0] for r in names]
    size = np.array([len(members[r][1]) for r in names])
    values = np.concatenate([members[r][1] for r in names])
    owner = np.repeat(np.arange(len(names)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for q, (own, s) in queries.items():
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(names))
        for i in np.flatnonzero(_linked(shared, len(s), size, percent)).tolist():
            if names[i] != q and find(own) != find(label[i]):
                root[find(own)] = find(label[i])
                out.append((q, names[i]))
    return out


def _mixed(members: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(band, h, rep, n, label, main): members of the buckets with several labels; main is the one with most members. sizes: (rep, n)."""
    named = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    by_label = named.groupBy("band", "h", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy("band", "h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
    return written(named.join(main.where("labels > 1").drop("labels"), ["band", "h"]).join(sizes, "rep").select("band", "h", "rep", "n", "label", "main"))


def _next_centres(mixed: DataFrame) -> DataFrame:
    """(a, b): the members of other labels with the smallest member of the largest label but the main one, in each bucket."""
    others = mixed.where("label <> main").groupBy("band", "h", "label").agg(F.count("*").alias("c"), F.min("rep").alias("b"))
    centre = others.groupBy("band", "h").agg(F.max_by(F.struct("b", "label"), F.struct("c", "label")).alias("x")).select("band", "h", "x.b", F.col("x.label").alias("own"))
    return mixed.join(centre, ["band", "h"]).where("label <> own").select(F.col("rep").alias("a"), "b").distinct()


def _blocked(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 4: links between the labels of a bucket.

    Query rows (outside the main label) and members of a bucket are each cut into parts of
    about BLOCK shingles, and each part of the one meets each part of the other in one block.
    """
    parts = inside.groupBy("band", "h").agg(F.sum("n").alias("w"), F.sum(F.when(F.col("label") != F.col("main"), F.col("n"))).alias("q"))
    inside = inside.join(parts.select("band", "h", F.expr(f"cast(1 + w div {BLOCK} AS int)").alias("m_parts"), F.expr(f"cast(1 + q div {BLOCK} AS int)").alias("q_parts")), ["band", "h"])
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    member = inside.select("band", "h", "rep", "label", F.lit(False).alias("q"), F.explode(F.expr("sequence(0, q_parts - 1)")).alias("i"), part("m_parts").alias("j"))
    query = inside.where("label <> main").select("band", "h", "rep", "label", F.lit(True).alias("q"), part("q_parts").alias("i"), F.explode(F.expr("sequence(0, m_parts - 1)")).alias("j"))
    rows = member.unionByName(query).join(sets, "rep")
    keys = ["band", "h", "i", "j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "rep", "label", "q", "s")

    def run(batches: Iterator) -> Iterator[tuple]:
        key, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != key:
                    yield from block_links(held, percent)
                    key, held = r[:4], []
                held.append(r[4:])
        yield from block_links(held, percent)

    return map_rows(rows, run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document: links at a Jaccard similarity of at least percent / 100."""
    docs, back = numbered(docs, "text")
    scan = written(sketches(docs, width, bands, rows))
    classes = scan.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min_by("registers", "doc_id").alias("registers"))
    by_digest = written(classes)
    # An id with several texts stands in links for one of them.
    classes = written(by_digest.dropDuplicates(["rep"]))
    buckets = _buckets(classes, bands, rows)
    centres = buckets.groupBy("band", "h").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").drop("last")
    members = written(buckets.join(centres, ["band", "h"]))
    pairs = members.where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    likely = written(_likely(pairs, classes, percent / 100))
    in_buckets = written(members.select("rep").distinct().join(classes.select("rep", "digest"), "rep"))
    sets = written(_sets(docs, in_buckets, width))
    first = written(_confirmed(likely, sets, percent))
    links, sizes, outside = first, classes.select("rep", "n"), None
    while True:
        final = components(links)
        mixed = _mixed(members.select("band", "h", "rep"), final, sizes)
        left = mixed.where("label <> main").count()
        if not left:
            break
        if outside is not None and left > PROGRESS * outside:
            final = components(links.unionByName(_blocked(mixed, sets, percent)))
            break
        outside = left
        links = written(links.unionByName(_confirmed(_likely(_next_centres(mixed), classes, percent / 100), sets, percent)))
    labelled = by_digest.select("digest", "rep").join(final.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    labelled = written(labelled)
    out = scan.select("doc_id", "n", "digest").join(labelled, "digest", "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    return back(out, "doc_id", "component_id")


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, with its own columns only; rows with a null id stay."""
    kept = near_duplicates(docs, **options).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("k")).distinct()
    packed = docs.select(F.col("doc_id").cast(kept.schema["k"].dataType).alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    one = packed.where("k IS NOT NULL").join(kept, "k", "left_semi").dropDuplicates(["k"])
    return one.unionByName(packed.where("k IS NULL")).select("r.*")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
