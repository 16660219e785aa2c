"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order from two.

A document is padded with order - 1 begin marks and one end. Counting:

1. A scan finds the frequent words. Each batch reports the words that hold at least half
   the share sought in it, so no word of that share is missed. They have short codes in
   what is dealt out, and the n-grams of the most frequent ones are split.
2. A scan gathers n-grams, sums equal ones up for a few million tokens at a time, and
   deals them out by the last word of their context, those of a frequent one also by the
   word before (by the word itself at order two). So a bucket has whole contexts of every
   length from two words, and every word that stands to the left of a shorter n-gram: it
   counts all orders from two up without another exchange, and writes n-grams and
   contexts as sorted hash arrays to the shared folder.
3. Counts of words, and the bigrams of frequent contexts, which lie in several buckets,
   are dealt out by word, summed up and written likewise.

Only counts of counts, a row a bucket and the totals of frequent words come to the
driver. Scoring: workers memory-map the arrays; no n-gram is dealt out again.

Buckets are as many as the text needs at BUCKET_BYTES each, at least the session's
number of shuffle partitions. Words are known by 48 bits of their hash. An array of n
hashes keeps 32 bits beyond the 2^b parts of about 16 hashes that an index cuts it
into, so an n-gram that isn't there is taken for one that is with a chance of 4e-9.
Counts have 64 bits.

Defined results: null text is empty and is scored on its end alone; a null id counts
as the empty text in the choice of training documents, so it trains; rows that repeat
an id train as often as they occur; without training documents every probability is
1; an empty table gives an empty result; extra columns are not read, whatever their
names; a very long text is one text, and its n-grams are summed up like those of others.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import map_rows
from .common import mix64, passing, shared_dir, table, text_of, word_hashes, written

ORDER = 3
BEGIN, END = np.uint64(1), np.uint64(2)
_DROP = np.uint64(16)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a worker gathers before it deals out their n-grams, and that it scores at once.
COUNT_TOKENS, SCORE_TOKENS = 2_000_000, 500_000
#: Text that a bucket's n-grams come from, about.
BUCKET_BYTES = 16 * 2**20
#: Share of a bucket that makes a word frequent, and the ways in which its n-grams are split.
HOT_SHARE, HOT_SPLIT = 0.1, 32
#: Share of all tokens that makes a word common: at most 2 / COMMON_SHARE words, 8 bytes each, go to every worker.
COMMON_SHARE = 2e-5


def ids_of(text: str | None) -> np.ndarray:
    """Word ids of a text."""
    return word_hashes(text) >> _DROP


def _grams(documents: list[np.ndarray], order: int) -> np.ndarray:
    """(order, tokens): the n-grams of documents of word ids, the farthest word first; one ends at each word and at each end."""
    begin = np.full(order - 1, BEGIN, dtype=np.uint64)
    end = np.array([END], dtype=np.uint64)
    line = np.concatenate([x for d in documents for x in (begin, d, end)])
    size = np.array([len(d) + 1 for d in documents])
    at = np.arange(size.sum()) + np.repeat((order - 1) * np.arange(len(size)), size)
    return np.stack([line[at + i] for i in range(order)])


def _chain(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... rows of words, from the last one on."""
    out = [mix64(words[-1] + _GOLD)]
    for w in words[-2::-1]:
        out.append(mix64(out[-1] * _GOLD + w))
    return out


def _route(grams: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    context = grams[-2]
    beside = grams[-3] if len(grams) > 2 else grams[-1]
    split = np.isin(context, hot) * (np.uint64(1) + mix64(beside) % np.uint64(HOT_SPLIT))
    return mix64(context + split * _GOLD) % np.uint64(buckets)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key first stands, by key, and the sums of its counts."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return order[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _packed(a: np.ndarray) -> bytes:
    """Integers in the fewest bytes each, all first bytes, then all second ones and so on, compressed, behind their width and size."""
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _six(ids: np.ndarray) -> bytes:
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


class Store:
    """Named arrays in files under a folder that driver and workers share: little-endian
    arrays, a JSON index of them, and its length. On a file system that is mounted they are mapped in place;
    from another store a worker fetches a copy to its own temp folder."""

    #: Names that Hadoop has for stores which pyarrow knows by another.
    SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "hdfs": "hdfs"}

    def __init__(self, root: str) -> None:
        self.root = root

    def _local(self) -> str | None:
        url = urlparse(self.root)
        return url.path if url.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        scheme, rest = self.root.split("://", 1)
        if scheme not in self.SCHEMES:
            raise ValueError(f"the model can't be stored under {self.root}")
        return fs.FileSystem.from_uri(f"{self.SCHEMES[scheme]}://{rest}")

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        index, at, parts = {}, 0, []
        for key, a in arrays.items():
            a = a.astype(a.dtype.newbyteorder("<"), copy=False)
            gap = -at % 8
            parts += [b"\0" * gap, a.tobytes()]
            at += gap + a.nbytes
            index[key] = (at - a.nbytes, a.dtype.str, len(a))
        said = json.dumps(index).encode()
        self._write(name, b"".join([*parts, said, len(said).to_bytes(8, "little")]))

    def _write(self, name: str, content: bytes) -> None:
        if local := self._local():
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}.{os.getpid()}.{np.random.default_rng().integers(2**62)}"
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, f"{local}/{name}")
            return
        system, path = self._remote()
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(content)

    def get(self, name: str) -> dict[str, np.ndarray]:
        local = self._local()
        if not local:
            import hashlib
            import tempfile

            local = f"{tempfile.gettempdir()}/tracewell-{hashlib.md5(self.root.encode()).hexdigest()}"
            if not os.path.exists(f"{local}/{name}"):
                system, path = self._remote()
                Store(local)._write(name, system.open_input_stream(f"{path}/{name}").read())
        raw = np.asarray(np.memmap(f"{local}/{name}", dtype=np.uint8, mode="r"))
        said = int.from_bytes(raw[-8:].tobytes(), "little")
        index = json.loads(raw[-8 - said : -8].tobytes())
        return {k: raw[at : at + np.dtype(kind).itemsize * n].view(kind) for k, (at, kind, n) in index.items()}


def _sorted_hashes(name: str, keys: np.ndarray, columns: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a table of distinct 64-bit hashes with columns (columns, keys) of counts: an index of the
    leading bits, the next 32 bits, and each column in a byte, or where that is 255 in a list of places and values."""
    order = np.argsort(keys)
    keys, columns = keys[order], columns[:, order]
    bits = max(1, len(keys).bit_length() - 4)
    head = (keys >> np.uint64(64 - bits)).astype(np.int64)
    out = {
        f"{name}.index": np.searchsorted(head, np.arange(2**bits + 1)).astype("<u8" if len(keys) >= 2**32 else "<u4"),
        f"{name}.rest": (keys >> np.uint64(32 - bits)).astype("<u4"),
    }
    for i, c in enumerate(columns):
        large = np.flatnonzero(c >= 255)
        out |= {f"{name}.{i}": np.minimum(c, 255).astype(np.uint8), f"{name}.{i}.at": large.astype("<u8"), f"{name}.{i}.large": c[large].astype("<u8")}
    return out


def _places(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of keys, in any order, are in a table, and where."""
    index, rest = arrays[f"{name}.index"], arrays[f"{name}.rest"]
    if not len(rest) or not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bits = (len(index) - 1).bit_length() - 1
    head, want = (keys >> np.uint64(64 - bits)).astype(np.int64), (keys >> np.uint64(32 - bits)).astype("<u4")
    low, end = index[head].astype(np.int64), index[head + 1].astype(np.int64)
    high = end.copy()
    while (low < high).any():
        mid = (low + high) >> 1
        less = rest[np.minimum(mid, len(rest) - 1)] < want
        open_ = low < high
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    at = np.minimum(low, len(rest) - 1)
    there = np.flatnonzero((low < end) & (rest[at] == want))
    return there, at[there]


def _looked_up(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray, columns: int) -> np.ndarray:
    """(columns, keys): the columns of keys, 0 where they aren't there."""
    out = np.zeros((columns, len(keys)), dtype=np.int64)
    there, at = _places(arrays, name, keys)
    for i in range(columns):
        got = arrays[f"{name}.{i}"][at].astype(np.int64)
        big = np.flatnonzero(got == 255)
        if len(big):
            got[big] = arrays[f"{name}.{i}.large"][np.searchsorted(arrays[f"{name}.{i}.at"], at[big])]
        out[i, there] = got
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts 1 to 4; fixed ones where those can't be estimated."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    by = np.array([0.0, *d])
    return np.maximum(counts - by[np.minimum(counts, 3)], 0.0)


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], dtype=np.int64)


def _context_stats(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts, and (4, contexts): the sum of their counts and the numbers of counts 1, 2 and more."""
    order = np.argsort(contexts, kind="stable")
    ranked, c = contexts[order], counts[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, dtype=np.int64)
    if not len(at):
        return ranked, np.zeros((4, 0), dtype=np.int64)
    return ranked[at], np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c > 2)])


def _grouped(df: DataFrame, reduce_bucket, schema: str) -> DataFrame:
    """Calls reduce_bucket on the rows of each bucket (the first column) in turn; a bucket is sized by BUCKET_BYTES."""

    def run(batches: Iterator) -> Iterator[tuple]:
        key, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != key:
                    if held:
                        yield from reduce_bucket(key, held)
                    key, held = r[0], []
                held.append(r)
        if held:
            yield from reduce_bucket(key, held)

    return map_rows(df.repartition("bucket").sortWithinPartitions("bucket"), run, schema)


def _gathered(texts: DataFrame, each, schema: str) -> DataFrame:
    """Calls each on the word ids of texts, COUNT_TOKENS at a time."""

    def run(batches: Iterator) -> Iterator[tuple]:
        documents, held = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                documents.append(ids_of(t))
                held += len(documents[-1]) + 1
                if held >= COUNT_TOKENS:
                    yield from each(documents)
                    documents, held = [], 0
        if documents:
            yield from each(documents)

    return map_rows(texts, run, schema)


def frequent_words(texts: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Words, the most frequent first, and the shares counted of them: all that are at least `share` of all tokens, and perhaps some of half that; so at most 2 / share."""

    def each(documents: list[np.ndarray]) -> Iterator[tuple]:
        word, n = np.unique(np.concatenate(documents), return_counts=True)
        tokens = int(n.sum()) + len(documents)
        often = np.flatnonzero(n >= share / 2 * tokens)
        yield 0, tokens
        yield from zip(word[often].view(np.int64).tolist(), n[often].tolist(), strict=True)

    seen = written(_gathered(texts, each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens = (seen.where("word = 0").first() or {"n": 0})["n"]
    often = seen.where((F.col("word") != 0) & (F.col("n") >= share / 2 * tokens)).collect()
    often.sort(key=lambda r: (-r["n"], r["word"]))
    return np.array([r["word"] for r in often], dtype=np.uint64), np.array([r["n"] / tokens for r in often])


class Words:
    """Writes sets of words: frequent ones by their rank, others by their ids."""

    def __init__(self, ranked: np.ndarray) -> None:
        self.ranked, self.order = ranked, np.argsort(ranked)
        self.sorted = ranked[self.order]

    def write(self, words: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
        """Steps between ranks, other ids, and the code of each word: its place among both, frequent ones first."""
        at = np.minimum(np.searchsorted(self.sorted, words), max(0, len(self.sorted) - 1))
        known = self.sorted[at] == words if len(self.sorted) else np.zeros(len(words), dtype=bool)
        rank = np.sort(self.order[at[known]])
        code = np.empty(len(words), dtype=np.int64)
        code[known] = np.searchsorted(rank, self.order[at[known]])
        code[~known] = len(rank) + np.arange((~known).sum())
        return _packed(np.diff(rank, prepend=0)), _six(words[~known]), code

    def read(self, steps: bytes, others: bytes) -> np.ndarray:
        return np.concatenate([self.ranked[np.cumsum(_unpacked(steps))], _of_six(others)])


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Counts a model over all docs and writes it; returns its description (a few numbers and its folder)."""
    if order < 2:
        raise ValueError("order must be two at least")
    spark = docs.sparkSession
    root = shared_dir(spark) + "-lm"
    texts = docs.select(text_of().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    often, shares = frequent_words(texts, min(HOT_SHARE / buckets, COMMON_SHARE))
    hot = np.sort(np.append(often[shares >= HOT_SHARE / buckets / 2], BEGIN))
    common = Words(often)
    columns = ", ".join(f"c{i} binary" for i in range(order))

    def counted(documents: list[np.ndarray]) -> Iterator[tuple]:
        grams = _grams(documents, order)
        first, n = _summed(_chain(grams)[-1], np.ones(grams.shape[1], dtype=np.int64))
        grams = grams[:, first]
        to = _route(grams, buckets, hot)
        # Words in the order of their contexts compress better.
        by = np.lexsort((*grams[:-2][::-1], grams[-2], to))
        grams, n, to = grams[:, by], n[by], to[by]
        edges = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[k], edges[k + 1]
            words, codes = np.unique(grams[:, i:j], return_inverse=True)
            # Frequent words have small codes.
            steps, others, code = common.write(words)
            yield k, steps, others, _packed(n[i:j]), *(_packed(c) for c in code[codes].reshape(order, -1))

    store = Store(root)

    def merge(bucket: int, held: list[tuple]) -> Iterator[tuple]:
        grams = np.concatenate([np.stack([words[_unpacked(c)] for c in r[4:]]) for r in held for words in (common.read(r[1], r[2]),)], axis=1)
        counts = np.concatenate([_unpacked(r[3]) for r in held])
        chain = _chain(grams)
        raw_word, raw = _summed(grams[-1], counts)
        raw_word = grams[-1][raw_word]
        arrays, about = {}, []
        for level in range(order, 1, -1):
            # Equal n-grams of this length: raw counts at the top, below it the number of words that stand before.
            first, n = _summed(chain[level - 1], counts if level == order else np.ones(grams.shape[1], dtype=np.int64))
            grams, chain = grams[-level:, first], [c[first] for c in chain[:level]]
            mine = ~np.isin(grams[-2], hot) if level == 2 else np.ones(len(n), dtype=bool)
            arrays |= _sorted_hashes(f"{level}", chain[level - 1][mine], n[None, mine])
            context, stats = _context_stats(_chain(grams[:-1][:, mine])[-1], n[mine])
            # Contexts that count once in all need no record but at level two: what ends a word before shows that they are there.
            if level > 2:
                context, stats = context[stats[0] > 1], stats[:, stats[0] > 1]
            arrays |= _sorted_hashes(f"{level}.context", context, stats)
            about.append(_counts_of_counts(n[mine]))
        store.put(f"grams-{bucket}", arrays)
        yield -1, bucket, np.concatenate(about).astype("<i8").tobytes(), b"", b"", b"", b""
        # Words with their counts and the number of words that stand before; bigrams of frequent contexts apart.
        word, left = np.unique(grams[-1][mine], return_counts=True)
        before = np.zeros(len(raw_word), dtype=np.int64)
        before[np.searchsorted(raw_word, word)] = left
        v, w, c = grams[-2][~mine], grams[-1][~mine], n[~mine]
        to, to_w = (mix64(x) % np.uint64(buckets) for x in (raw_word, w))
        for k in np.unique(np.concatenate([to, to_w])).tolist():
            x, y = to == np.uint64(k), to_w == np.uint64(k)
            yield k, bucket, _six(raw_word[x]), _packed(raw[x]), _packed(before[x]), _six(np.concatenate([v[y], w[y]])), _packed(c[y])

    def by_word(bucket: int, held: list[tuple]) -> Iterator[tuple]:
        word = np.concatenate([_of_six(r[2]) for r in held])
        first, raw = _summed(word, np.concatenate([_unpacked(r[3]) for r in held]))
        _, before = _summed(word, np.concatenate([_unpacked(r[4]) for r in held]))
        word = word[first]
        pairs = np.concatenate([_of_six(r[5]).reshape(2, -1) for r in held], axis=1)
        pair = _chain(pairs)[1]
        first, n = _summed(pair, np.concatenate([_unpacked(r[6]) for r in held]))
        pairs, pair = pairs[:, first], pair[first]
        np.add.at(before, np.searchsorted(word, pairs[1]), 1)
        store.put(f"words-{bucket}", _sorted_hashes("word", mix64(word), np.stack([raw, before])) | _sorted_hashes("hot", pair, n[None]))
        # Every word but the begin mark is the last of some n-gram.
        yield -1, bucket, int(raw.sum()), len(word), int(raw[word == END].sum()), int(before.sum()), *_counts_of_counts(before).tolist(), int((before > 2).sum()), *_counts_of_counts(n).tolist()
        context, stats = _context_stats(pairs[0], n)
        for v, s in zip(context.tolist(), stats.T.tolist(), strict=True):
            yield v, bucket, *s, 0, 0, 0, 0, 0, 0, 0, 0, 0

    dealt = _gathered(texts, counted, f"bucket int, steps binary, others binary, n binary, {columns}")
    merged = written(_grouped(dealt, merge, "bucket int, source int, words binary, raw binary, before binary, pairs binary, n binary"))
    # One row for each bucket: their number follows BUCKET_BYTES.
    told = merged.where("bucket < 0").select("source", "words").collect()
    levels = sum((np.frombuffer(bytes(r["words"]), dtype="<i8").reshape(order - 1, 4) for r in told), np.zeros((order - 1, 4), dtype=np.int64))
    schema = "word long, bucket int, tokens long, words long, documents long, before long, b1 long, b2 long, b3 long, b4 long, b_more long, h1 long, h2 long, h3 long, h4 long"
    words = written(_grouped(merged.where("bucket >= 0"), by_word, schema))
    total = words.where("word < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in words.columns[2:])).first()
    passing(spark, root)
    # At most 4 / HOT_SHARE frequent words a bucket, a row each.
    contexts = words.where("word >= 0").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("tokens", "words", "documents", "before"))).collect()
    by = [total[f"b{k}"] for k in (1, 2, 3, 4)]
    levels[-1] += [total[f"h{k}"] for k in (1, 2, 3, 4)]
    d = {k: discounts(row.tolist()) for k, row in zip(range(order, 1, -1), levels, strict=True)} | {1: discounts(by)}
    return {
        "root": root,
        "order": order,
        "buckets": buckets,
        "filled": {r["source"] for r in told},
        "filled_words": {r["bucket"] for r in words.where("word < 0").select("bucket").collect()},
        "hot": hot,
        "hot_stats": {r["word"]: (r["tokens"], r["words"], r["documents"], r["before"]) for r in contexts},
        "train_tokens": total["tokens"],
        "vocabulary": total["words"],
        "documents": total["documents"],
        "discounts": d,
        "before": total["before"],
        "rest": (d[1][0] * by[0] + d[1][1] * by[1] + d[1][2] * total["b_more"]) / total["before"] if total["before"] else 1.0,
    }


class Model:
    """A worker's view of a written model."""

    def __init__(self, about: dict) -> None:
        self.about, self.store, self.open = about, Store(about["root"]), {}
        self.hot_ids = np.array(sorted(about["hot_stats"]), dtype=np.uint64)
        self.hot_stats = np.array([about["hot_stats"][int(i)] for i in self.hot_ids], dtype=np.int64).reshape(-1, 4).T

    def _arrays(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.open:
            self.open[name] = self.store.get(name)
        return self.open[name]

    def _by_bucket(self, to: np.ndarray, filled: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(self.about["buckets"] + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            if k in filled:
                yield k, order[edges[k] : edges[k + 1]]

    def score(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, float, float]]:
        """(tokens, known, base_score, score) of each document of word ids."""
        a, order = self.about, self.about["order"]
        grams = _grams(documents, order)
        tokens = grams.shape[1]
        chain, contexts = _chain(grams), _chain(grams[:-1])
        hot = np.searchsorted(self.hot_ids, grams[-2])
        is_hot = np.isin(grams[-2], a["hot"])
        counts, stats = np.zeros((order + 1, tokens), dtype=np.int64), np.zeros((order + 1, 4, tokens), dtype=np.int64)
        for k, mine in self._by_bucket(_route(grams, a["buckets"], a["hot"]), a["filled"]):
            arrays = self._arrays(f"grams-{k}")
            for level in range(2, order + 1):
                counts[level, mine] = _looked_up(arrays, f"{level}", chain[level - 1][mine], 1)[0]
                stats[level][:, mine] = _looked_up(arrays, f"{level}.context", contexts[level - 2][mine], 4)
        seen = np.zeros((2, tokens), dtype=np.int64)
        for k, mine in self._by_bucket(mix64(grams[-1]) % np.uint64(a["buckets"]), a["filled_words"]):
            arrays = self._arrays(f"words-{k}")
            seen[:, mine] = _looked_up(arrays, "word", mix64(grams[-1][mine]), 2)
            mine = mine[is_hot[mine]]
            counts[2, mine] = _looked_up(arrays, "hot", chain[1][mine], 1)[0]
        known = np.flatnonzero(is_hot)
        known = known[np.isin(grams[-2][known], self.hot_ids)]
        stats[2][:, known] = self.hot_stats[:, hot[known]]
        n = np.array([len(x) + 1 for x in documents])
        at = np.cumsum(n) - n
        for level in range(3, order + 1):
            # The context is the shorter n-gram that ends at the word before; at the begin it was seen if anything was.
            there = np.append(False, counts[level - 1, :-1] > 0)
            there[at] = a["documents"] > 0
            once = np.flatnonzero(there & (stats[level][0] == 0))
            stats[level][:2, once] = 1
        p = _discounted(seen[1], a["discounts"][1]) / max(1, a["before"]) + a["rest"] / (a["vocabulary"] + 1)
        for level in range(2, order + 1):
            total, d = stats[level][0], a["discounts"][level]
            left = np.array(d) @ stats[level][1:]
            p = np.where(total > 0, (_discounted(counts[level], d) + left * p) / np.maximum(total, 1), p)
        base = np.log10((seen[0] + 1) / (a["train_tokens"] + a["vocabulary"] + 1))
        sums = (np.add.reduceat(x, at).tolist() for x in ((seen[0] > 0).astype(np.int64), base, np.log10(p)))
        yield from zip(n.tolist(), *sums, strict=True)


def score(docs: DataFrame, about: dict, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of each document."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator[tuple]:
        model = Model(about)
        held: list[tuple] = []
        size = 0

        def done() -> Iterator[tuple]:
            for (d, _), (n, known, base, s) in zip(held, model.score([x for _, x in held]), strict=True):
                yield d, n, known, base, s, float(10 ** min(300.0, -s / n))

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((d, ids_of(t)))
                size += len(held[-1][1]) + 1
                if size >= SCORE_TOKENS:
                    yield from done()
                    held, size = [], 0
        if held:
            yield from done()

    rows = docs.select(docs[id_column].alias("id"), text_of().alias("text"))
    return map_rows(rows, run, f"id {id_type}, n_tokens long, n_known long, base_score double, score double, perplexity double").withColumnRenamed("id", id_column)


def held_out(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    about = train(docs.where(~held_out(F.col("doc_id"))))
    out = score(docs, about)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(about["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
