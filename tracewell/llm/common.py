"""What the corpus operators share: word patterns, the shared folder, 64-bit word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_MASK = 2**64 - 1
_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 2**64)
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file:///tmp/tracewell-checkpoints').rstrip('/')}/tracewell-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Has the folder removed when the driver ends: what is in it serves results that end with the session."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(there)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(docs with doc_id as a long and `columns`, a function that gives columns of such numbers back as ids).

    Whole numbers stand for themselves. Ids of another type are numbered in their order, null staying null.
    """
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns), lambda df, *names: df
    ids = written(docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy("doc_id").select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_no")))
    rows = docs.select("doc_id", *columns).join(ids, F.col("doc_id") == F.col("_id"), "left").select(F.col("_no").alias("doc_id"), *columns)

    def back(df: DataFrame, *names: str) -> DataFrame:
        order = df.columns
        for n in names:
            df = df.join(ids.select(F.col("_no").alias(n), F.col("_id").alias("_back")), n, "left").drop(n).withColumnRenamed("_back", n)
        return df.select(*order)

    return rows, back


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_RADIX)) | np.uint64(1)


class Powers:
    """Powers of the radix and of its inverse, grown as needed and kept by the process."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, len(self.up) + 2**20)
            for name, base in (("up", _RADIX), ("down", _RADIX_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times the inverse radix to the i, the polynomial hash of raw[i:j]."""
    up, _ = _POWERS.upto(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[raw] * up[: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte spans [start, end)."""
    _, down = _POWERS.upto(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def step_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash of the spans of a width that start at each byte."""
    n = len(prefix) - width
    _, down = _POWERS.upto(len(prefix))
    return mix64((prefix[width:] - prefix[:n]) * down[:n] + np.uint64(width))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ in raw bytes."""
    edge = np.diff(np.concatenate(([1], _IS_SPACE[raw].view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    if lower:
        raw = _TO_LOWER[raw]
    start, end = word_spans(raw)
    return span_hash(prefix_hash(raw), start, end)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a row of word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(_RADIX) + words[i : i + len(out)] + np.uint64(i + 1))
    return out
