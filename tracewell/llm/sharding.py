"""Sharding by extendible hashing.

The directory is indexed by prefix bits of a document's hash. A bucket over the
byte limit splits on its next bit; the others stay. A document's shard is thus the
shortest prefix of its hash whose bucket fits. All this is worked out on a table of
hashes (24 bytes a document): first down to a depth at which nearly every bucket
fits, then, with the hashes of oversized buckets alone, a few bits at a time.

Defined results: null text has 0 bytes; null ids hash like a value of their own;
rows equal in id and text can't be told apart by any hash, share a shard, and are
marked `oversized` if they (or one document alone) exceed the limit; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

LIMIT_BYTES = 16 * 2**20
#: The limit of the registered query: small, so that tables of a few MB split over several depths too.
QUERY_LIMIT_BYTES = 256 * 2**10
#: Bits beyond the even depth that the first descent goes, and bits of each further one.
SLACK, STEP = 8, 8
DEEPEST = 52


def hash_bits(key: Column) -> Column:
    """52 bits of a digest as a long."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def _summed(df: DataFrame, prefix: Column) -> DataFrame:
    return df.groupBy(prefix.alias("_p")).agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n"))


def _shards(leaves: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(_d, _p, _b, _n): buckets of depth first + 1 to last that fit while the one above doesn't, and those at `last` that don't fit either.

    leaves: (_p, _b, _n), bytes and documents of the buckets at depth `last`, all under buckets
    of depth `first` that are over the limit. Sums go up STEP depths at a time, and each
    pass starts from 2^STEP times fewer buckets; no key but a sum's has more than two rows.
    """
    sums, at = None, last
    while at > first:
        top = max(first + 1, at - STEP + 1)
        each = leaves.withColumn("_d", F.explode(F.sequence(F.lit(top), F.lit(at)))).withColumn("_p", F.expr(f"shiftright(_p, {at} - _d)"))
        each = each.groupBy("_d", "_p").agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n"))
        sums = each if sums is None else sums.unionByName(each)
        if top > first + 1:
            leaves = written(_summed(leaves, F.shiftright("_p", at - top + 1)))
        at = top - 1
    pairs = sums.groupBy("_d", F.shiftright("_p", 1).alias("_above")).agg(F.collect_list(F.struct("_p", "_b", "_n")).alias("_both"), F.sum("_b").alias("_sum")).where(F.col("_sum") > limit)
    return pairs.select("_d", F.explode("_both").alias("_x")).select("_d", "_x.*").where((F.col("_b") <= limit) | (F.col("_d") == last))


def _by_leaf(shards: DataFrame, last: int) -> DataFrame:
    """shards with a row for each leaf of depth `last` under them; in two steps, so that no array is long."""

    def under(p: str, bits: str) -> Column:
        return F.explode(F.expr(f"sequence(shiftleft({p}, {bits}), shiftleft({p} + 1, {bits}) - 1)"))

    halfway = shards.withColumn("_h", F.expr(f"cast((_d + {last}) div 2 AS int)"))
    return halfway.withColumn("_q", under("_p", "_h - _d")).withColumn("_leaf", under("_q", f"{last} - _h")).drop("_h", "_q")


def directory(hashes: DataFrame, limit_bytes: int) -> DataFrame:
    """(_bits, _d, _p, _b, _n): the bucket of each hash. hashes: (_bits, _b, _n), distinct hashes with bytes and documents."""
    total = hashes.agg(F.sum("_b"), F.sum("_n")).first()
    if (total[0] or 0) <= limit_bytes:
        return hashes.select("_bits", F.lit(0).alias("_d"), F.lit(0).cast("long").alias("_p"), F.lit(total[0] or 0).cast("long").alias("_b"), F.lit(total[1] or 0).cast("long").alias("_n"))
    placed, first, last = None, 0, min(DEEPEST, math.ceil(math.log2(total[0] / limit_bytes)) + SLACK)
    while True:
        leaf = F.shiftright("_bits", DEEPEST - last)
        shards = written(_shards(written(_summed(hashes, leaf)), first, last, limit_bytes))
        done = shards if last == DEEPEST else shards.where(F.col("_b") <= limit_bytes)
        part = hashes.select("_bits", leaf.alias("_leaf")).join(_by_leaf(done, last).hint("merge"), "_leaf").select("_bits", "_d", "_p", "_b", "_n")
        placed = part if placed is None else placed.unionByName(part)
        over = shards.where(F.col("_b") > limit_bytes).select(F.col("_p").alias("_leaf"))
        if last == DEEPEST or over.isEmpty():
            return placed
        # On with the oversized buckets alone.
        hashes = written(hashes.withColumn("_leaf", leaf).join(over.hint("merge"), "_leaf", "left_semi").drop("_leaf"))
        first, last = last, min(DEEPEST, last + STEP)


def shard(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, shard (its prefix in bits), depth, n_bytes, shard_bytes, shard_docs, oversized."""
    text = text_of()
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\x1f"), text)
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), hash_bits(key).alias("_bits"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    hashes = written(rows.groupBy("_bits").agg(F.sum("n_bytes").alias("_b"), F.count("*").alias("_n")))
    # Merged, not broadcast: the directory has a row for each document.
    placed = rows.join(directory(hashes, limit_bytes).hint("merge"), "_bits")
    return placed.select(
        "doc_id",
        F.when(F.col("_d") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("_p").cast("string"), 10, 2), F.col("_d").cast("int"), F.lit("0"))).alias("shard"),
        F.col("_d").cast("long").alias("depth"),
        "n_bytes",
        F.col("_b").alias("shard_bytes"),
        F.col("_n").alias("shard_docs"),
        (F.col("_b") > limit_bytes).alias("oversized"),
        *(F.col(f"_keep_{c}").alias(c) for c in keep if c != "doc_id"),
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Writes docs with a folder for each shard, `_shard=s...`; where docs have such a column, the folders' name has more underlines."""
    folder = "_shard"
    while folder in {c.lower() for c in docs.columns}:
        folder += "_"
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    placed = shard(packed, limit_bytes, keep=("_row",)).select("_row.*", F.concat(F.lit("s"), "shard").alias(folder))
    placed.repartition(folder).write.partitionBy(folder).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), QUERY_LIMIT_BYTES)


def oracle(limit_bytes: int = QUERY_LIMIT_BYTES) -> str:
    return rf"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || chr(31) || coalesce(text, '')), 1, 13))::BIGINT AS bits FROM documents
), s AS (
  SELECT doc_id, n_bytes, bits, d, bits >> (52 - d)::INT AS p FROM r, range(0, 53) AS x(d)
), b AS (
  SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM s GROUP BY d, p
), f AS (
  SELECT s.doc_id, s.n_bytes, s.bits, s.d, s.p, shard_bytes, shard_docs, row_number() OVER (PARTITION BY s.doc_id, s.bits ORDER BY s.d) AS i
  FROM s JOIN b USING (d, p) WHERE shard_bytes <= {limit_bytes} OR s.d = 52
)
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d::INT, '0') END AS shard, d::BIGINT AS depth, n_bytes, shard_bytes, shard_docs,
       shard_bytes > {limit_bytes} AS oversized FROM f WHERE i = 1
"""
