"""Content addressing: digests of file trees, cache keys and a memo table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of an entry's digest in a lane, and lanes.
_LANE, _LANES = 15, 4


def tree_digest(entries: DataFrame, *keys: str) -> DataFrame:
    """(keys, digest) of entries (keys, path, kind, content, link_target).

    Names, kinds, link targets and contents count, times don't. A tree's digest is that of
    the sums of its entries' digests, so it needs no order and no array of them: partial
    sums suffice, however many files a tree has.
    """
    what = F.when(F.col("kind") == "link", F.col("link_target").cast("binary")).when(F.col("kind") == "file", F.col("content"))
    entry = F.sha2(F.concat_ws("\x1f", "path", "kind", F.coalesce(F.sha2(what, 256), F.lit("-"))), 256)
    lane = lambda i: F.sum(F.conv(F.substring("_e", 1 + i * _LANE, _LANE), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    sums = entries.withColumn("_e", entry).groupBy(*keys).agg(F.count("*").cast("string").alias("_n"), *(lane(i).alias(f"_l{i}") for i in range(_LANES)))
    return sums.select(*keys, F.sha2(F.concat_ws("|", "_n", *(f"_l{i}" for i in range(_LANES))), 256).alias("digest"))


def cache_key(*parts: Column) -> Column:
    """A digest of everything that a result depends on."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def fresh(memo: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Entries (key, stored_at, status, ...) of a memo table that may answer: stored as ok and young enough; the latest of each key (ties: the largest in its other columns)."""
    young = memo.where((F.col("status") == "ok") & (F.col("stored_at") + F.expr(f"INTERVAL {int(seconds)} SECONDS") > now))
    rest = [c for c in memo.columns if c not in ("key", "stored_at")]
    return young.groupBy("key").agg(F.max(F.struct("stored_at", *rest)).alias("_e")).select("key", *[F.col(f"_e.{c}").alias(c) for c in memo.columns if c != "key"])


def stored(memo: DataFrame, answers: DataFrame, size: int) -> DataFrame:
    """A memo table (key, stored_at, used_at, status, ...) with answers put in: only those that are ok, in place of the key's old one; the `size` entries used last stay."""
    new = answers.where("status = 'ok'")
    both = memo.join(new, "key", "left_anti").unionByName(new)
    return both.orderBy(F.col("used_at").desc(), "key").limit(size)


def used(memo: DataFrame, keys: DataFrame, now: Column, seconds: int) -> DataFrame:
    """memo after looking keys up: their entries count as used now, but are as old as before; those that are too old to answer are dropped."""
    hit = keys.select("key").distinct().withColumn("_hit", F.lit(True))
    rows = memo.join(hit, "key", "left")
    rows = rows.where(F.col("_hit").isNull() | (F.col("stored_at") + F.expr(f"INTERVAL {int(seconds)} SECONDS") > now))
    return rows.withColumn("used_at", F.when(F.col("_hit"), now).otherwise(F.col("used_at"))).select(*memo.columns)
