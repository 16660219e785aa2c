"""Benchmark decontamination.

A set of normalised windows of the benchmark is broadcast (its size is checked;
beyond the bound the same join shuffles). Each window is filed under its longest
pair of neighbouring words; each pair of neighbouring words of a document is
looked up, and a hit is verified against the whole window. Words of a document
never leave the scan unless they hit.

Defined results: a null text or item has no words; an item without words is
nothing; a null item id counts as the empty string; equal rows get equal results;
an empty benchmark leaves all documents alone; an empty table gives an empty
result; extra columns are not read, whatever their names; a very long text is looked up in
chunks and takes as much a word as a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_of

WINDOW = 13
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a text that are looked up together.
CHUNK = 1024
BROADCAST_BYTES = 64 * 2**20


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def row_key(text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\x1f"), text))


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, length, offset, anchor, items): each distinct window with its items and the pair it is filed under."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens_of(text_of()).alias("w")).where("size(w) > 0")
    cut = items.select("item", "w", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {width - 1}))")).alias("i")).select("item", F.expr(f"slice(w, i, {width})").alias("w"))
    each = cut.groupBy("w").agg(F.collect_set("item").alias("items"))
    pairs = "transform(sequence(0, size(w) - 2), i -> named_struct('n', length(w[i]) + length(w[i + 1]), 'i', -i))"
    offset = F.expr(f"CASE WHEN size(w) = 1 THEN 0 ELSE -array_max({pairs}).i END")
    each = each.select(F.array_join("w", " ").alias("window"), F.size("w").alias("length"), offset.alias("offset"), "w", "items")
    return each.select("window", "length", "offset", F.expr("CASE WHEN length = 1 THEN xxhash64(w[0]) ELSE xxhash64(w[offset], w[offset + 1]) END").alias("anchor"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, start, length, items) of each window that occurs in a document; start counts its words from 0."""
    table_ = windows(benchmark, width)
    seen = table_.agg(F.sum(F.octet_length("window") + F.expr("aggregate(items, 0L, (n, x) -> n + octet_length(x) + 16)") + 64).alias("bytes"), F.min("length").alias("shortest")).first()
    small = (seen["bytes"] or 0) <= broadcast_bytes
    text = text_of()
    words = docs.select(row_key(text).alias("key"), tokens_of(text).alias("w"))
    # Chunks of a text, with what windows at their edges need: no row carries a whole text, however long.
    edge = width - 1
    cut = words.select("key", F.expr(f"transform(sequence(0, greatest(size(w) - 1, 0) div {CHUNK}), c -> named_struct('c', c, 'w', slice(w, greatest(c * {CHUNK} - {edge}, 0) + 1, {CHUNK + 2 * edge + 1})))").alias("cs"))
    # The outer form: the plain one makes Spark infer a filter that cuts every text into words once more.
    cut = cut.select("key", F.explode_outer("cs").alias("x")).select("key", F.col("x.c").alias("c"), F.col("x.w").alias("w"), F.greatest(F.col("x.c") * CHUNK - edge, F.lit(0)).alias("base"))
    each = cut.select("key", "c", "w", "base", F.posexplode_outer("w").alias("i", "t")).withColumn("p", F.col("base") + F.col("i")).where((F.col("p") >= F.col("c") * CHUNK) & (F.col("p") < (F.col("c") + 1) * CHUNK))
    pair = F.xxhash64("t", F.get("w", F.col("i") + 1))
    if seen["shortest"] == 1:
        each = each.select("key", "w", "base", "p", F.explode(F.array_distinct(F.array(pair, F.xxhash64("t")))).alias("h"))
    else:
        each = each.select("key", "w", "base", "p", pair.alias("h"))
    start = F.col("p") - F.col("offset")
    if small:
        found = each.join(F.broadcast(table_), F.col("h") == F.col("anchor"))
        there = F.expr("slice(w, greatest(p - offset, 0) - base + 1, length)")
    else:
        # Rows travel here, so each takes only the words that a window around it can have.
        each = each.select("key", "p", "h", F.expr(f"slice(w, greatest(p - {edge}, 0) - base + 1, {2 * width})").alias("w"))
        found = each.join(table_.hint("merge"), F.col("h") == F.col("anchor"))
        there = F.expr(f"slice(w, greatest(p - offset, 0) - greatest(p - {edge}, 0) + 1, length)")
    found = found.where((start >= 0) & (F.array_join(there, " ") == F.col("window")))
    return found.select("key", start.alias("start"), "length", "items")


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    spans: (start, length) in words, merged by nothing. contaminated: any hit, on at least `share` of the words.
    """
    text = text_of()
    found = hits(docs, benchmark, width).groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.withColumn("n_hit", F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.length - 1)))))").cast("long"))
    rows = docs.select("doc_id", row_key(text).alias("key"), F.regexp_count(text, F.lit(RAW_TOKEN)).cast("long").alias("n_words"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    out = rows.join(found, "key", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.coalesce(F.col("spans"), F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        ((n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words") if share != 0.05 else (n_hit > 0) & (20 * n_hit >= F.col("n_words")))).alias("contaminated"),
        *(F.col(f"_keep_{c}").alias(c) for c in keep if c != "doc_id"),
    )


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def without_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns only."""
    return judge(_packed(docs), benchmark, keep=("_row",), **options).where(~F.col("contaminated")).select("_row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without the words that were hit, each with what separates it from the word before."""
    cleaned = judge(_packed(docs), benchmark, keep=("_row",), **options)
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(rf"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*{RAW_TOKEN}"), F.lit(0))
    tail = F.regexp_extract(F.col("_row.text"), r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    cleaned = cleaned.withColumns({"_p": pieces, "_tail": tail})
    left = F.expr("filter(_p, (x, i) -> NOT exists(spans, s -> i >= s.start AND i < s.start + s.length))")
    text = F.when(F.size("spans") == 0, F.col("_row.text")).otherwise(F.concat(F.array_join(left, ""), F.col("_tail")))
    return cleaned.withColumn("_row", F.col("_row").withField("text", text)).select("_row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def oracle() -> str:
    return r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) s)
), h AS (
  SELECT p.r, p.i, p.n, win.item FROM p JOIN win USING (n, win)
), hit AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
