"""Mixing sources to target weights.

Targets: each source's share of `share` times all sizes, by weight, stopped at
`limit` times its own size, the excess shared again by weight until none is
above. Within a source, whole epochs come first; the rest is an
Efraimidis-Spirakis sample: an exponential key by document, scaled by its quality
weight, in key order until the budget is met. The prefix sum of sizes is taken in
two steps, over bins of the key (even steps of its logarithm, so that none holds more
than about a hundredth of a source, whatever the weights) and then within the one bin
that the budget cuts. So no task gets a whole source, and only that bin's documents
are dealt out.

Defined results: null text has size 0; a null source is a source, last in order;
null ids and repeated rows are documents of their own, and equal rows are
interchangeable; an empty table gives an empty result; documents of size 0 take 0; a very
long text is a document like any other; other columns are carried if `keep` names them,
whatever their names, and else not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Bins to each doubling of the key.
BINS = 128
#: Sources (a row of about 80 bytes each) that are broadcast at most; beyond, the same join shuffles.
BROADCAST_SOURCES = 500_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that aren't digits or symbols."""
    plain = F.length(F.translate(text, "0123456789#*$%&|<>{}[]@=_~^\\", ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(plain.cast("double"), F.length(text).cast("double")), F.lit(1.0)))


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from 52 bits of a digest: the same on every run."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Adds `target` to (source, source_size).

    Filled like water: sources stop in ascending order of cap over weight; those
    below the level are full, the others share what is left by weight. The table
    has a row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", F.get(pattern, F.col("_i") % len(weights)))
    ranked = ranked.withColumns({"_cap": F.col("source_size") * F.lit(float(limit))}).withColumn("_full_at", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_full_at", "_i").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    filled = ranked.withColumns(
        {
            "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_passed": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
            "_all": F.sum("source_size").over(all_rows) * F.lit(float(share)),
            "_weights": F.sum("_w").over(all_rows),
        }
    )
    level = filled.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_passed")))
    # The level at the first source that it doesn't fill; further on the formula no longer means a level.
    reached = F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_i", "_level"))
    level = level.withColumn("_stop", F.min(reached).over(all_rows)["_level"])
    return level.select("source", "source_size", F.when(F.col("_stop").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_stop"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken and n_copies; `keep` names more columns of docs to carry."""
    text = text_of()
    base = docs.select(
        F.col("doc_id"),
        F.col("source"),
        size_of(text).alias("size"),
        (-F.log(uniform(seed, F.col("doc_id"), F.md5(text))) / quality_weight(text)).alias("_key"),
        *(F.col(c).alias(f"_keep_{c}") for c in keep),
    )
    base = base.withColumn("_bin", F.floor(F.log2(F.greatest(F.col("_key"), F.lit(1e-300))) * BINS).cast("int"))
    if not keep:
        base = written(base)  # without texts to carry it is small, and they are read once
    by_bin = written(base.groupBy("source", "_bin").agg(F.sum("size").alias("_bin_size")))
    sizes = by_bin.groupBy("source").agg(F.sum("_bin_size").alias("source_size"))
    plan = targets(sizes, weights, share, limit)
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size"))).withColumnRenamed("source", "_s")
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bin.withColumn("_before", F.coalesce(F.sum("_bin_size").over(upto), F.lit(0)))
    # The bin that the rest cuts: a row for each source.
    cut = before.join(plan, before["source"].eqNullSafe(plan["_s"])).groupBy("_s").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_epochs").alias("_epochs"), F.first("_rest").alias("_rest"),
        F.min_by(F.struct("_bin", "_before"), F.when(F.col("_before") + F.col("_bin_size") > F.col("_rest"), F.col("_bin"))).alias("_cut"),
    )
    cut = written(cut)
    small = cut.count() <= BROADCAST_SOURCES
    placed = base.join(F.broadcast(cut) if small else cut, base["source"].eqNullSafe(cut["_s"]))
    # Only the documents of cut bins need an order; all others stay where they were read.
    inside = F.col("_bin") == F.col("_cut._bin")
    whole = F.when(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut._bin")), F.lit(1)).otherwise(F.lit(0))
    sure = placed.where(F.coalesce(~inside, F.lit(True))).withColumn("_extra", whole)
    within = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col("_cut._before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2.0 <= F.col("_rest")
    both = sure.unionByName(placed.where(inside).withColumn("_extra", fits.cast("int")))
    return both.withColumn("n_copies", (F.col("_epochs") + F.col("_extra")).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies", *(F.col(f"_keep_{c}").alias(c) for c in keep if c not in ("doc_id", "source"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns only."""
    packed = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    taken = mix(packed, keep=("_row",), **options).where("n_copies > 0")
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('7' || chr(31) || coalesce(doc_id::VARCHAR, '-') || chr(31) || md5(t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.1, coalesce(length(regexp_replace(t, '[0-9#*$%&|<>{}\[\]@=_~^\\]', '', 'g'))::DOUBLE / nullif(length(t), 0), 1.0)) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2.0 AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s
), f AS (
  SELECT *, cap / w AS full_at, coalesce(sum(cap) OVER o, 0)::DOUBLE AS capped, coalesce(sum(w) OVER o, 0)::DOUBLE AS passed,
         sum(source_size) OVER () * 1.5 AS every, sum(w) OVER () AS weights
  FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT f.*, (SELECT (every - capped) / (weights - passed) FROM f WHERE (every - capped) / (weights - passed) <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1) AS stop FROM f
), p AS (
  SELECT source, source_size, CASE WHEN stop IS NULL THEN cap ELSE least(cap, w * stop) END::DOUBLE AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END::BIGINT AS epochs FROM p
), c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, greatest(0.0, e.target - e.epochs * e.source_size) AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
