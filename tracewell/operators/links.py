"""Symbolic links of a tree, followed link by link until nothing changes.

A path is taken part by part, as an operating system does: `..` leaves the directory that
the links so far have led to, there or not. A link whose way leaves the root, at any step,
escapes; one that comes back to where it was, or takes more than MOST_HOPS links, goes in a
circle. Rounds follow the longest way that is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.loaders import shared_folder

# Fixed value: links that a path may take.
MOST_HOPS = 40


def _kept(df: DataFrame) -> DataFrame:
    """df as a table: each round starts from what the last one wrote."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolved(entries: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, status, target, hops) of the links among entries (keys, path, kind, link_target).

    kind is file, dir or link. status: `file` or `dir` (target is then the path it leads
    to, "" for the root), `missing` (target is where nothing is), `escape` or `cycle` (hops is null).
    Directories need no entry of their own if something lies in them.
    """
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    links = entries.where("kind = 'link'").select(*keys, "path", "link_target")
    # The link's directory may be reached by links itself, so its own path is followed, too.
    state = _kept(links.select(*keys, "path", none.alias("at"), parts(F.col("path")).alias("rest"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("status"), none.alias("been")))
    targets = links.select(*keys, F.col("path").alias("_link"), "link_target")
    done = None
    while True:
        # Steps: where each further part leads, as long as no link is met; a null step is one above the root.
        step = F.expr(
            "aggregate(rest, named_struct('at', at, 'seen', cast(array() AS array<array<string>>), 'out', false), "
            "(s, p) -> CASE WHEN s.out OR (p = '..' AND size(s.at) = 0) THEN named_struct('at', s.at, 'seen', s.seen, 'out', true) "
            "ELSE named_struct('at', IF(p = '..', slice(s.at, 1, greatest(size(s.at) - 1, 0)), concat(s.at, array(p))), "
            "'seen', concat(s.seen, array(IF(p = '..', slice(s.at, 1, greatest(size(s.at) - 1, 0)), concat(s.at, array(p))))), 'out', false) END)"
        )
        steps = state.withColumn("_s", step)
        met = steps.select(*keys, "path", F.posexplode("_s.seen").alias("n", "_at")).select(*keys, "path", "n", F.array_join("_at", "/").alias("_link")).join(targets, [*keys, "_link"])
        first = met.groupBy(*keys, "path").agg(F.min(F.struct("n", "link_target")).alias("_m"))
        told = steps.join(first, [*keys, "path"], "left")
        here = F.concat_ws("/", F.array_join("at", "/"), F.lit(""), F.array_join("rest", "/"))
        absolute = F.col("_m.link_target").startswith("/")
        # A link met is left by the directory that has it.
        before = F.expr("slice(_s.seen[_m.n], 1, greatest(size(_s.seen[_m.n]) - 1, 0))")
        rest = F.concat(parts(F.col("_m.link_target")), F.expr("slice(rest, _m.n + 2, size(rest))"))
        status = (
            F.when(F.col("_m").isNull(), F.when(F.col("_s.out"), "escape").otherwise("found"))
            .when(absolute, "escape").when((F.col("hops") >= MOST_HOPS) | F.array_contains("been", here), "cycle")
        )
        after = told.select(
            *keys, "path", F.when(F.col("_m").isNull(), F.col("_s.at")).otherwise(before).alias("at"), F.when(F.col("_m").isNull(), none).otherwise(rest).alias("rest"),
            F.when(F.col("_m").isNull(), F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"), status.alias("status"), F.concat("been", F.array(here)).alias("been"),
        )
        after = _kept(after)
        ended = after.where("status IS NOT NULL")
        done = ended if done is None else done.unionByName(ended)
        state = after.where("status IS NULL")
        if state.isEmpty():
            break
    ways = done.select(*keys, "path", "hops", "status", F.array_join("at", "/").alias("target"))
    real = entries.where("kind <> 'link'").select(*keys, F.col("path").alias("target"), "kind")
    above = entries.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("target"), F.lit("dir").alias("kind"))
    known = real.unionByName(above).groupBy(*keys, "target").agg(F.min("kind").alias("kind"))
    out = ways.join(known, [*keys, "target"], "left")
    found = F.col("status") == "found"
    return out.select(*keys, "path", F.when(found, F.coalesce("kind", F.lit("missing"))).otherwise(F.col("status")).alias("status"), F.when(found, F.col("target")).alias("target"), F.when(F.col("status") != "cycle", F.col("hops")).alias("hops"))
