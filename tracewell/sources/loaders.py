"""Tasks, trajectories and outcomes from Parquet, JSON and JSON lines; guarded writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import stripped

OUTPUTS = ("all.parquet", "train.parquet", "validation.parquet", "cleaning_report.json")
RAW_COLUMNS = ("instance_id", "repo", "patch", "problem_statement")


def shards(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW_COLUMNS, limit: int | None = None) -> DataFrame:
    """The columns of a Parquet file or of the `*.parquet` files right in a folder, with `ord`: file name, then row.

    `ord` is what "first" means further on. With a limit, the first rows in that order.
    """
    rows = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(path)
    rows = rows.select(*columns, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("ord"))
    if "base_commit" in columns:  # an all-null column is read as a number
        rows = rows.withColumn("base_commit", F.col("base_commit").cast("string"))
    return rows.orderBy("ord").limit(limit) if limit is not None else rows


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ord, v) with v a VARIANT, of `*.json` in a folder, a `.jsonl` file, or a JSON file with a list or one object.

    VARIANT keeps a null field apart from one that isn't there, and `1` apart from `"1"`.
    """
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
        return lines.where(stripped(F.col("value")) != "").select("ord", F.parse_json("value").alias("v"))
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.expr("try_cast(v AS array<variant>)")).otherwise(F.array("v"))
    return whole.select("file", F.posexplode(listed).alias("i", "v")).select(F.struct("file", "i").alias("ord"), "v")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows as they are; JSON as (ord, v)."""
    return spark.read.parquet(path) if path.endswith(".parquet") else json_rows(spark, path)


def decoded(rows: DataFrame, payload: str = "content") -> DataFrame:
    """Adds text and error to rows with Python source as bytes: decoded by its byte order mark or coding line."""
    from ..operators.symbols import decoded as decode
    from ..shipping import ship

    ship(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, errors = [], []
            for b in p[payload]:
                try:
                    texts.append(decode(bytes(b)))
                    errors.append(None)
                except (SyntaxError, UnicodeDecodeError, LookupError, TypeError) as e:
                    texts.append(None)
                    errors.append(f"source_fetch_error: {type(e).__name__}")
            yield p.assign(text=texts, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, text string, error string")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, resolved, source): rows, or one report with lists of resolved and unresolved ids. `resolved` must be a JSON boolean."""
    rows = json_rows(spark, path)
    told = rows.select(F.expr("try_variant_get(v, '$.resolved_ids', 'array<string>')").alias("yes"), F.expr("try_variant_get(v, '$.unresolved_ids', 'array<string>')").alias("no"), "v")
    listed = told.where("yes IS NOT NULL")
    parts = [listed.select(F.explode(c).alias("instance_id"), F.lit(flag).alias("resolved"), F.lit("swe-bench").alias("source")) for c, flag in (("yes", True), ("no", False))]
    flag = F.expr("variant_get(v, '$.resolved', 'variant')")
    strict = F.when(F.schema_of_variant(flag) == "BOOLEAN", F.expr("try_variant_get(v, '$.resolved', 'boolean')")).otherwise(F.raise_error(F.lit("resolved must be a boolean")).cast("boolean"))
    single = told.where("yes IS NULL").select(F.expr("try_variant_get(v, '$.instance_id', 'string')").alias("instance_id"), strict.alias("resolved"), F.expr("try_variant_get(v, '$.source', 'string')").alias("source"))
    return parts[0].unionByName(parts[1]).unionByName(single)


def sources_of(raw_keys: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, path, text, error) of distinct (repo, path): a table of contents stands in for a network fetch."""
    found = raw_keys.select("repo", "path").distinct().join(contents, ["repo", "path"], "left")
    return found.withColumn("error", F.when(F.col("text").isNull(), "source_fetch_error"))


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that driver and executors share, and that goes when the driver ends: under spark.checkpoint.dir, or a local one where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{(root or 'file:///tmp/tracewell-checkpoints').rstrip('/')}/tracewell-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path)
    fs.deleteOnExit(path)  # with all that is in it then
    return f"{folder}/table"


def guard(spark: SparkSession, folder: str, overwrite: bool = False) -> None:
    """Refuses a folder that has any of the named outputs; with overwrite, removes those."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [o for o in OUTPUTS if fs.exists(jvm.org.apache.hadoop.fs.Path(folder, o))]
    if there and not overwrite:
        raise FileExistsError(f"{folder} has {', '.join(there)}")
    for o in there:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, o), True)


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def write_dataset(rows: DataFrame, folder: str, split: str = "split", overwrite: bool = False) -> None:
    """Train and validation Parquet, zstd; both are written even if empty."""
    guard(rows.sparkSession, folder, overwrite)
    for name in ("train", "validation"):
        rows.where(F.col(split) == name).drop(split).write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
