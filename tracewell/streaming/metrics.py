"""Tool metrics of trajectories that are still running."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(events: DataFrame) -> DataFrame:
    """Calls, searches, reads, turns and errors of each trajectory so far, in update mode: sums only, so state is one row a trajectory."""
    kind = F.col("kind")
    action = kind == "ActionEvent"
    count = lambda c: F.count_if(c).alias
    return events.groupBy("traj").agg(
        count(action)("num_tool_calls"),
        count(action & F.col("tool_name").isin("glob", "grep"))("search_calls"),
        count(action & (F.col("tool_name") == "read_file"))("read_calls"),
        count((kind == "ObservationEvent") & F.coalesce("is_error", F.lit(False)))("tool_errors"),
        count(kind == "TokenEvent")("num_turns"),
    )


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by kind in tumbling windows of event time; what comes later than the delay is left out. ts may lack a time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def table_query(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream with a watermark over what is there now into a Parquet table, from which nothing passes the driver; a later run goes on from the checkpoint.

    Windows are written once they are closed, so the last ones stay open until later events come.
    """
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_query(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there now and keeps the state of all its groups as a Parquet table, written anew by each micro-batch."""

    def write(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def memory_query(stream: DataFrame, name: str, mode: str = "update"):
    """Runs a stream over what is there now into an in-memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
