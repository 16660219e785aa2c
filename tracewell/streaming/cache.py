"""A result cache as keyed state: least recently used goes first, entries answer for a time only.

Each shard has a cache of its own of at most `size` entries, so the state and the work
are dealt out by shard. A get that finds an entry makes it the newest but leaves its age;
one that finds an entry past its time removes it. Only results that are `ok` are put in.
Timers remove what no get asks for any more once the watermark has passed its time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

ANSWERS = "shard string, seq long, key string, hit boolean, value string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ResultCache(StatefulProcessor):
    def __init__(self, size: int, seconds: float) -> None:
        self.size, self.age = size, int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: By key: when it was put in (microseconds), its place in the order of use, the result.
        self.entries = handle.getMapState("entries", "key string", "stored long, used long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Answers the gets of a shard, in order of time and number."""
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        before, shard = dict(held), key[0]
        use = max((v[1] for v in held.values()), default=0)
        out = []
        for at, seq, op, name, status, value in sorted(((r["at"], r["seq"], r["op"], r["key"], r["status"], r["value"]) for r in rows), key=lambda r: r[:2]):
            use += 1
            if op == "get":
                entry = held.get(name)
                if entry and at - entry[0] >= self.age:
                    held.pop(name)
                    entry = None
                if entry:
                    held[name] = (entry[0], use, entry[2])
                out.append(Row(shard=shard, seq=seq, key=name, hit=entry is not None, value=entry[2] if entry else None))
            elif op == "put" and status == "ok" and self.size:
                held[name] = (at, use, value)
                if len(held) > self.size:
                    held.pop(min(held, key=lambda k: held[k][1]))
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if before.get(name) != entry:
                self.entries.updateValue((name,), entry)
            if before.get(name, (None,))[0] != entry[0]:
                self.handle.registerTimer((entry[0] + self.age) // 1000 + 1)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing later than the timer can hit what is due; there is nothing to answer."""
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for name in [k[0] for k, v in self.entries.iterator() if v[0] + self.age <= due]:
            self.entries.removeKey((name,))
        yield from ()


def cached(requests: DataFrame, size: int, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Answers (shard, seq, key, hit, value) to the gets of a stream of (shard, seq, at, op, key, status, value).

    op is put or get; at is a timestamp and says what is fresh. Within a micro-batch
    requests are taken in the order of at and seq; those at or behind the watermark of earlier batches are left out.
    """
    if size < 0 or seconds <= 0:
        raise ValueError("a cache takes a size of 0 or more and an age above 0")
    ship(requests.sparkSession)
    timed = requests.select(F.col("shard").cast("string").alias("shard"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("ts"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "op", F.col("key").cast("string").alias("key"), "status", "value")
    return timed.withWatermark("ts", delay).groupBy("shard").transformWithState(ResultCache(size, seconds), ANSWERS, "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start in here keep their state where keyed maps and timers are had."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def answer_table(answers: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of `cached` over what is there now into a Parquet table; a later run goes on with the caches of the checkpoint."""
    with rocks(answers.sparkSession):
        answers.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
