"""Arrow plumbing for the operators that run Python: batches of bounded size in, typed rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..shipping import ship

#: Rows in a batch that Spark hands to Python; texts may be long, so it is small.
BATCH_ROWS = 256


def bounded(df: DataFrame) -> None:
    """Keeps Arrow batches small for all plans that are made next in this session: the setting is read when a plan runs, so it stays."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str, flush: int = 4096, flush_bytes: int = 16 * 2**20) -> DataFrame:
    """df.mapInArrow with a generator of column dictionaries or of rows.

    f yields either dicts of equally long columns (lists or arrays) or tuples in
    the order of schema; tuples are gathered to batches of at most `flush` rows or
    about `flush_bytes` of bytes values.
    """
    bounded(df)
    ship(df.sparkSession)
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

        for x in f(batches):
            if isinstance(x, dict):
                yield pa.RecordBatch.from_arrays([pa.array(x[t.name], type=t.type) for t in arrow], schema=arrow)
                continue
            rows.append(x)
            held += sum(len(v) for v in x if isinstance(v, bytes))
            if len(rows) >= flush or held >= flush_bytes:
                yield made()
                rows, held = [], 0
        if rows:
            yield made()

    return df.mapInArrow(run, struct)
