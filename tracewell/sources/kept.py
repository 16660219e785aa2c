"""Writers that leave whole files or nothing: Parquet with row groups of a set number of rows, and a trace file a run.

`df.write.format("kept_files").option("kind", "parquet" | "traces").save(folder)`.
Tasks write to a folder of their own below `_pending`; the commit moves what succeeded
tasks report, one move a task, and then removes `_pending` with what failed or doubled
tasks left. An abort removes it alone. Folders are addressed as pyarrow addresses file
systems, so they can be on any store that tasks and driver share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema

ROW_GROUP = 1000


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str
    task: int
    rows: int


class KeptFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "kept_files"

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        kind = self.options.get("kind", "parquet")
        if kind not in ("parquet", "traces"):
            raise ValueError("kind must be parquet or traces")
        return KeptWriter(self.options["path"], kind, schema, overwrite, int(self.options.get("row_group", ROW_GROUP)), self.options.get("run", "run"))


class KeptWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, schema, overwrite: bool, row_group: int, run: str) -> None:
        if row_group < 1:
            raise ValueError("row_group must be 1 or more")
        if kind == "traces" and run not in schema.names:
            raise ValueError(f"there is no column {run}")
        self.path, self.kind, self.schema, self.row_group, self.run = path, kind, to_arrow_schema(schema), row_group, run
        self.job = uuid.uuid4().hex
        store, root = self._store()
        there = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not f.base_name.startswith("_pending")]
        if there and not overwrite:
            raise FileExistsError(f"{path} is not empty")
        self.replaces = [f.path for f in there]

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        context = TaskContext.get()
        folder = f"{root}/_pending-{self.job}/{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}"
        store.create_dir(folder)
        rows = (self._parquet if self.kind == "parquet" else self._traces)(store, folder, iterator)
        return Written(folder, context.partitionId(), rows)

    def _parquet(self, store, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
        """One file, row groups of row_group rows but for the last."""
        n, held, rows = 0, [], 0
        with pq.ParquetWriter(f"{folder}/rows.parquet", self.schema, filesystem=store, compression="zstd") as out:
            for b in batches:
                b = pa.Table.from_batches([b]).cast(self.schema)
                while len(b):
                    take = b.slice(0, self.row_group - n)
                    held.append(take)
                    n += len(take)
                    rows += len(take)
                    b = b.slice(len(take))
                    if n == self.row_group:
                        out.write_table(pa.concat_tables(held), row_group_size=self.row_group)
                        n, held = 0, []
            if held:
                out.write_table(pa.concat_tables(held), row_group_size=self.row_group)
        return rows

    def _traces(self, store, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
        """A file of JSON lines for each run of rows of one run; a run's name is its file's, with odd characters written out."""
        now, out, rows = None, None, 0
        try:
            for b in batches:
                for row in b.to_pylist():
                    name = "".join(c if c.isascii() and (c.isalnum() or c in "_.-") else f"%{ord(c):x}%" for c in str(row[self.run]))
                    if out is None or name != now:
                        if out:
                            out.close()
                        now, out = name, store.open_output_stream(f"{folder}/run-{name}.jsonl")
                    out.write((json.dumps(row, ensure_ascii=False, default=str) + "\n").encode())
                    rows += 1
        finally:
            if out:
                out.close()
        return rows

    def commit(self, messages) -> None:
        store, root = self._store()
        for old in self.replaces:
            info = store.get_file_info(old)
            (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(old)
        for m in messages:
            if m is not None and m.rows:
                store.move(m.folder, f"{root}/part-{m.task:05d}")
        self.abort(messages)

    def abort(self, messages) -> None:
        store, root = self._store()
        pending = f"{root}/_pending-{self.job}"
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(KeptFiles)


def write_rows(rows: DataFrame, path: str, row_group: int = ROW_GROUP, overwrite: bool = False) -> None:
    """Parquet parts with row groups of row_group rows."""
    register(rows.sparkSession)
    rows.write.format("kept_files").option("kind", "parquet").option("row_group", row_group).mode("overwrite" if overwrite else "append").save(path)


def write_traces(rows: DataFrame, path: str, run: str, order: str, overwrite: bool = False) -> None:
    """A file of JSON lines for each run, in order: a run lies in one partition, its rows are sorted there and written as they come."""
    register(rows.sparkSession)
    rows.repartition(run).sortWithinPartitions(run, order).write.format("kept_files").option("kind", "traces").option("run", run).mode("overwrite" if overwrite else "append").save(path)
