"""A file tree as a data source: `spark.read.format("code_tree").load(folder)`.

Hidden files, empty folders and symbolic links are rows too; links are not followed,
`inside` says whether one ends in the tree. The driver lists names and sizes, as Spark's
own file sources do; partitions are files of `partition_bytes` together, whatever their
folders. Filters on path, kind, size and link target are pushed down: a folder that no
wanted path lies in isn't listed, a file that isn't wanted isn't read. A schema of some
columns only (`.schema("path string, size long")`) reads no contents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "path string, kind string, size long, content binary, link_target string, inside boolean"
PARTITION_BYTES = 64 * 2**20
#: What listing a file costs, in bytes.
OPEN_BYTES = 64 * 2**10
_KNOWN = ("path", "kind", "size", "link_target")


class CodeTree(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return TreeReader(self.options["path"], schema.names, int(self.options.get("partition_bytes", PARTITION_BYTES)))


class TreePart(ds.InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _holds(f: ds.Filter, row: dict) -> bool:
    """Whether a filter is true of a row's known columns; null is never so."""
    if isinstance(f, ds.Not):
        return row[f.child.attribute[0]] is not None and not _holds(f.child, row)
    v = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return v is None
    if isinstance(f, ds.EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    tests = {
        ds.IsNotNull: lambda: True, ds.EqualTo: lambda: v == f.value, ds.In: lambda: v in f.value, ds.GreaterThan: lambda: v > f.value, ds.GreaterThanOrEqual: lambda: v >= f.value,
        ds.LessThan: lambda: v < f.value, ds.LessThanOrEqual: lambda: v <= f.value, ds.StringStartsWith: lambda: v.startswith(f.value), ds.StringEndsWith: lambda: v.endswith(f.value), ds.StringContains: lambda: f.value in v,
    }
    return tests[type(f)]()


def _can_push(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return isinstance(f.child, (ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)) and _can_push(f.child)
    kinds = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
    return isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in _KNOWN


class TreeReader(ds.DataSourceReader):
    def __init__(self, root: str, names: list[str], partition_bytes: int) -> None:
        self.root = os.path.realpath(root.removeprefix("file://"))
        self.names, self.partition_bytes, self.filters = names, partition_bytes, []

    def pushFilters(self, filters):
        """Takes the filters that are decided by name, kind, size and link target; the others are Spark's."""
        for f in filters:
            if _can_push(f):
                self.filters.append(f)
            else:
                yield f

    def _row(self, path: str) -> dict | None:
        """What is known of an entry without reading it; None for what is neither file, folder nor link."""
        full = os.path.join(self.root, path)
        if os.path.islink(full):
            return {"path": path, "kind": "link", "size": 0, "link_target": os.readlink(full)}
        if os.path.isdir(full):
            return {"path": path, "kind": "dir", "size": 0, "link_target": None}
        return {"path": path, "kind": "file", "size": os.path.getsize(full), "link_target": None} if os.path.isfile(full) else None

    def _enters(self, folder: str) -> bool:
        """Whether a path in a folder may be wanted."""
        inner = folder + "/"
        for f in self.filters:
            wanted = [f.value] if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)) else f.value if isinstance(f, ds.In) else None
            if getattr(f, "attribute", None) != ("path",):
                continue
            if wanted is not None and not any(isinstance(w, str) and w.startswith(inner) for w in wanted):
                return False
            if isinstance(f, ds.StringStartsWith) and not (inner.startswith(f.value) or f.value.startswith(inner)):
                return False
        return True

    def entries(self) -> Iterator[dict]:
        """Wanted entries in the order of a walk."""
        pending = [""]
        while pending:
            folder = pending.pop()
            below = []
            for name in sorted(os.listdir(os.path.join(self.root, folder))):
                path = f"{folder}/{name}" if folder else name
                row = self._row(path)
                if row is None:
                    continue
                if all(_holds(f, row) for f in self.filters):
                    yield row
                if row["kind"] == "dir" and self._enters(path):
                    below.append(path)
            pending += reversed(below)

    def partitions(self) -> list[ds.InputPartition]:
        parts, paths, held = [], [], 0
        weigh = "content" in self.names
        for row in self.entries():
            cost = OPEN_BYTES + row["size"] * weigh
            if paths and held + cost > self.partition_bytes:
                parts.append(TreePart(paths))
                paths, held = [], 0
            paths.append(row["path"])
            held += cost
        return [*parts, TreePart(paths)]

    def read(self, partition: TreePart) -> Iterator[tuple]:
        for path in partition.paths:
            row = self._row(path)
            if row is None:
                continue
            full = os.path.join(self.root, path)
            if "inside" in self.names:
                real = os.path.realpath(full) if row["kind"] == "link" else None
                row["inside"] = real is None or real == self.root or real.startswith(self.root + os.sep)
            if "content" in self.names:
                row["content"] = None
                if row["kind"] == "file":
                    with open(full, "rb") as f:
                        row["content"] = f.read()
                    row["size"] = len(row["content"])
            yield tuple(row[n] for n in self.names)


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CodeTree)
