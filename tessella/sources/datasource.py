"""The data source "tiff" for spark.read.format and spark.readStream.format.

Options: table is files, dirs (default), tags, chunks or rows; late_seconds is how late a stream's file may come; columns that a query doesn't ask for are still parsed. Its files are listed and read
through pyarrow, a partition for each `files_per_task` files. Of a file only what a table needs is read, in ranges: the directories, or one chunk after another. So
a file may be larger than Spark's binary values and than memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..shipping import ship_package
from . import tiff
from .ranged import RangedFile

TABLES = {"files": tiff.FILES, "dirs": tiff.DIRS, "tags": tiff.TAGS, "chunks": tiff.CHUNKS, "rows": tiff.ROWS}
#: Seconds that a file may come late: one whose time of change is older than the newest file's by more isn't looked for any more.
LATE_SECONDS = 7 * 86400


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def timed_files(path: str) -> list[tuple[int, str]]:
    """The time of change (nanoseconds, 0 if unknown) and the name of each file."""
    from pyarrow import fs

    system, base = _system(path)
    one = system.get_file_info(base)
    if one.type == fs.FileType.File:
        return [(one.mtime_ns or 0, base)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((x.mtime_ns or 0, x.path) for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith((".tif", ".tiff")))


def list_files(path: str) -> list[str]:
    return sorted(name for _, name in timed_files(path))


def rows_of(path: str, data: bytes, table: str) -> Iterator[dict]:
    f = tiff.P.parse(data, tiff.extra_names(), table == "files")
    if table == "files":
        yield tiff._file_row(path, data, f)
        return
    if table == "rows":
        for d, _, c, a, error in tiff.Scan(tiff.Options(user=tiff.codecs.registered())).arrays(data, f):
            for k in range(len(a) if a is not None else 1):
                yield {"path": path, "ifd": d.ifd, "y0": c.y, "row": c.y + k if a is not None else None, "x0": c.x, "samples": a[k].astype(float).tolist() if a is not None else None, "error": error}
        return
    for d in f.directories:
        if table == "dirs":
            yield tiff._dir_row(path, d, f, len(data))
        elif table == "tags":
            yield from tiff._tag_rows(path, d)
        elif d.kind in ("main", "sub") and (g := tiff.P.geometry(d)):
            for c in tiff.P.chunks(d, g, len(data)):
                yield {"path": path, "ifd": d.ifd, "chunk": c.number, "plane": c.plane, "x0": c.x, "y0": c.y, "z0": c.z, "w": c.w, "h": c.h, "offset": c.offset, "bytecount": c.size}


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


def _read(schema: StructType, path: str, table: str, names: list[str]) -> Iterator[tuple]:
    system, _ = _system(path)
    for name in names:
        with system.open_input_file(name) as file:
            for row in rows_of(name, RangedFile(file, file.size()), table):
                yield tuple(_plain(row.get(f.name), f.dataType) for f in schema.fields)


def _plain(value, kind):
    """Structs inside arrays as tuples."""
    if isinstance(value, list) and value and isinstance(value[0], dict):
        return [tuple(v.values()) for v in value]
    return value


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options.get("table", "dirs")
        self.step = int(options.get("files_per_task", options.get("filespertask", 64)))

    def partitions(self) -> list[InputPartition]:
        names = list_files(self.path)
        return [_Files(names[i : i + self.step]) for i in range(0, len(names), self.step)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _read(self.schema, self.path, self.table, partition.names)


class _StreamReader(DataSourceStreamReader):
    """New files by their time of change, whatever their names. The driver lists files, the executors read them.

    An offset is the newest time and the names of all files that aren't older than it by more than `late_seconds`; so a file that arrives later with
    a smaller name, or with an older time within that span, is still new. Its size is that of so many names.
    """

    def __init__(self, schema: StructType, options: dict):
        self.files = _Reader(schema, options)
        self.late = int(float(options.get("late_seconds", LATE_SECONDS)) * 1e9)

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:
        found = timed_files(self.files.path)
        newest = max((t for t, _ in found), default=-1)
        return {"time": newest, "names": sorted(name for t, name in found if t >= newest - self.late)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = set(start["names"]), set(end["names"])
        # what is too old for the end's names, but not for the start's, is new as well: all of it in the first batch
        names = sorted(name for t, name in timed_files(self.files.path) if name not in old and (name in new or (start["time"] - self.late <= t < end["time"] - self.late if start["time"] >= 0 else t < end["time"] - self.late)))
        return [_Files(names[i : i + self.files.step]) for i in range(0, len(names), self.files.step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.files.read(partition)


class TiffDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "dirs")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("tiff") known to a session."""
    ship_package(spark)
    spark.dataSource.register(TiffDataSource)
