"""Chat archives as a data source: spark.read.format("chat_archive") and readStream.

A row is a file: path, value (its whole text), bytes, changed. It is what chats.files gives, so every parser takes it:
readers.file_turns(spark.read.format("chat_archive").load(root)) are an archive's turns. What it adds:

- filters on path (=, in, starts with), bytes and changed (<, <=, >, >=, =) are pushed to the listing: files that do not
  match are never opened.
- as a stream, a file that is written again is read again: the offset is a time of change, and a round takes what
  changed since. Spark's own file source remembers names, and misses it.
- df.write.format("chat_archive").mode("append").save(root) writes a file for each row (path below the root, value), under the
  name given and from the row's task: Spark's writers by partition name files themselves, and on a local file system start a
  process for each file and folder. A file that is there is replaced, whole or not at all.

Options: glob (* by default), under (the name of a file's folder), depth (folders below the root), hidden (true by default: also
paths with a part that begins with a dot, which Spark's own readers skip), maxBytes (of files that one task reads, 64 MB by default). path is a URI that
pyarrow's file systems open, or a local path that driver and executors share.

A file that goes between listing and reading is left out; one that is not UTF-8 is read with replacement characters."""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, value string, bytes long, changed timestamp"
_BY = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b)}


@dataclass
class Files(InputPartition):
    """Files of one task: path, bytes, changed in microseconds."""

    files: tuple[tuple[str, int, int], ...]

    def __init__(self, files: tuple[tuple[str, int, int], ...]) -> None:
        self.files = files


def _open(root: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else fs.FileSystem.from_uri(root.replace("file:", "file://", 1) if root.startswith("file:") else posixpath.abspath(root))


def _micros(at: datetime) -> int:
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)


class _Archive:
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("chat_archive needs a path")
        self.glob, self.under = options.get("glob", "*"), options.get("under")
        self.depth = int(options["depth"]) if "depth" in options else None
        self.hidden = options.get("hidden", "true").lower() != "false"
        self.most = int(options.get("maxbytes", options.get("maxBytes", 64 << 20)))
        self.filters: list[tuple[str, type, object]] = []

    def listed(self) -> list[tuple[str, int, int]]:
        """Files that match the options and the pushed filters, in order of path. Metadata alone, 100 bytes or so a file."""
        from pyarrow import fs

        where, root = _open(self.root)
        found = []
        for info in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = posixpath.relpath(info.path, root).split("/")
            if info.type != fs.FileType.File or not fnmatch.fnmatchcase(parts[-1], self.glob) or not self.hidden and any(p.startswith(".") for p in parts):
                continue
            if self.under is not None and posixpath.basename(posixpath.dirname(info.path)) != self.under or self.depth is not None and len(parts) != self.depth + 1:
                continue
            row = {"path": info.path, "bytes": info.size, "changed": info.mtime_ns // 1000}
            if all(_BY[kind](row[column], value) for column, kind, value in self.filters):
                found.append((info.path, info.size, row["changed"]))
        return sorted(found)

    def dealt(self, files: list[tuple[str, int, int]]) -> list[Files]:
        """Partitions of about equal bytes; a large file is one alone."""
        out, held, size = [], [], 0
        for f in files:
            if held and size + f[1] > self.most:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f)
            size += f[1]
        return [*out, Files(tuple(held))] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A batch for each file, so a task holds one at a time."""
        where, _ = _open(self.root)
        for path, _, changed in partition.files:
            try:
                with where.open_input_stream(path) as stream:
                    data = stream.read()
            except FileNotFoundError:
                continue
            columns = [pa.array([path]), pa.array([data.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64()), pa.array([changed], pa.timestamp("us", tz="UTC"))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "value", "bytes", "changed"])


class ArchiveReader(_Archive, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes those on one of the three columns; yields the others back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if type(f) not in _BY or column not in ("path", "bytes", "changed") or value is None or isinstance(f, StringStartsWith) and column != "path":
                yield f
            else:
                to = (lambda v: _micros(v) if isinstance(v, datetime) else v) if column == "changed" else (lambda v: v)
                self.filters.append((column, type(f), tuple(map(to, value)) if isinstance(f, In) else to(value)))

    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())


class ArchiveStream(_Archive, DataSourceStreamReader):
    """Offsets are times of change in microseconds: a round is the files that changed after the last offset and at or before
    the new one, listed again when a round is replayed (a file that changed once more since is then in a later round). A file
    that appears later with a time of change at or before an offset, such as one moved in with its old time, is missed."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": max((f[2] for f in self.listed()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt([f for f in self.listed() if start["changed"] < f[2] <= end["changed"]])

    def commit(self, end: dict) -> None:
        pass


class ArchiveWriter(DataSourceArrowWriter):
    """Files written by tasks; a task that runs twice writes the same files again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("chat_archive needs a path")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = _open(self.root)
        made = set()
        for batch in iterator:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path below the archive: {path!r}")
                at = f"{root}/{path}"
                above = posixpath.dirname(at)
                if above not in made:
                    where.create_dir(above, recursive=True)
                    made.add(above)
                part = f"{above}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as stream:
                    stream.write((value or "").encode())
                where.move(part, at)
        return WriterCommitMessage()


class ChatArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("chat_archive is appended to")
        return ArchiveWriter(self.options)

    def streamReader(self, schema: object) -> ArchiveStream:  # noqa: N802
        return ArchiveStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChatArchive)
