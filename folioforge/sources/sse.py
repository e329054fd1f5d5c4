"""Replies of models as they come, as a source: ``spark.readStream.format("sse")`` over a folder of transcripts.

A transcript is a file of a call's server-sent lines, named by the call, that grows while the model speaks. A batch is a range
of bytes of each file, up to its last whole line, so a restart reads what it had planned before, and no line twice. Files are
opened through Arrow's file systems, by the tasks that read them; the driver lists the folder and looks for line ends.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Bytes of a file that one task reads, about; bytes looked through at once for a line's end.
RANGE, BLOCK = 8 << 20, 1 << 16

SCHEMA = "call string, at bigint, line string"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(folder: str) -> dict[str, int]:
    """Name and size of the transcripts of a folder."""
    from pyarrow import fs

    system, at = _opened(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _whole(folder: str, name: str, start: int, size: int) -> int:
    """The end of the last whole line of a file's bytes from ``start`` on; ``start`` if there is none."""
    system, at = _opened(folder)
    with system.open_input_file(f"{at}/{name}") as f:
        to = size
        while to > start:
            begin = max(start, to - BLOCK)
            found = f.read_at(to - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            to = begin
    return start


class Bytes(InputPartition):
    """Bytes ``start`` to ``end`` of a file, which are whole lines."""

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def _lines(folder: str, part: Bytes) -> Iterator[tuple[str, int, str]]:
    """``(call, at, line)``: each line without its end, with its place in the file in bytes."""
    if part.start >= part.end:
        return
    system, at = _opened(folder)
    with system.open_input_file(f"{at}/{part.name}") as f:
        place, rest = part.start, b""
        while place < part.end:
            block = f.read_at(min(RANGE, part.end - place), place)
            begin = place - len(rest)
            place += len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                yield part.name, begin, line.rstrip(b"\r").decode("utf-8", "replace")
                begin += len(line) + 1
        if rest:
            yield part.name, part.end - len(rest), rest.rstrip(b"\r").decode("utf-8", "replace")


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder, self.reached = folder, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name, size in _files(self.folder).items():
            start = self.reached.get(name, 0)
            self.reached[name] = _whole(self.folder, name, start, size) if size > start else start
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        return [Bytes(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        return _lines(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    """All lines there are; a filter on the call picks files before any is opened."""

    def __init__(self, folder: str):
        self.folder, self.calls = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("call",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.calls = wanted if self.calls is None else self.calls & wanted
            else:
                yield f

    def partitions(self) -> list[Bytes]:
        return [Bytes(name, 0, size) for name, size in sorted(_files(self.folder).items()) if size and (self.calls is None or name in self.calls)] or [Bytes("", 0, 0)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        return _lines(self.folder, partition)


class SseSource(DataSource):
    """Lines of transcripts, ``(call, at, line)``; the option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        folder = self.options.get("path")
        if not folder:
            raise ValueError("the source sse needs the option path")
        return folder.rstrip("/")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._folder())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SseSource)
