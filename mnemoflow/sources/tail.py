"""A streaming source that follows growing text files by byte offset and hands on complete lines only."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def complete_end(path: str, begin: int) -> tuple[int, int]:
    """(begin, end) of the complete lines from ``begin`` on; a file shorter than ``begin`` was replaced and starts over; a missing one is empty."""
    try:
        size = os.path.getsize(path)
    except OSError:
        return 0, 0
    if begin > size:
        begin = 0
    with open(path, "rb") as f:
        f.seek(begin)
        data = f.read(size - begin)
    return begin, begin + data.rfind(b"\n") + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.seen)
        for path in sorted(glob.glob(self.pattern)):
            out[path] = complete_end(path, out.get(path, 0))[1]
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(p, start.get(p, 0) if start.get(p, 0) <= e else 0, e) for p, e in sorted(end.items()) if e != start.get(p, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            for line in f.read(partition.end - partition.begin).splitlines():
                yield (partition.path, line.decode("utf-8", "replace"))

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", glob)``: (path, value). Register with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
