"""A stream of the lines that are appended to growing files.

Spark's own file source takes each file once. Here the offset of a stream is a
byte position per file, always behind a line feed, so half a line waits for its
end. A file is known by its first line: if that changes, or the file is
shorter than its position, another file has taken the name, and it is read from
its start; if a new name shows a known first line and the old name does not,
the file was renamed and goes on where it was. Positions are kept in Spark's
offset log, so a restarted query goes on where the last batch ended.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logrisk.sources.ranges import BATCH_ROWS, RANGE, records, texts
from logrisk.sources.zipcsv import file_system, matching

#: Bytes of the first line that tell one file from another.
KNOWN_BY = 4096
STEP = 1 << 16
LINES = StructType([StructField("file", StringType()), StructField("seq", LongType()), StructField("value", StringType())])


def complete(path: str, size: int) -> tuple[int, str]:
    """Bytes up to the last line feed below `size`, and what the first line is known by; ("" if there is none)."""
    files, place = file_system(path)
    with files.open_input_file(place) as source:
        end = size
        while end > 0:
            start = max(0, end - STEP)
            at = source.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                end = start + at + 1
                break
            end = start
        if not end:
            return 0, ""
        head = source.read_at(min(KNOWN_BY, end), 0)
        line = head[:head.find(b"\n") + 1] or head
        return end, xxhash.xxh3_64_hexdigest(line)


def pieces(start: dict, end: dict, size: int = RANGE) -> list[tuple[str, int, int]]:
    """(file, from, to) of what has been added between two offsets, in pieces of at most `size` bytes."""
    came_from = {}
    for name, (_, mark) in start.items():
        if mark and end.get(name, (0, ""))[1] != mark:
            came_from[mark] = name
    out = []
    for name, (stop, mark) in sorted(end.items()):
        begin, known = start.get(name, (0, ""))
        if known != mark or stop < begin:
            # Another file: a renamed one goes on, any other begins.
            begin = start[came_from[mark]][0] if mark in came_from and known != mark else 0
            begin = begin if begin <= stop else 0
        out += [(name, at, min(at + size, stop)) for at in range(begin, stop, size)]
    return out


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class GrowingFiles(DataSource):
    """Options: path (a file or a pattern in its last part; several by commas), from (`end` or `start`)."""

    @classmethod
    def name(cls) -> str:
        return "growingfiles"

    def schema(self) -> StructType:
        return LINES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], self.options.get("from", "end"))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, begin: str):
        if begin not in ("end", "start"):
            raise ValueError("a stream of lines begins at the end or the start of its files")
        self.paths, self.begin = [p.strip() for p in path.split(",")], begin
        #: What is known of files that have not changed: (size, time) and the result.
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.begin == "end" else {}

    def latestOffset(self) -> dict:
        out = {}
        for name in (m for p in self.paths for m in matching(p)):
            files, place = file_system(name)
            info = files.get_file_info(place)
            if info.type != fs.FileType.File:
                continue
            now = (info.size, info.mtime_ns)
            if self.seen.get(name, (None,))[0] != now:
                self.seen[name] = now, complete(name, info.size)
            if self.seen[name][1][0]:
                out[name] = list(self.seen[name][1])
        return out

    def partitions(self, start: dict, end: dict):
        return [_Piece(*p) for p in pieces(start, end)] or [_Piece("", 0, 0)]

    def read(self, partition: _Piece):
        rows: list = []
        for place, record in records(partition.path, partition.start, partition.end) if partition.end else ():
            # Lines of one record share its bytes; later ones count on from its place.
            rows += [(place + k, text) for k, text in enumerate(texts(place, record))]
            if len(rows) >= BATCH_ROWS:
                yield _batch(partition.path, rows)
                rows = []
        if rows:
            yield _batch(partition.path, rows)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _batch(path: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
        LINES.names)


def tail_files(spark: SparkSession, path: str, begin: str = "end") -> DataFrame:
    """Stream of the complete lines appended to files: file, seq (place in the file), value.

    `begin`: where files are first read, their `end` (only what is written from
    now on) or their `start`; files that appear later are read from their start.
    A path may be an address that pyarrow can open. The order of the lines of a
    file is `seq`; between files there is none.
    """
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growingfiles").option("path", re.sub(r"\s*,\s*", ",", path)).option("from", begin).load()
