"""Numbered lines of text files without a copy: an index of line counts per byte range.

A file is cut into ranges of fixed size; a line belongs to the range in which
its first byte lies. One job counts the lines of each range, which gives the
number of the first line of every range; the text is then read once, range by
range, each with its own numbers. With a limit only the first ranges are
counted and read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logrisk.session import new_folder
from logrisk.sources.zipcsv import file_system

RANGE = 64 << 20
BATCH_ROWS = 10_000
COMPRESSED = re.compile(r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$")
MARK = b"\xef\xbb\xbf"


def records(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of what ends in a line feed and begins in a range; the last one of a file may lack it."""
    files, place = file_system(path)
    with files.open_input_file(place) as raw:
        at = start
        if start:
            raw.seek(start - 1)
        reader = _Lines(raw)
        if start:
            at += len(reader.line()) - 1
        while at < end:
            line = reader.line()
            if not line:
                return
            yield at, line
            at += len(line)


class _Lines:
    """Line by line from an open file, which is read in large pieces."""

    def __init__(self, source):
        self.source, self.held, self.at = source, b"", 0

    def line(self) -> bytes:
        parts = []
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.held[self.at:end + 1])
                self.at = end + 1
                return b"".join(parts)
            parts.append(self.held[self.at:])
            self.held, self.at = self.source.read(1 << 20), 0
            if not self.held:
                return b"".join(parts)


def texts(place: int, record: bytes) -> list[str]:
    """The lines of a record; a carriage return ends a line as well, and a file may begin with a byte order mark."""
    if not place and record.startswith(MARK):
        record = record[len(MARK):]
    return [x.decode("utf-8", "replace") for x in record.splitlines()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [sum(len(texts(*r)) for r in records(p, s, e)) for p, s, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["n", "rows"])


def plain_files(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """The files of a path in order, or None where they can't be read by ranges."""
    found = sorted(spark.read.text(path).inputFiles())
    if any(COMPRESSED.search(f) or not re.match(r"(file|hdfs|s3):", f) for f in found):
        return None
    return found


def numbered_lines(spark: SparkSession, found: list[str], limit: int | None = None, size: int = RANGE) -> DataFrame:
    """seq (from 0, in file order) and value of the lines of some files."""
    ranges = []
    for name in found:
        files, place = file_system(name)
        length = files.get_file_info(place).size
        ranges += [(name, s, min(s + size, length)) for s in range(0, length, size)]
    counts: list[int] = []
    while len(counts) < len(ranges) and (limit is None or sum(counts) < limit):
        # Without a limit all at once, else twice as many ranges each time.
        more = ranges[len(counts):] if limit is None else ranges[len(counts):2 * len(counts) + 1]
        counts += _counted(spark, more)
    index = os.path.join(new_folder(spark, "lines"), "index.json")
    kept, first = [], 0
    for (name, start, end), rows in zip(ranges, counts):
        kept.append((name, start, end, first, rows if limit is None else max(0, min(rows, limit - first))))
        first += rows
    _write(index, kept)
    spark.dataSource.register(NumberedLines)
    return spark.read.format("numberedlines").option("index", index).load()


def _counted(spark: SparkSession, ranges: list) -> list[int]:
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "n long, path string, start long, end long")
    counted = rows.repartition(min(len(ranges), 10_000), "n").mapInArrow(_count, "n long, rows long").collect()
    return [r.rows for r in sorted(counted)]


def _write(name: str, rows: list) -> None:
    files, place = file_system(name)
    files.create_dir(os.path.dirname(place), recursive=True)
    with files.open_output_stream(place) as out:
        out.write(json.dumps(rows).encode())


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int, rows: int):
        self.path, self.start, self.end, self.first, self.rows = path, start, end, first, rows


class NumberedLines(DataSource):
    """Lines by an index of ranges: option `index` names the file that `numbered_lines` wrote."""

    @classmethod
    def name(cls) -> str:
        return "numberedlines"

    def schema(self) -> StructType:
        return StructType([StructField("seq", LongType()), StructField("value", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NumberedReader(self.options["index"])


class NumberedReader(DataSourceReader):
    def __init__(self, index: str):
        self.index = index

    def partitions(self):
        files, place = file_system(self.index)
        with files.open_input_stream(place) as source:
            rows = json.loads(source.read())
        return [_Range(*r) for r in rows if r[4]] or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range):
        values, first, left = [], partition.first, partition.rows
        for place, record in records(partition.path, partition.start, partition.end) if left else ():
            values += texts(place, record)
            if len(values) >= BATCH_ROWS or len(values) >= left:
                values = values[:left]
                yield _batch(first, values)
                first, left, values = first + len(values), left - len(values), []
                if not left:
                    return
        if values:
            yield _batch(first, values[:left])


def _batch(first: int, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(values)), pa.int64()), pa.array(values, pa.string())], ["seq", "value"])
