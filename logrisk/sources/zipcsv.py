"""A data source for CSV members of ZIP archives.

A compressed member can only be read from its start, so one task reads one
member, in batches that are never held whole. Many archives are read side by
side: `path` may list several, separated by commas, or use wildcards in the last
part. Paths may be addresses (hdfs://, s3://, file://) that pyarrow can open.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import re
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

BATCH_ROWS = 10_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _archive(path: str) -> zipfile.ZipFile:
    files, place = file_system(path)
    return zipfile.ZipFile(files.open_input_file(place))


def matching(pattern: str) -> list[str]:
    """Paths a pattern stands for; one without wildcards stands for itself."""
    folder, _, name = pattern.rpartition("/")
    if not re.search(r"[*?\[]", name):
        return [pattern]
    files, place = file_system(folder or ".")
    found = files.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted(f"{folder}/{i.base_name}" if folder else i.base_name for i in found if fnmatch.fnmatch(i.base_name, name))


def _open(archive: zipfile.ZipFile, member: str):
    try:
        raw = archive.open(member)
    except KeyError as missing:
        raise FileNotFoundError(f"archive has no member {member}") from missing
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")


class _Member(InputPartition):
    def __init__(self, path: str, number: int):
        self.path = path
        self.number = number


class ZipCsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def paths(self) -> list[str]:
        found = []
        for part in self.options["path"].split(","):
            found += matching(part.strip()) or [part.strip()]
        return found

    def schema(self) -> StructType:
        with _archive(self.paths()[0]) as archive, _open(archive, self.options["member"]) as text:
            header = next(csv.reader(text), [])
        return StructType(
            [StructField("seq", LongType())] + [StructField(h, StringType()) for h in header])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipCsvReader(self.paths(), self.options["member"], schema)


class ZipCsvReader(DataSourceReader):
    def __init__(self, paths: list[str], member: str, schema: StructType):
        self.archives = paths
        self.member = member
        self.columns = [f.name for f in schema.fields]

    def partitions(self):
        return [_Member(path, i) for i, path in enumerate(self.archives)]

    def read(self, partition: _Member):
        """Arrow batches; rows of archive k are numbered from k * 2^40."""
        types = pa.schema([(c, pa.int64() if c == "seq" else pa.string()) for c in self.columns])
        first = partition.number << 40
        with _archive(partition.path) as archive, _open(archive, self.member) as text:
            batch = []
            for i, row in enumerate(csv.DictReader(text)):
                row["seq"] = first + i
                batch.append({c: row.get(c) for c in self.columns})
                if len(batch) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(batch, schema=types)
                    batch = []
            if batch:
                yield pa.RecordBatch.from_pylist(batch, schema=types)


def register_zip_csv(spark: SparkSession) -> None:
    spark.dataSource.register(ZipCsvSource)
