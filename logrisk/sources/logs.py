"""Log text and label files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.functions.casts import flag
from logrisk.operators.ordered import Limits, Run, running
from logrisk.session import written
from logrisk.sources.ranges import numbered_lines, plain_files


def read_log(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """`seq` (line number from 0, in file order) and `value`.

    Bytes that are no UTF-8 become the replacement character. Plain files are
    read once, by ranges, and with a limit only the first ranges are; files
    that can't be read from the middle (compressed ones), or that only Spark
    reaches, are placed by `numbered_rows`.
    """
    found = plain_files(spark, path)
    if found is not None:
        return numbered_lines(spark, found, limit)
    numbered = numbered_rows(spark.read.text(path))
    return numbered if limit is None else numbered.where(F.col("seq") < limit)


def numbered_rows(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds the dense row number `seq` from 0, in file order, to rows read from files.

    Files carry no row numbers. The rows are placed once, by file, input split
    and order in the split, and written with their places; the number of rows
    before each split comes from the written copy, so that rows and offsets
    always speak of the same splits, whatever splits a later scan would choose.
    """
    placed = written(raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    ), "placed")
    splits = written(placed.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")), "splits")
    offsets = running(splits, [], ["_file", "_start"], [[Run("_upto", "sum", F.col("_rows"))]], limits=limits)
    seq = F.col("_upto") - F.col("_rows") + F.col("_at") - F.col("_first")
    return placed.join(offsets, ["_file", "_start"], "left").select(
        F.when(seq.isNotNull(), seq).otherwise(F.raise_error(F.lit("a split has no offset"))).cast("long").alias("seq"),
        *raw.columns)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file with either header spelling; `process_id`, `label`."""
    return clean_labels(numbered_rows(spark.read.option("header", True).csv(path)))


def clean_labels(raw: DataFrame, order: str | None = "seq") -> DataFrame:
    """1 for anomaly, else 0; of several rows for a process the last one counts."""
    def pick(*names: str, default: str):
        found = [F.col(n) for n in names if n in raw.columns]
        return F.trim(F.coalesce(*found[:1], F.lit(default))) if found else F.lit(default)

    label = flag(F.lower(pick("Label", "label", default="Normal")) == "anomaly")
    name = pick("BlockId", "block_id", default="")
    if order is None or order not in raw.columns:
        return raw.select(name.alias("process_id"), label.alias("label"))
    rows = raw.select(order, name.alias("process_id"), label.alias("label"))
    return rows.groupBy("process_id").agg(F.max_by("label", order).alias("label"))


TAIL = "arrived timestamp, file string, split long, seq long, value string"


def tail_log(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Stream of new lines: files that appear in the folder, oldest first.

    Lines come with the order (arrived, file, split, seq): the time of the
    file, its path, the input split and the number of the line in it. With one
    file per micro-batch (`max_files` 1) files follow each other strictly.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files).option("latestFirst", False)
        .text(folder)
    )
    placed = lines.select(
        F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.lit(0).cast("long").alias("seq"), "value")
    return placed.mapInArrow(_count_lines, TAIL)


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each file split; a task reads them one after the other."""
    place, n = None, 0
    for batch in batches:
        numbers = []
        for here in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            place, n = here, n + 1 if here == place else 0
            numbers.append(n)
        yield batch.set_column(3, "seq", pa.array(numbers, pa.int64()))
