"""Readers for cluster-trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.operators import traces
from logrisk.operators.ordered import row_numbers
from logrisk.sources.logs import numbered_rows
from logrisk.sources.zipcsv import register_zip_csv


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, quotes doubled inside quotes."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_job_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    raw = numbered_rows(read_csv(spark, path))
    if limit:
        raw = raw.where(F.col("seq") < limit)
    return traces.clean_events(raw)


def read_zip_csv(spark: SparkSession, archive: str, member: str) -> DataFrame:
    """A CSV inside a ZIP archive, with its row number as `seq`."""
    register_zip_csv(spark)
    return spark.read.format("zipcsv").option("path", archive).option("member", member).load()


def read_gpu_trace(spark: SparkSession, archive: str, limit: int | None = None):
    """Jobs (all, or the first `limit` different ones in file order) and their tasks."""
    jobs = traces.gpu_jobs(read_zip_csv(spark, archive, "pai_job_table.csv"), limit=limit)
    tasks = traces.gpu_tasks(read_zip_csv(spark, archive, "pai_task_table.csv"))
    return jobs, traces.tasks_of(tasks, jobs)


def read_borg(spark: SparkSession, archive: str, limit: int | None = None) -> DataFrame:
    """Instance rows: all, or the first `limit` in the order of archives and rows."""
    rows = read_zip_csv(spark, archive, "borg_traces_data.csv")
    if limit is None:
        return rows
    # Row numbers of each archive begin at a place of their own, so they are counted anew.
    return row_numbers(rows, [], ["seq"], "_n").where(F.col("_n") <= limit).drop("_n")
