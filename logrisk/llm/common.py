"""What several operators of this folder share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.session import shared_folder

#: White space of the text rules: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Subfolder for what `stored` writes just now; see `step`.
_subfolder = [""]


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share."""
    return os.path.join(_own_folder(spark), _subfolder[0], f"{name}-{uuid.uuid4().hex[:12]}")


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"llm-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(name)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: What a Python worker keeps between its tasks; see `kept`.
_kept: dict = {}


def kept(operator: str, key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between its tasks, made if it is not there.

    A worker serves one operator after another; what it kept for another one,
    or for another key, goes, so that their memories do not add up.
    """
    if (operator, key) not in _kept:
        alone()
        _kept[operator, key] = make()
    return _kept[operator, key]


def alone() -> None:
    """Lets go what operators have kept in this Python worker; for one that keeps nothing and needs much memory."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


@contextmanager
def step(spark: SparkSession, of: str) -> Iterator[None]:
    """A step of the job `of`, which runs its steps one after another and saves the result of each.

    What `stored` writes within a step is deleted when the next step of the job
    begins; by then the result has been saved elsewhere.
    """
    _delete(spark, os.path.join(_own_folder(spark), of))
    before, _subfolder[0] = _subfolder[0], of
    try:
        yield
    finally:
        _subfolder[0] = before


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor repeats tasks of the next step only, and
    a join on the copy has its own exchange on both sides, which lets AQE split
    a hot key. The shuffle files of the step go as soon as the copy is there.
    """
    folder = stage_folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what `stored` has written of these frames; for frames that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.stored_in)


def release(spark: SparkSession) -> None:
    """Deletes what `stored` of this application has written; call when results are saved."""
    _delete(spark, _own_folder(spark))


def same(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of the named columns of two aliases."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
