"""Running aggregates over ordered groups that hold up when one group is huge.

Ordinary groups take one shuffle on their key and a plain window. A group with
more than `hot_rows` rows would be a single task, so its rows are range
partitioned by (key, order) into chunks instead. Every chunk is windowed on its
own, the chunk totals (one row per chunk) are accumulated per key, and each row
adds what came before its chunk. Both ways give the same numbers.

The chunk number is the range partition, which depends on sampled bounds, so
the hot rows are written to the checkpoint folder before anything reads them
twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrisk.session import checkpointed

CHUNK = "_chunk"


@dataclass(frozen=True)
class Limits:
    """Rows one task may sort: per group, and per chunk of a larger group.

    Groups are counted to find those above `hot_rows`. A caller who knows that
    no group is large passes None and saves the count.
    """

    hot_rows: int | None = 4_000_000
    chunk_rows: int = 4_000_000
    # Rows of a task that windows many small groups. A task sorts them once for each order.
    task_rows: int = 250_000
    # More hot keys than this are joined by shuffle, not by broadcast.
    broadcast_keys: int = 1_000_000


@dataclass(frozen=True)
class Run:
    """A running column: `sum`, `max`, `min` up to the row, or `max_before` it."""

    name: str
    kind: str
    value: Column


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _same(left, right, names) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def hot_keys(df: DataFrame, keys: list[str], limits: Limits) -> tuple[DataFrame | None, int, int, int]:
    """Keys above the limit with their row counts, number of such keys, their rows, the rows of all others.

    One job with map-side counts; only three numbers reach the driver.
    """
    hot = F.col("_rows") > limits.hot_rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    n_keys, n_rows, others = counts.agg(F.count_if(hot), *[
        F.coalesce(F.sum(F.when(part, F.col("_rows"))), F.lit(0)) for part in (hot, ~hot)]).first()
    if n_keys == 0:
        return None, 0, 0, others
    return checkpointed(counts.where(hot)), n_keys, n_rows, others


def tasks_for(rows: int, at_once: int, task_rows: int) -> int:
    """Tasks for some rows: none above `task_rows`, and all cores in use unless there are few rows."""
    return max(1, ceil(rows / task_rows), min(at_once, ceil(10 * rows / task_rows)))


def _sized(df: DataFrame, rows: int, limits: Limits) -> DataFrame:
    return F.broadcast(df) if rows <= limits.broadcast_keys else df


def _aggregate(kind: str):
    return {"sum": F.sum, "max": F.max, "max_before": F.max, "min": F.min}[kind]


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def _windowed(df: DataFrame, keys: list, order: list, runs: list[Run]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        run.name: _aggregate(run.kind)(run.value).over(before if run.kind == "max_before" else upto)
        for run in runs
    })


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    stages: list[list[Run]],
    *,
    firsts: dict[str, str] | None = None,
    total: str | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Adds running columns per key in the given order.

    stages: lists of runs; a later stage may use columns of an earlier one.
    firsts: value column -> name of a 0/1 column that marks its first row per key
            (NULL is a value of its own); `order` must then be column names.
    total:  name of a column with the number of rows of the key.
    The order must be unique within a key.
    """
    firsts = firsts or {}
    if limits.hot_rows is None:
        return _plain(df, keys, order, stages, firsts, total)
    hot, n_keys, n_rows, others = hot_keys(df, keys, limits) if keys else _whole(df, limits)
    parts = tasks_for(others, df.sparkSession.sparkContext.defaultParallelism, limits.task_rows)
    if hot is None:
        return _plain(df, keys, order, stages, firsts, total, parts)
    if not keys:
        return _chunked(df, keys, order, stages, firsts, total, n_rows, n_keys, limits)
    names = _sized(hot, n_keys, limits)
    cold = df.alias("d").join(names.alias("h"), _same("d", "h", keys), "left_anti")
    warm = df.alias("d").join(names.alias("h"), _same("d", "h", keys)).select("d.*", "h._rows")
    chunked = _chunked(warm, keys, order, stages, firsts, total, n_rows, n_keys, limits)
    return _plain(cold, keys, order, stages, firsts, total, parts).unionByName(chunked)


def _whole(df: DataFrame, limits: Limits) -> tuple[DataFrame | None, int, int, int]:
    """Without a key all rows are one group."""
    rows = df.count()
    return (None, 0, 0, rows) if rows <= limits.hot_rows else (df, 1, rows, 0)


def _plain(df, keys, order, stages, firsts, total, parts=None) -> DataFrame:
    if parts and keys:
        # A number of partitions that was asked for is kept: by bytes, which are few for
        # the compressed flags of millions of rows, they would be joined to one large task.
        df = df.repartition(parts, *keys)
    elif firsts and keys:
        # One shuffle on the key serves the windows per (key, value) as well.
        df = df.repartition(*keys)
    for value, name in firsts.items():
        nth = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))
        df = df.withColumn(name, (nth == 1).cast("int"))
    for runs in stages:
        df = _windowed(df, keys, order, runs)
    if total:
        df = df.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df


def _chunked(df, keys, order, stages, firsts, total, n_rows, n_keys, limits) -> DataFrame:
    for value, name in firsts.items():
        df = _mark_first(df, keys, order, value, name)
    parts = max(2, ceil(n_rows / limits.chunk_rows))
    df = checkpointed(
        df.repartitionByRange(parts, *[_column(c) for c in [*keys, *order]])
        .withColumn(CHUNK, F.spark_partition_id())
    )
    # A chunk row per range partition and per key that begins inside one.
    n_chunks = parts + n_keys
    place = [*keys, CHUNK]
    for runs in stages:
        earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        totals = df.groupBy(*place).agg(*[_aggregate(r.kind)(r.value).alias(r.name) for r in runs])
        offsets = totals.select(
            *place, *[_aggregate(r.kind)(r.name).over(earlier).alias("_before_" + r.name) for r in runs])
        local = _windowed(df, place, order, runs)
        joined = local.alias("d").join(
            _sized(offsets, n_chunks, limits).alias("o"), _same("d", "o", place), "left")
        df = joined.select(
            *[F.col(f"d.{c}") for c in local.columns if c not in {r.name for r in runs}],
            *[_combine(r.kind, F.col(f"d.{r.name}"), F.col(f"o._before_{r.name}")).alias(r.name)
              for r in runs],
        )
    if total and keys:
        df = df.withColumnRenamed("_rows", total)
    elif total:
        df = df.withColumn(total, F.lit(n_rows).cast("long"))
    return df.drop(CHUNK, "_rows")


def _mark_first(df, keys, order, value, name) -> DataFrame:
    """Marks first rows by a join on (key, value, order), which spreads a hot key."""
    found = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
    found = found.select(*keys, value, *[F.col("_o")[c].alias(c) for c in order], F.lit(1).alias(name))
    on = [*keys, value, *order]
    joined = df.alias("d").join(found.alias("f"), _same("d", "f", on), "left")
    return joined.select("d.*", F.coalesce(F.col(f"f.{name}"), F.lit(0)).alias(name))


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str = "n",
                total: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Exact 1-based row number per key, or over all rows without a key."""
    one = Run(name, "sum", F.lit(1).cast("long"))
    return running(df, keys, order, [[one]], total=total, limits=limits)


def bursts(bad: Column, n: str = "n", run: str = "burst") -> list[list[Run]]:
    """Stages for the longest run of bad rows so far, given a running row number `n`."""
    return [
        [Run("_last_ok", "max", F.when(~bad, F.col(n)))],
        [Run(run, "max", F.when(bad, F.col(n) - F.coalesce(F.col("_last_ok"), F.lit(0)))
             .otherwise(F.lit(0).cast("long")))],
    ]
