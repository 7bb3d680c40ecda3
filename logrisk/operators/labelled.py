"""Labels onto features: training samples and data-set counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.operators import snapshots, traces
from logrisk.operators.logfeatures import (
    finish_log_features, history_features, line_signals, prefix_features,
)
from logrisk.operators.ordered import Limits, row_numbers
from logrisk.operators.schema import align
from logrisk.session import checkpointed


def with_labels(features: DataFrame, labels: DataFrame, key: str = "process_id") -> DataFrame:
    """Inner equi join: processes without a label are left out."""
    return features.join(labels, key, "inner")


def unlabelled(processes: DataFrame, labels: DataFrame, key: str = "process_id") -> DataFrame:
    return processes.select(key).distinct().join(labels, key, "left_anti")


def dataset_counts(processes: DataFrame, labels: DataFrame, key: str = "process_id") -> DataFrame:
    """Labelled processes, failures, successes and skipped ones, in one row."""
    known = processes.select(key).distinct().join(labels, key, "left")
    return known.agg(
        F.count("label").alias("labelled"),
        F.count_if(F.col("label") == 1).alias("failures"),
        F.count_if(F.col("label") == 0).alias("successes"),
        F.count_if(F.col("label").isNull()).alias("skipped"),
    )


def log_samples(raw: DataFrame, labels: DataFrame, *, early: bool = False,
                fractions=snapshots.FRACTIONS, limits: Limits = Limits()) -> DataFrame:
    """Canonical rows of labelled processes: whole histories or prefix samples."""
    signals = line_signals(raw)
    if not early:
        features = finish_log_features(history_features(signals, limits=limits), log1p=False)
        return align(with_labels(features, labels), "hdfs")
    prefixes = prefix_features(signals, total="total", limits=limits)
    samples = snapshots.early_warning(prefixes, fractions=fractions)
    named = labels.withColumnRenamed("process_id", "group_id")
    features = finish_log_features(samples, log1p=False)
    return align(with_labels(features, named, "group_id"), "hdfs")


def job_samples(events: DataFrame, *, early: bool = False, fractions=snapshots.FRACTIONS,
                limits: Limits = Limits()) -> DataFrame:
    """Canonical rows of labelled jobs; a prefix sample is the job's first events in file order."""
    labels = traces.job_labels(events).select(F.col("job_id").alias("group_id"), "label")
    if not early:
        features = traces.job_features(events, limits=limits).withColumn("group_id", F.col("process_id"))
        return align(features.join(labels, "group_id"), "google")
    prefixed = event_prefixes(events, fractions, limits)
    features = traces.job_features(prefixed, limits=limits)
    group = F.regexp_extract("process_id", r"^(.*)@\d+_of_\d+$", 1)
    return align(features.withColumn("group_id", group).join(labels, "group_id"), "google")


def event_prefixes(events: DataFrame, fractions=snapshots.FRACTIONS,
                   limits: Limits = Limits()) -> DataFrame:
    """The events of each prefix sample, under the job id `id@size_of_total`.

    Every event is repeated for the (at most `len(fractions)`) samples it is part of.
    """
    return _prefixes(events, "job_id", fractions, limits)


def _prefixes(events: DataFrame, key: str, fractions, limits: Limits) -> DataFrame:
    numbered = row_numbers(events, [key], ["seq"], "_n", total="_total", limits=limits)
    sizes = F.array_distinct(F.array(*[
        F.greatest(F.lit(1), F.least(F.col("_total"), F.ceil(F.col("_total") * F.lit(f)))).cast("long")
        for f in snapshots.check_fractions(fractions)]))
    part_of = F.filter(sizes, lambda s: s >= F.col("_n"))
    name = F.concat(key, F.lit("@"), F.col("_size").cast("string"), F.lit("_of_"),
                    F.col("_total").cast("string"))
    return (
        numbered.withColumn("_size", F.explode(part_of))
        .withColumn(key, name).drop("_n", "_total", "_size")
    )


def gpu_samples(jobs: DataFrame, tasks: DataFrame, *, early: bool = False,
                fractions=snapshots.FRACTIONS, limits: Limits = Limits()) -> DataFrame:
    """Canonical rows of GPU jobs; a prefix sample is the job's first tasks by `seq`."""
    if not early:
        return align(traces.gpu_features(jobs, tasks), "alibaba")
    # Jobs and prefixes are each read several times, so they are stored.
    jobs = checkpointed(jobs)
    known = jobs.select(F.col("job_name").alias("group_id"), "label", "job_start_time")
    own = traces.tasks_of(tasks, jobs).withColumn("group_id", F.col("job_name"))
    prefixed = checkpointed(_prefixes(own, "job_name", fractions, limits))
    named = prefixed.select("group_id", "job_name").distinct()
    # A job without tasks has one sample: its default task.
    every = known.join(named, "group_id", "left").withColumn(
        "job_name", F.coalesce("job_name", F.concat("group_id", F.lit("@1_of_1"))))
    features = traces.gpu_features(every, prefixed.drop("group_id"))
    groups = every.select(F.col("job_name").alias("process_id"), "group_id")
    return align(features.join(groups, "process_id"), "alibaba")


def borg_samples(rows: DataFrame, *, early: bool = False) -> DataFrame:
    """Canonical instance rows; as a prefix sample each row is its own group of one."""
    features = traces.borg_features(rows)
    if early:
        features = features.withColumn("group_id", F.col("process_id")).withColumn(
            "process_id", F.concat("process_id", F.lit("@1_of_1")))
    return align(features, "google2019")
