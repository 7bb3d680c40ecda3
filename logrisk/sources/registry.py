"""Feature tables by source name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from logrisk.operators import labelled
from logrisk.operators.ordered import Limits
from logrisk.operators.schema import union_sources
from logrisk.sources import logs
from logrisk.sources import traces as trace_files


def load_features(spark: SparkSession, source: str, *, early: bool = False,
                  fractions=(0.25, 0.5, 0.75, 1.0), limit: int | None = None,
                  limits: Limits = Limits(), **paths: str) -> DataFrame:
    """Labelled canonical features of one source, or of `both` log and event sources.

    Without a limit every row is read. paths: log, labels (hdfs); events (google); archive (alibaba, google2019).
    """
    name = (source or "").lower().strip()
    if name == "both":
        parts = []
        for one, needed in (("hdfs", ("log", "labels")), ("google", ("events",))):
            if not all(paths.get(p) for p in needed):
                print(f"skipping {one}: no path for {' and '.join(needed)}")
                continue
            # Only a missing file skips a source; any other error of its input is an error.
            try:
                parts.append(load_features(
                    spark, one, early=early, fractions=fractions, limit=limit, limits=limits, **paths))
            except FileNotFoundError:
                print(f"skipping {one}: input not found")
        if not parts:
            raise FileNotFoundError("no input of either source was found")
        return union_sources(parts)
    try:
        if name == "hdfs":
            raw = logs.read_log(spark, paths["log"], limit)
            known = logs.read_labels(spark, paths["labels"])
            return labelled.log_samples(raw, known, early=early, fractions=fractions, limits=limits)
        if name == "google":
            events = trace_files.read_job_events(spark, paths["events"], limit)
            return labelled.job_samples(events, early=early, fractions=fractions, limits=limits)
        if name == "alibaba":
            jobs, tasks = trace_files.read_gpu_trace(spark, paths["archive"], limit)
            return labelled.gpu_samples(jobs, tasks, early=early, fractions=fractions, limits=limits)
        if name == "google2019":
            rows = trace_files.read_borg(spark, paths["archive"], limit)
            return labelled.borg_samples(rows, early=early)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            raise FileNotFoundError(f"input of source {name!r} not found: {paths}") from missing
        raise
    raise ValueError(
        f"unknown source {source!r}; use hdfs, google, alibaba, google2019 or both")
