"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logrisk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Checkpoints go when their frame does.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Call sites of every column expression are costly to record for wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, shared by all executors.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    named = os.path.join(tempfile.gettempdir(), f"logrisk-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and continue from the written copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table below the shared folder, read back.

    Unlike a checkpoint the copy keeps no partitioning, is compressed, and is
    read by column. `release` deletes the copies of an application.
    """
    spark = df.sparkSession
    folder = os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"work-{spark.sparkContext.applicationId}")


def new_folder(spark: SparkSession, name: str) -> str:
    """Place for files of one run below the shared folder."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def release(spark: SparkSession) -> None:
    """Deletes what `written` and `new_folder` of this application hold; call when results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
