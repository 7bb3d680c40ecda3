"""The given tables reshaped to the inputs of the jobs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F




def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to as many partitions as `spark.logrisk.deal` says, as they come if it is unset.

    A file of one row group is one task; a session over such files sets it.
    """
    parts = df.sparkSession.conf.get("spark.logrisk.deal", None)
    return df.repartition(int(parts)) if parts else df


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the event rows, dealt by id to as many tasks as a shuffle has.

    Lines are made and read before the rows go to their processes; without this
    a file below the split size would be one task.
    """
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet")
    parts = int(spark.conf.get("spark.logrisk.deal", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    return source.parquet(folder).repartition(parts, "event_id")


def log_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines made from `events`; every tenth line names a second process."""
    return log_lines_of(dealt(table(spark, folder, "events")))


def log_lines_of(events: DataFrame) -> DataFrame:
    """The same for any batch or stream of event rows."""
    return events.selectExpr(
        "event_id as seq",
        """date_format(ts,'yyMMdd HHmmss') || ' ' || cast(100 + user_id % 5 as string) || ' ' ||
        case when event_type='error' and value >= 150 then 'FATAL'
             when event_type='error' then 'ERROR' when event_type='signup' then 'WARN'
             when event_type='view' and value < 5 then 'DEBUG' else 'INFO' end
        || ' ' || case event_type when 'click' then 'pipeline.Extractor'
             when 'view' then 'pipeline.SchemaValidator' when 'purchase' then 'pipeline.Loader'
             when 'signup' then 'pipeline.Transformer' else 'dfs.DataNode$DataXceiver' end
        || ': ' || case
             when event_type='error' and value >= 150 then 'Critical corruption detected for block '
             when event_type='error' and value >= 75 then 'IOException while processing block '
             when event_type='error' then 'Timeout while loading; retrying block '
             when event_type='signup' then 'Slow transform observed for block '
             else 'Processed batch for block ' end
        || 'blk_' || case when user_id % 7 = 0 then '-' else '' end || cast(user_id as string)
        || case when event_id % 10 = 0
                then ' mirrored to blk_' || cast(user_id + 1 as string) else '' end as value""",
    )


def block_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("user_id % 11 <> 10").selectExpr(
        "'blk_' || case when user_id % 7 = 0 then '-' else '' end || cast(user_id as string) as BlockId",
        "case when user_id % 7 = 0 then 'Anomaly' else 'Normal' end as Label",
    ).distinct()


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Scheduler events made from `events`, as text columns of a CSV with a header."""
    return job_events_of(table(spark, folder, "events"))


def job_events_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as seq",
        "cast(event_id*1000 as double) as time",
        "cast(user_id as string) || '-' || cast(cast(floor(day(ts)/5) as int) as string) as job_id",
        """case when event_type='view' then 0 when event_type='click' then 1
                when event_type='error' and value>=120 then 5
                when event_type='error' and value>=100 then 3
                when event_type='error' and value>=90 then 2
                when event_type='error' and value>=85 then 6
                when event_type='purchase' and value<40 then 4
                when event_type='signup' and value<40 then 7 else 8 end as event_type""",
        "cast(user_id % 4 as int) as scheduling_class",
        "cast(event_id % 12 as int) as priority",
        "value/400 as cpu_request",
        "value/300 as memory_request",
        "value/1000 as disk_space_request",
        "'u' || cast(user_id % 13 as string) as user",
    )


def late_events(events: DataFrame) -> DataFrame:
    """Scheduler events with another order of arrival: some come up to 2,000 places late."""
    late = F.col("seq") + F.pmod(F.col("seq") * 7919, F.lit(50)) * 40
    return events.withColumn("seq", late * 1_000_003 + F.col("seq"))


def gpu_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as job_name",
        "'u' || cast(o_custkey as string) as user",
        "case o_orderstatus when 'F' then 'Failed' when 'O' then 'Terminated' else 'Running' end as status",
        "cast(unix_timestamp(cast(o_orderdate as timestamp)) as double) as start_time",
        "o_orderkey as seq",
    )


def gpu_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) as job_name",
        "'task' || cast(l_linenumber as string) as task_name",
        "l_quantity as inst_num",
        "l_extendedprice/100 as plan_cpu",
        "l_tax*100 as plan_mem",
        "l_discount*1000 as plan_gpu",
        "cast(unix_timestamp(cast(l_shipdate as timestamp)) as double) as start_time",
    )


def borg_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Instance rows made from `lineitem`; the row number is made of its key."""
    return dealt(table(spark, folder, "lineitem")).selectExpr(
        "l_orderkey * 10 + l_linenumber as seq",
        "cast(l_orderkey as string) as collection_id",
        "cast(l_linenumber as string) as instance_index",
        "case l_returnflag when 'R' then '1' when 'A' then 'false' else 'unknown' end as failed",
        """'{''cpus'': ' || cast(cast(round(l_discount*100) as int) as string) || ', ''memory'': '
           || case when l_linenumber = 3 then 'None'
                   else cast(cast(round(l_tax*100) as int) as string) end || '}' as resource_request""",
        """'{''cpus'': ' || cast(l_linenumber as string) || ', ''memory'': '
           || cast(cast(l_quantity as int) % 12 as string) || '}' as random_sample_usage""",
        "l_extendedprice/100000 as assigned_memory",
        "l_orderkey % 4 as scheduling_class",
        "l_partkey % 12 as priority",
    )


def etl_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as order_id",
        "cast(o_custkey as string) as customer_id",
        "o_orderdate as order_date",
        "round(o_totalprice-50000,2) as amount",
        """case o_orderpriority when '1-URGENT' then 'usd' when '2-HIGH' then 'EUR'
               when '3-MEDIUM' then 'GBP' when '4-NOT SPECIFIED' then 'NGN' else null end as currency""",
        "o_orderstatus as status",
        "o_orderkey as seq",
    )


def app_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text lines made from `events`; a third has no bracketed level."""
    return dealt(table(spark, folder, "events")).selectExpr(
        "event_id as seq",
        "user_id",
        "ts",
        """case when event_id % 3 = 0 then
             case event_type when 'error' then 'Timeout while loading records'
                  when 'signup' then 'Slow transform observed; retry window is close'
                  when 'view' then 'Panic: abort requested' else 'Read partition with records' end
           else '[' || case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING'
                  when 'view' then 'DEBUG' else 'INFO' end || '] '
                || case event_type when 'error' then 'Load' when 'signup' then 'Transform'
                  when 'view' then 'Archive' when 'click' then 'Extract' else 'Validate' end
                || ' - step finished' end as line""",
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled scores with ties."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        ((F.col("value") + 1) / F.lit(600.0)).alias("prob"),
    )


def resource_samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "user_id as session_id", "event_id as seq", "ts",
        "value/4 as cpu_percent", "value*2 as memory_rss_mb", "100-value/10 as disk_used_percent",
    )
