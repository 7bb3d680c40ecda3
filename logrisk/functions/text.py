"""Parsing and normalising of log text, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.config import (
    BLOCK_PATTERN, COMPONENT_STAGES, LEVEL_KEYWORDS, LINE_PATTERN, STAGE_NAMES, STOP_MARKER,
)

BLANKS = " \t\n\r\f\v"


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any word is a plain substring (byte search, cheaper than one pattern)."""
    return reduce(or_, [text.contains(word) for word in words])


def parse_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """Six fields and the block ids; lines of another form are dropped.

    One pattern check and one split per line: the split is shared by the six
    fields, which is cheaper than six group extractions.
    """
    parts = F.split(F.btrim(F.col(value), F.lit(BLANKS)), r"\s+", 6)
    others = [c for c in raw.columns if c != value]
    content = parts[5]
    return raw.where(F.col(value).rlike(LINE_PATTERN)).select(
        *others,
        parts[0].alias("date"),
        parts[1].alias("time"),
        parts[2].alias("pid"),
        parts[3].alias("level"),
        _without_colon(parts[4]).alias("component"),
        content.alias("content"),
        F.array_distinct(F.regexp_extract_all(content, F.lit(BLOCK_PATTERN), 1)).alias("block_ids"),
    )


def _without_colon(token: Column) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - 1)


def explode_blocks(parsed: DataFrame) -> DataFrame:
    """One row per line and block it names; lines without a block vanish.

    The outer form plus a NULL filter: for the plain form the optimizer adds a
    size check below the projection, which parses every line a second time.
    """
    others = [c for c in parsed.columns if c != "block_ids"]
    named = parsed.select(*others, F.explode_outer("block_ids").alias("process_id"))
    return named.where(F.col("process_id").isNotNull())


def line_seconds(date, clock) -> Column:
    """Epoch seconds of `yymmdd` and `HHMMSS`; NULL when they name no real time."""
    return F.unix_seconds(F.try_to_timestamp(F.concat(date, clock), F.lit("yyMMddHHmmss")))


def line_stamp(ts) -> Column:
    return F.date_format(ts, "yyMMdd HHmmss")


def block_name(prefix: str, number, digits: int = 9) -> Column:
    """`blk_` + prefix + number padded with zeros to at least `digits` digits."""
    return F.concat(F.lit(f"blk_{prefix}"), F.format_string(f"%0{digits}d", number))


def format_line(stamp, pid, level, component, message) -> Column:
    return F.concat(
        stamp, F.lit(" "), pid.cast("string"), F.lit(" "), level, F.lit(" "),
        component, F.lit(": "), message,
    )


def is_stop_marker(value) -> Column:
    return F.coalesce(F.col(value).contains(STOP_MARKER), F.lit(False))


def detect_level(text: Column) -> Column:
    """A bracketed level wins; otherwise the first keyword group; otherwise INFO."""
    bracket = F.upper(F.regexp_extract(text, r"(?i)\[(FATAL|ERROR|WARN|WARNING|INFO|DEBUG)\]", 1))
    lowered = F.lower(text)
    found = F.when(bracket == "WARNING", "WARN").when(bracket != "", bracket)
    for level, words in LEVEL_KEYWORDS.items():
        found = found.when(contains_any(lowered, words), level)
    return found.otherwise("INFO")


def detect_stage(text: Column) -> Column:
    """First known stage name inside the text, else the word after a bracketed level."""
    lowered = F.lower(text)
    word = F.regexp_extract(text, r"\[(?:INFO|WARN|WARNING|ERROR|FATAL|DEBUG)\]\s+([A-Za-z_]+)", 1)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))
    found = None
    for stage in STAGE_NAMES:
        hit = lowered.contains(stage.lower())
        found = F.when(hit, stage) if found is None else found.when(hit, stage)
    return found.when(word != "", capital).otherwise("External")


def component_stage(component) -> Column:
    component = F.col(component) if isinstance(component, str) else component
    found = None
    for stage, words in COMPONENT_STAGES:
        hit = contains_any(component, words)
        found = F.when(hit, stage) if found is None else found.when(hit, stage)
    return found.otherwise("Monitor")


def normalise_lines(lines: DataFrame, value: str, pid: str, stamp: Column) -> DataFrame:
    """Adds level, stage, component, process_id and normalized_line to free-text lines.

    Lines already in the log format that name a block pass unchanged. All other
    lines of a run share one process id made from the run's `pid`.
    """
    text = F.regexp_replace(F.col(value), r"\n+$", "")
    parts = F.split(F.btrim(text, F.lit(BLANKS)), r"\s+", 6)
    blocks = F.regexp_extract(F.get(parts, F.lit(5)), BLOCK_PATTERN, 1)
    ready = F.coalesce(text.rlike(LINE_PATTERN) & (blocks != ""), F.lit(False))
    level = F.when(ready, F.upper(F.get(parts, F.lit(3)))).otherwise(detect_level(text))
    stage = detect_stage(F.when(ready, F.get(parts, F.lit(5))).otherwise(text))
    own = block_name("-99", F.col(pid), 8)
    tagged = (
        lines.withColumn("_text", text)
        .withColumn("_ready", ready)
        .withColumn("level", level)
        .withColumn("stage", stage)
        .withColumn("component", F.when(ready, _without_colon(F.get(parts, F.lit(4))))
                    .otherwise(F.concat(F.lit("external."), stage)))
        .withColumn("process_id", F.when(ready, blocks).otherwise(own))
    )
    message = F.concat(
        F.col("stage"), F.lit(" stage event for "), F.col("process_id"), F.lit(": "), F.col("_text"))
    built = format_line(stamp, F.col(pid), F.col("level"), F.col("component"), message)
    return tagged.withColumn(
        "normalized_line", F.when(F.col("_ready"), F.col("_text")).otherwise(built)
    ).drop("_text", "_ready")
