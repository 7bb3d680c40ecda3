"""Parsing rules and edge cases."""

from pyspark.sql import functions as F

from logrisk.functions import text
from logrisk.functions.casts import label_flag, resource_struct, rounded, safe_double, safe_int


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_parse(lines):
    rows = text.parse_lines(lines([
        "  081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-16 src blk_-16 to blk_7 \n",
        "081109 203518 143 WARN a:b: one: two",
        "081109 203518 x INFO c: no pid",
        "81109 203518 1 INFO c: short date",
        "081109 203518 1 INFO c: ",
        "",
    ])).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 1]
    assert rows[0]["block_ids"] == ["blk_-16", "blk_7"]
    assert rows[0]["component"] == "dfs.DataNode$DataXceiver"
    assert rows[0]["content"].endswith("blk_7")
    assert (rows[1]["component"], rows[1]["content"], rows[1]["block_ids"]) == ("a:b", "one: two", [])


def test_bad_date_is_null(spark):
    df = spark.createDataFrame([("081332", "256199"), ("081109", "203518")], "d string, t string")
    out = [r[0] for r in df.select(text.line_seconds(F.col("d"), F.col("t"))).collect()]
    assert out == [None, 1226262918]


def test_levels(spark):
    values = ["[warning] x", "[Fatal] fine", "Panic: abort", "Timeout", "slow write", "all good", "[TRACE] retry"]
    assert column(spark, values, text.detect_level) == ["WARN", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "WARN"]


def test_stages(spark):
    values = ["[INFO] archive - x", "loading REPORT", "extract then load", "[info] lower", "nothing"]
    assert column(spark, values, text.detect_stage) == ["Archive", "Load", "Extract", "External", "External"]


def test_component_stage(spark):
    values = ["dfs.BlockManager", "pipeline.Committer", "dfs.DataNode$DataXceiver", "x"]
    assert column(spark, values, text.component_stage) == ["Load", "Commit", "Extract", "Monitor"]


def test_casts(spark):
    values = ["1.9", " -1.9 ", "", None, "x", "nan", "1e3"]
    assert column(spark, values, safe_int) == [1, -1, 0, 0, 0, 0, 1000]
    assert column(spark, ["1.5", "y", None], safe_double) == [1.5, 0.0, 0.0]
    assert column(spark, ["TRUE", " no", "maybe", None, "1.0"], label_flag) == [1, 0, None, None, 1]


def test_resource_text(spark):
    values = ["{'cpus': 0.5, 'memory': None}", "None", "garbage", None, '{"cpus": 2}']
    got = column(spark, values, lambda c: safe_double(resource_struct(c)["cpus"]))
    assert got == [0.5, 0.0, 0.0, 0.0, 2.0]


def test_rounding_is_exact(spark):
    """Decimal rounding of the binary value, as Python does it."""
    import random

    rng = random.Random(3)
    values = [1 / 32, 3 / 32, 2.675, 0.08045, 0.00725, -0.08045, 0.125, 1.005, 0.0]
    values += [rng.randrange(10**7) / 400 for _ in range(2000)] + [rng.random() for _ in range(500)]
    for digits in (2, 4, 6):
        got = column(spark, values, lambda c: rounded(c, digits), "double")
        assert got == [round(v, digits) for v in values]


def test_normalise(spark):
    df = spark.createDataFrame([
        (1, 42, "[ERROR] Load - failed"),
        (2, 42, "081109 203518 143 WARN pipeline.Loader: Loading blk_5"),
        (3, 42, "081109 203518 143 WARN pipeline.Loader: no process"),
    ], "seq int, pid long, line string")
    rows = text.normalise_lines(df, "line", "pid", F.lit("260101 000000")).orderBy("seq").collect()
    assert rows[0]["normalized_line"] == (
        "260101 000000 42 ERROR external.Load: Load stage event for blk_-9900000042: [ERROR] Load - failed")
    assert (rows[1]["process_id"], rows[1]["normalized_line"], rows[1]["stage"]) == (
        "blk_5", "081109 203518 143 WARN pipeline.Loader: Loading blk_5", "Load")
    assert rows[2]["process_id"] == "blk_-9900000042"
