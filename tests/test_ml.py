"""Models on separable data, metrics on edge cases."""

import pytest
from pyspark.sql import functions as F

from logrisk.operators import evaluate, ml, splits
from logrisk.operators.schema import align
from logrisk.plans.monitor import monitor_batch
from test_features import FATAL, STABLE, log


@pytest.fixture(scope="module")
def samples(spark):
    """Failures have errors; four samples per group."""
    rows = spark.range(240).select(
        F.concat(F.lit("p"), "id").alias("process_id"),
        F.concat(F.lit("g"), (F.col("id") / 4).cast("int")).alias("group_id"),
        ((F.col("id") / 4).cast("int") % 3 == 0).cast("int").alias("label"),
        (F.lit(10) + F.col("id") % 5).alias("total_lines"), F.lit("hdfs").alias("source"))
    return align(rows.withColumn("error_count", F.col("label") * 4 + F.col("total_lines") % 2))


def test_no_group_on_both_sides(samples):
    train, test = ml.split(samples)
    assert train.join(test, "group_id", "left_semi").count() == 0
    assert train.count() + test.count() == 240
    assert test.select("group_id").distinct().count() == 15


def test_comparison(samples):
    ranking = ml.compare_models(samples, size=0.02, folds=2, only=(ml.BASELINE, "Decision Tree", ml.BOOSTED))
    rows = {r["model"]: r for r in ranking.collect()}
    assert rows[ml.BASELINE]["f1"] == 0.0 and rows["Decision Tree"]["f1"] == 1.0 == rows[ml.BOOSTED]["roc_auc"]
    assert all(r["tp"] + r["tn"] + r["fp"] + r["fn"] == 60 for r in rows.values())
    header = ml.comparison_header(samples, ranking, "x").first()
    assert (header["samples"], header["failures"], header["features"], header["deployed_model"]) == (240, 80, 62, ml.BOOSTED)


def test_store_and_score(spark, samples, lines, tmp_path):
    folder = str(tmp_path / "hdfs")
    ml.train_model(samples, folder, size=0.02, folds=0)
    with pytest.raises(ValueError):
        ml.StoredModel(spark, folder, "google")
    stored = ml.StoredModel(spark, folder, "hdfs")
    alerts = monitor_batch(lines(log(FATAL) + log(STABLE, "blk_2", 20)), every=10, score=stored.score, prior=stored.prior())
    by_process = {r["process_id"]: r for r in alerts.where("trigger = 'final'").collect()}
    assert by_process["blk_1"]["risk_level"] == "HIGH" and by_process["blk_2"]["risk_level"] == "LOW"
    assert stored.importances()[0][1] >= stored.importances()[-1][1]


def test_one_class(spark):
    rows = spark.createDataFrame([(1, 0.4), (1, 0.9)], "label int, prob double")
    assert evaluate.ranking_metrics(rows).first()["roc_auc"] == 0.0
    groups = splits.group_labels(rows.withColumn("group_id", F.col("prob")))
    assert not splits.can_group_split(groups).first()["allowed"]
    with pytest.raises(ValueError):
        ml.prepared(align(rows.select(F.col("prob").cast("string").alias("process_id"), "label", F.lit("hdfs").alias("source"))))


def test_auc_against_pairs(spark):
    import random

    rng = random.Random(1)
    data = [(rng.randrange(2), rng.randrange(20) / 20) for _ in range(300)]
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    rows = spark.createDataFrame(data, "label int, prob double")
    assert evaluate.ranking_metrics(rows, digits=9).first()["roc_auc"] == round(wins, 9)
    shifted = rows.withColumn("prob", F.exp("prob"))
    assert evaluate.ranking_metrics(shifted, digits=9).first()["roc_auc"] == round(wins, 9)


def test_registered_models_are_whole(spark, monkeypatch):
    from logrisk.plans import queries
    seen = []

    def fit(pipeline, _):
        seen.append(pipeline)
        raise StopIteration

    monkeypatch.setattr(queries, "_samples", lambda *_: None)
    monkeypatch.setattr(ml, "prepared", lambda _: (None, None))
    monkeypatch.setattr(ml, "compare_models", lambda _, **options: seen.append(options))
    monkeypatch.setattr(ml, "fit", fit)
    queries.model_compare(spark, "")
    for q in (queries.model_scores, queries.top_importances):
        with pytest.raises(StopIteration):
            q(spark, "")
    boosted, forest = (next(s for s in p.getStages() if hasattr(s, name)) for p, name in zip(seen[1:], ("getMaxIter", "getNumTrees")))
    assert seen[0] == {} and boosted.getMaxIter() == 300 and forest.getNumTrees() == 200


def test_partitions_of_a_fit(spark, monkeypatch):
    """A fit that runs alone uses all cores for rows that were one task, and never waits for a last wave."""
    assert [ml.partitions(n, ml.ALONE_ROWS, 12) for n in (0, 100, 12_501, 450_000, 2_700_000, 3_000_001)] == [1, 1, 2, 12, 12, 24]
    assert [ml.partitions(n, ml.PARTITION_ROWS, 12) for n in (50_000, 450_000, 2_700_000)] == [1, 5, 12]
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("process_id"))
    out = ml.compact(rows, ml.ALONE_ROWS)
    assert out.rdd.getNumPartitions() == 5 and out.count() == 60_000
    assert [r[0] for r in out.collect()] == [r[0] for r in ml.compact(rows.repartition(7), ml.ALONE_ROWS).collect()]
