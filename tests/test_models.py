"""Models and stages: row counts, probabilities, and skill on a separable label."""

import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from admitflow.operators import evaluate, learn, sampling
from admitflow.plans import baseline
from admitflow.session import run_dir
from admitflow.sources import tables

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def separable(spark):
    noise = F.pmod(F.hash("id"), F.lit(100)) / 100
    y = (F.col("id") % 4 == 0).cast("int")
    return spark.range(0, 800).select("id", y.alias("y"), (y * 0.8 + noise).alias("a"), noise.alias("b")).cache()


FEATURES = ["a", "b"]


def test_baseline_run(separable):
    make = lambda: learn.forest(trees=5, depth=4, features=2)
    out = baseline.run(separable, "id", "y", FEATURES, make, folds=2)
    assert out.scored.count() == 80
    low, high = out.scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    assert evaluate.roc_auc(out.scored, "y", "score").first()[0] > 0.8
    assert {(r.training_set, r.y): r["count"] for r in out.balance.collect()} == {
        ("original", 0): 540, ("original", 1): 180, ("oversampled", 0): 540, ("oversampled", 1): 540,
    }
    assert out.folds.count() == 2 and out.report.count() == 5 and out.confusion.count() == 1
    assert out.roc.count() == out.pr.count()


def test_boosted_and_perceptron(separable):
    for estimator in (learn.boosted(rounds=3), learn.perceptron(2, [4, 4], 30)):
        scored = learn.score(learn.fit(separable, FEATURES, estimator), separable, "id")
        assert scored.count() == 800
        assert evaluate.roc_auc(scored, "y", "score").first()[0] > 0.7


def test_perceptron_learns_from_large_numbers(separable):
    far = separable.select("id", "y", (F.col("a") * 1e6 + 5e6).alias("a"), (F.col("b") * 1e-3).alias("b"))
    model = learn.fit(far, FEATURES, learn.perceptron(2, [4, 4], 30))
    assert evaluate.roc_auc(learn.score(model, far, "id"), "y", "score").first()[0] > 0.9


def test_multilabel_report_reads_scores_once(spark):
    made = spark.sparkContext.accumulator(0)

    def scored(rows):
        for row in rows:
            made.add(1)
            yield row

    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i, [i % 2, 1], [1, i % 3 // 2]) for i in range(30)], 2).mapPartitions(scored), "id long, y array<int>, p array<int>")
    got = {r.label_id: (r.support, r.accuracy, r.recall) for r in evaluate.multilabel_report(rows, "y", "p", "id").collect()}
    assert got == {0: (15, 0.5, 1.0), 1: (30, 1 / 3, 1 / 3)}
    assert made.value == 30


def test_folds_are_numbered_before_resampling(separable):
    numbered = sampling.kfold_assign(separable, "id", "y", 1, 3)
    over = sampling.oversample_minority(numbered.where("fold != 0"), "id", "y", 1)
    held = numbered.where("fold = 0").select("id")
    assert over.join(held, "id").count() == 0


def files_of(df):
    return sorted(df.inputFiles())


def test_stage_is_reused_for_the_same_plan_only(spark):
    first = tables.stage(spark, "reuse", lambda: spark.range(5).select("id"), reuse=True)
    again = tables.stage(spark, "reuse", lambda: spark.range(5).select("id"), reuse=True)
    other = tables.stage(spark, "reuse", lambda: spark.range(77).select("id"), reuse=True)
    assert files_of(first) == files_of(again) != files_of(other)
    assert (again.count(), other.count()) == (5, 77)


def test_stage_without_success_mark_is_not_reused(spark):
    def build():
        return spark.range(6).select("id")

    def here():  # rows from the driver: reused in this application only
        return spark.createDataFrame([(i,) for i in range(6)], "id long")

    first = tables.stage(spark, "half", build, reuse=True)
    rows = files_of(first)[0].rpartition("/")[0]
    own = f"{rows.rpartition('/')[0].rpartition('/')[0]}/{'0' * 32}/rows"  # another's, begun before
    tables.forget_stages(spark, "half")
    spark.range(2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(own)
    assert tables.stage(spark, "half", build, reuse=True).count() == 6
    half = f"{run_dir(spark)}/half-{tables.fingerprint(here())}"
    spark.range(2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    assert tables.lasting_fingerprint(here()) is None
    assert tables.stage(spark, "half", here, reuse=True).count() == 6


def test_stage_built_twice_keeps_earlier_readers(spark):
    first = tables.stage(spark, "twice", lambda: spark.range(3))
    second = tables.stage(spark, "twice", lambda: spark.range(4))
    assert (first.count(), second.count()) == (3, 4)


def test_every_query_here_has_sql():
    assert {n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"} == set()


def test_points_of_a_curve_are_fitted_at_once(separable, monkeypatch):
    fit, meet = learn.fit, threading.Barrier(2, timeout=60)

    def together(*given):
        meet.wait()  # breaks if a fit waits for the end of another
        return fit(*given)

    monkeypatch.setattr(learn, "fit", together)
    make = lambda n: learn.forest(trees=3, depth=3, features=n)
    curve = learn.validation_curve(separable, FEATURES, "id", make, [1, 2], 5, folds=2, parallelism=2).collect()
    assert {(r.value, r.fold) for r in curve} == {(v, f) for v in "12" for f in (0, 1)}
    assert all(0.8 < r.train_score <= 1 and 0.8 < r.test_score <= 1 for r in curve)
