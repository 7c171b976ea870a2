"""Properties on whole frames, among them one key that holds a third of the rows."""

import bisect
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.operators import evaluate, events, joins, sampling, totals


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 3000).select("id", F.when(F.col("id") % 10 < 3, 1).otherwise(0).alias("y"))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to subject 0."""
    h = F.hash("id")
    return spark.range(0, 6000).select(
        F.col("id").alias("hadm_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(h, F.lit(500)) + 1).cast("long").alias("subject_id"),
        (F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")) + F.make_dt_interval(F.pmod(F.hash("id", F.lit(7)), F.lit(1500)))).alias("admittime"),
        F.round(F.rand(3) * 50, 1).alias("x"),
    ).cache()


@pytest.mark.parametrize("test, validation", [(0.3, 0.1), (0.01, 0.29), (0.0, 0.5), (1.0, 0.0)])
def test_split_exact(rows, test, validation):
    got = Counter(r.split for r in sampling.split_exact(rows, "id", 5, test, validation).collect())
    assert got["test"] == int(test * 3000) and got["validation"] == int(validation * 3000) and sum(got.values()) == 3000


def test_tiny_and_empty_frames(rows):
    two = rows.where("id < 2")
    assert {r.split for r in sampling.split_exact(two, "id", 5, 0.3, 0.1).collect()} == {"train"}
    none = rows.where("id < 0")
    for out in (
        sampling.split_exact(none, "id", 5, 0.3, 0.1), sampling.split_stratified(none, "id", "y", 5, 0.1),
        sampling.ratio_sample(none, "id", "y", 5, 3.0), sampling.oversample_minority(none, "id", "y", 5),
        sampling.undersample_majority(none, "id", "y", 5), sampling.kfold_assign(none, "id", "y", 5, 3),
    ):
        assert out.count() == 0


def test_stratified_and_folds(rows):
    split = sampling.split_stratified(rows, "id", "y", 5, 0.1)
    assert Counter((r.y, r.split) for r in split.collect()) == {(0, "test"): 210, (0, "train"): 1890, (1, "test"): 90, (1, "train"): 810}
    folds = Counter((r.y, r.fold) for r in sampling.kfold_assign(rows, "id", "y", 5, 7).collect())
    assert {k[1] for k in folds} == set(range(7))
    for y, n in ((0, 2100), (1, 900)):
        sizes = [folds[y, i] for i in range(7)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_quota_largest_remainder():
    assert sampling.stratified_quota({0: 341, 1: 58}, 0.1) == {0: 34, 1: 6}
    assert sum(sampling.stratified_quota({"a": 1, "b": 1, "c": 1}, 0.5).values()) == 2


def test_resampling_sizes(rows):
    over = sampling.oversample_minority(rows, "id", "y", 5)
    assert Counter(r.y for r in over.collect()) == {0: 2100, 1: 2100}
    assert over.where("draw is null").count() == 3000
    under = Counter(r.y for r in sampling.undersample_majority(rows, "id", "y", 5, 0.55).collect())
    assert under == {1: 900, 0: int(900 / 0.55)}
    drawn = sampling.weighted_bootstrap(rows, "id", "y", 5)
    assert drawn.count() == 3000
    assert abs(drawn.where("y = 1").count() - 1500) < 150


def test_hash_rank_and_large_sample(rows):
    ranked = sampling.hash_rank(rows, "id", 9).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(3000))
    top = {r.id for r in ranked if r["rank"] < 500}
    assert {r.id for r in sampling.sample_n(rows, "id", 500, 9).collect()} == top
    assert "TakeOrderedAndProject" not in sampling.sample_n(rows, "id", 500, 9)._jdf.queryExecution().executedPlan().toString()
    assert sampling.sample_n(rows, "id", 5000, 9).count() == 3000


def test_quantiles_match_numpy(skewed):
    probs = {"p01": 0.01, "p33": 0.33, "p50": 0.5, "p99": 0.99}
    found = {r.subject_id: r for r in totals.quantiles(skewed, "x", probs, ["subject_id"]).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.subject_id, []).append(r.x)
    assert set(found) == set(groups)
    for subject, xs in groups.items():
        for name, p in probs.items():
            assert found[subject][name] == pytest.approx(np.quantile(xs, p))
        assert found[subject].n == len(xs)
    whole = totals.quantiles(skewed, "x", probs).first()
    assert whole.p33 == pytest.approx(np.quantile([x for xs in groups.values() for x in xs], 0.33))


def test_range_buckets_split_a_hot_group(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = totals.range_bucket(skewed.select("subject_id", "hadm_id"), "hadm_id", ["subject_id"])
        sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 6000 / 4
        assert ranged.where("subject_id = 0").select("_range").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _by_subject(skewed):
    out = {}
    for r in skewed.collect():
        out.setdefault(r.subject_id, []).append((r.admittime, r.hadm_id))
    return {s: sorted(v) for s, v in out.items()}


def test_count_before_matches_brute_force(skewed):
    import datetime as dt

    want = {}
    for rows_ in _by_subject(skewed).values():
        moments = [m for m, _ in rows_]
        for m, key in rows_:
            n = bisect.bisect_left(moments, m) - bisect.bisect_left(moments, m - dt.timedelta(days=360))
            if n:
                want[key] = n
    # In one piece per subject, and in days where a subject is heavy.
    for least in (100_000, 1000):
        assert {r.hadm_id: r.n_admits for r in events.count_before(skewed, least=least).collect()} == want


def test_count_before_shuffles_rows_once_if_no_subject_is_heavy(skewed):
    rows = skewed.select("hadm_id", "subject_id", "admittime")
    plan = events.count_before(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan
    some = events.count_before(rows).first()["hadm_id"]  # a key that repeats comes out as often as it goes in
    assert events.count_before(rows.unionByName(rows.where(F.col("hadm_id") == some))).where(F.col("hadm_id") == some).count() == 2


def test_previous_pairs_match_counts(skewed):
    population = skewed.where("hadm_id % 5 = 0").select("hadm_id")
    pairs = joins.previous_admissions(skewed, population)
    counted = {r.hadm_id: r.n for r in pairs.groupBy("hadm_id").agg(F.count_distinct("prev_hadm_id").alias("n")).collect()}
    want = {r.hadm_id: r.n_admits for r in events.count_before(skewed).join(population, "hadm_id").collect()}
    assert counted == want
    assert pairs.count() == sum(counted.values())


@pytest.mark.parametrize("hours, days", [(24, 7), (0, 0), (31, 2)])
def test_lookback_matches_brute_force(skewed, hours, days):
    import datetime as dt

    population = skewed.where("hadm_id % 40 = 3 or (subject_id = 0 and hadm_id % 200 = 0)").select(
        "subject_id", (F.col("admittime") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("index_date"), "admittime"
    )
    minutes = F.make_dt_interval(F.lit(0), F.pmod(F.hash("hadm_id", F.lit(5)), F.lit(3)) * 12)
    points = skewed.select("subject_id", F.col("hadm_id").alias("id"), (F.col("admittime") + minutes).alias("charttime"))
    spans = {}
    for r in population.collect():
        spans.setdefault(r.subject_id, []).append((r.admittime - dt.timedelta(days=days + 1), r.index_date))
    hits = {r.id: sum(a < r.charttime <= b for a, b in spans.get(r.subject_id, [])) for r in points.collect()}
    pairs = Counter(r.id for r in joins.lookback_events(points, population, days).collect())
    assert pairs == Counter({i: n for i, n in hits.items() if n})
    once = Counter(r.id for r in joins.events_in_lookback(points, population, days).collect())
    assert once == Counter({i: 1 for i, n in hits.items() if n})


def test_auc_does_not_change_under_monotone_scores(spark):
    df = spark.range(0, 4000).select(
        F.pmod(F.hash("id"), F.lit(97)).cast("double").alias("s"), (F.pmod(F.hash("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("y")
    )
    auc = evaluate.roc_auc(df, "y", "s").first()[0]
    assert evaluate.roc_auc(df.withColumn("s", F.exp(F.col("s") / 10)), "y", "s").first()[0] == pytest.approx(auc)
    pos = np.array([r.s for r in df.where("y = 1").collect()])
    neg = np.array([r.s for r in df.where("y = 0").collect()])
    brute = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)
    flipped = evaluate.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert auc + flipped == pytest.approx(1.0)


def test_curves_end_where_they_should(spark):
    df = spark.range(0, 500).select((F.col("id") % 7 / 7.0).alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    roc = evaluate.roc_points(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert (roc[0].fpr, roc[0].tpr) == (0, 0) and (roc[-1].fpr, roc[-1].tpr) == (1, 1) and len(roc) == 8
    pr = evaluate.pr_points(df, "y", "s")
    assert pr.where("threshold is null and precision = 1 and recall = 0").count() == 1
    area = sorted(((r.recall, r.precision) for r in pr.collect()), key=lambda p: (p[0], -p[1]))
    trapezoid = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(area, area[1:]))
    assert evaluate.pr_auc(df, "y", "s").first()[0] == pytest.approx(trapezoid)


def test_pivot_then_unpivot_is_identity(spark):
    from admitflow.operators import reshape

    long = spark.range(0, 200).select((F.col("id") % 40).alias("k"), (F.floor(F.col("id") / 40)).cast("string").alias("code"), (F.col("id") * 1.5).alias("v"))
    codes = reshape.vocabulary(long, "code")
    wide = reshape.pivot_values(long, "k", "code", "v", codes)
    back = wide.unpivot(["k"], codes, "code", "v").where("v is not null")
    assert back.exceptAll(long).count() == 0 and long.exceptAll(back).count() == 0


def test_a_list_of_columns_names_a_row(spark):
    """Seven rows per admission: counts are exact by (admission, time), as they are by a unique key."""
    df = spark.range(1000).select(
        F.floor(F.col("id") / 7).alias("hadm_id"), (F.col("id") % 7).alias("at"), (F.col("id") % 5 == 0).cast("int").alias("y")
    )
    key = ["hadm_id", "at"]
    split = Counter(r.split for r in sampling.split_exact(df, key, 3, 0.3, 0.1).collect())
    assert split == {"test": 300, "validation": 100, "train": 600}
    over = sampling.oversample_minority(df, key, "y", 3)
    assert Counter(r.y for r in over.collect()) == {0: 800, 1: 800}
    taken = sampling.ratio_sample(df, key, "y", 3, 3.0)
    assert Counter(r.y for r in taken.collect()) == {1: 200, 0: 600}
    again = sampling.ratio_sample(df.withColumn("y", 1 - F.col("y")), key, "y", 3, 3.0)
    assert Counter(r.y for r in again.collect()) == {1: 250, 0: 750}
    assert sampling.weighted_bootstrap(df, key, "y", 3).count() == 1000
    samples = sampling.generate_samples(df, key, "y", 3, 3.0, 0.3, 0.1)
    assert samples.where("split = 'train'").select(*key).distinct().count() == samples.where("split = 'train'").count()


def test_rank_table_without_a_top(spark):
    df = spark.range(500).select(F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") % 40 / 7.0).alias("score"))
    got = evaluate.rank_table(df, "name", "score").collect()
    want = sorted(got, key=lambda r: (-r.score, r.name))
    assert [r.name for r in sorted(got, key=lambda r: r["rank"])] == [r.name for r in want]
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def test_weighted_quantiles_are_those_of_repeated_rows(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") % 4 + 1).alias("n"))
    long = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    probs = {"a": 0.2, "b": 0.5}
    one, two = totals.quantiles(df, "x", probs, ["g"], "n").collect(), totals.quantiles(long, "x", probs, ["g"]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
