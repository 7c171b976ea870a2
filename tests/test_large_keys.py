"""Heavy keys, positions, stored blocks, draws and descriptions: what must hold whatever the skew."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from admitflow.operators import joins, profile, sampling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_keys_are_split_into_fair_parts(spark):
    """Half of all rows have one key; no part of it gets much more than its share, repeats among them."""
    left = spark.range(0, 20_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(7).alias("same"))
    right = spark.range(0, 3_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    heavy = {r.k: r.p for r in joins.heavy_keys(left, ["k"], "p", 500).collect()}
    assert heavy == {0: 20}
    assert {r.k: r.p for r in joins.heavy_keys(right, ["k"], "p", 500).collect()} == {0: 2}
    assert joins.heavy_keys(left, ["k"], "p", 50_000).count() == 0
    got = joins.split_join(left, right, ["k"], F.col("r") % 7 == 0, least=500)
    want = left.join(right.where("r % 7 = 0"), "k").groupBy("k").count()
    assert {tuple(r) for r in got.groupBy("k").count().collect()} == {tuple(r) for r in want.collect()}
    assert got.columns == ["k", "same", "r"]


@pytest.mark.parametrize("seed", range(3))
def test_split_join_pairs_each_row_once(spark, seed):
    draw = random.Random(seed)
    keys = [0] * 30 + [1] * 20 + list(range(2, 8)) + [None]
    one = [(draw.choice(keys), i % 50) for i in range(200)]
    two = [(draw.choice(keys), i) for i in range(150)]
    left, right = spark.createDataFrame(one, "k int, a int").repartition(5), spark.createDataFrame(two, "k int, b int").repartition(3)
    want = sorted((k, a, b) for k, a in one for j, b in two if k is not None and k == j)
    for least in (1, 10, 1000):
        assert sorted(tuple(r) for r in joins.split_join(left, right, ["k"], least=least).collect()) == want


def test_positions_and_columns_side_by_side(spark):
    rows = [(v, i) for i, v in enumerate([None, 3, 3, 1, None, 2, 3])]
    df = spark.createDataFrame(rows, "v int, i int").repartition(4)
    got = {r["i"]: r["_pos"] for r in joins.positions(df, ["v"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [0, 4, 3, 5, 1, 2, 6]
    both = joins.concat_columns(df, spark.createDataFrame([(c,) for c in "ba"], "c string"), ["v"], ["c"])
    assert [(r.i, r.c) for r in both.orderBy("v", "i").collect()][:3] == [(0, "a"), (4, "b"), (3, None)]
    assert both.count() == 7
    assert joins.concat_columns(df.limit(0), df.limit(0).toDF("x", "y"), ["v"], ["x"]).count() == 0


def test_stored_blocks_join_without_a_shuffle(spark):
    blocks = [joins.store_block(spark.range(n).select("id", F.lit(n).alias(f"c{n}")), "id", "t", 4) for n in (50, 30, 20)]
    out = joins.join_blocks(blocks[0], blocks[1:], "id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(out)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert {(r.c30, r.c20) for r in out.where("id in (10, 25, 40)").collect()} == {(30, 20), (30, 0), (0, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_draws_have_exact_totals_and_even_chances(spark):
    """Copies of the rows of a class follow an even multinomial: chi-squared of 400 cells, and their variance over seeds."""
    rows = spark.range(0, 500, numPartitions=5).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    totals = {0: 40_000, 1: 300}
    drawn = sampling.draw_rows(rows, "y", totals, 3).toPandas()
    assert drawn.groupby("y").size().to_dict() == totals
    assert not drawn.duplicated(["id", "draw"]).any()
    counts = drawn[drawn.y == 0].groupby("id").size().reindex([i for i in range(500) if i % 5]).fillna(0)
    chi = ((counts - 100) ** 2 / 100).sum()
    assert abs(chi - 399) < 4 * math.sqrt(2 * 399)
    # Totals of the files vary as a multinomial's do; equal shares would give no variance.
    per_file = counts.groupby(counts.index // 100).sum()
    assert 0 < ((per_file - 8000) ** 2 / 8000).sum() < 25
    again = sampling.draw_rows(rows, "y", totals, 3).toPandas()
    pd.testing.assert_frame_equal(drawn.sort_values(["id", "draw"], ignore_index=True), again.sort_values(["id", "draw"], ignore_index=True))
    assert len(sampling.draw_rows(rows, "y", totals, 4).toPandas().merge(drawn, on=["id", "draw"])) < len(drawn)


def test_draws_move_no_rows(spark):
    """After the counts: a scan, a join with the few totals, and the draws."""
    drawn = sampling.draw_rows(spark.range(100).select("id", F.lit("a").alias("y")), "y", {"a": 70}, 1)
    text = plan_of(drawn)
    assert text.count("Exchange") == text.count("BroadcastExchange") and "SortMergeJoin" not in text
    assert drawn.count() == 70


def test_draws_from_nothing(spark):
    none = spark.range(0).select("id", F.lit(1).alias("y"))
    assert sampling.draw_rows(none, "y", {}, 1).count() == 0
    assert sampling.draw_counts([("s", 1, 5)], {1: 0}, 1) == [("s", 1, 5, 0)]
    with pytest.raises(ValueError):
        sampling.draw_rows(spark.range(3).select("id", F.lit(0).alias("y")), "y", {1: 2}, 1)


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_describe_is_exact(spark, accuracy):
    """Also where the sketch is coarse, values repeat, or a column is empty."""
    draw = np.random.default_rng(4)
    frame = pd.DataFrame({"a": draw.normal(size=3000), "b": draw.integers(0, 4, 3000).astype(float), "c.d": draw.exponential(size=3000)})
    frame.loc[::3, "c.d"] = np.nan
    df = spark.createDataFrame(frame.assign(e=None).astype(object).where(frame.assign(e=None).notna(), None), "a double, b double, `c.d` double, e double").repartition(6)
    got = {r["column"]: r for r in profile.describe_columns(df, ["a", "b", "c.d", "e"], accuracy).collect()}
    for c in ("a", "b", "c.d"):
        v = frame[c].dropna()
        assert got[c]["count"] == len(v) and got[c]["min"] == v.min() and got[c]["max"] == v.max()
        assert got[c]["mean"] == pytest.approx(v.mean()) and got[c]["std"] == pytest.approx(statistics.stdev(v))
        for name, p in profile.DESCRIBE_PROBS.items():
            assert got[c][name] == pytest.approx(v.quantile(p), rel=1e-12, abs=1e-12)
    assert got["e"]["count"] == 0 and got["e"]["p50"] is None and got["e"]["min"] is None


def test_describe_opens_a_bracket_that_misses(spark, monkeypatch):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("a"))
    plain, asked = profile._selected, []

    def narrow(df, columns, brackets, ranks):
        asked.append(dict(brackets))
        return plain(df, columns, {k: (3.0, 3.5) for k in brackets} if len(asked) == 1 else brackets, ranks)

    monkeypatch.setattr(profile, "_selected", narrow)
    row = profile.describe_columns(df, ["a"]).first()
    assert (row.p25, row.p50, row.p99) == (26.0, 51.0, 100.0) and len(asked) == 2


def test_first_n_is_the_sorted_prefix(spark):
    draw = random.Random(0)
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice([None, "a", "b"]), draw.choice([0.5, float("nan"), None])) for _ in range(60)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(5)
    key = lambda r: tuple((v is not None, isinstance(v, float) and v != v, 0 if v is None or v != v else v) for v in r)
    whole = sorted(map(key, rows))
    for n in (0, 33, 200):
        got = sampling.first_n(df, n, "a")
        assert sorted(key(tuple(r)) for r in got.collect()) == whole[:n]
        assert "TakeOrdered" not in plan_of(got) and got.columns == df.columns


def test_first_n_of_repeated_rows(spark):
    """A third of all rows and more are one row; some of its copies are wanted."""
    df = spark.range(0, 900, numPartitions=6).select(F.lit(5).alias("a"), F.lit("x").alias("b"))
    assert sampling.first_n(df, 400, "a").count() == 400
    assert sampling.first_n(df.limit(0), 3, "a").count() == 0


def test_without_heavy_keys_nothing_is_counted_by_key(spark, small):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.lit(None).cast("int").alias("z"))
    assert joins.may_be_heavy(rows.withColumn("k", F.lit(1)), ["k"], 500)
    assert not joins.may_be_heavy(rows, ["k"], 500) and not joins.may_be_heavy(rows.limit(0), ["k"], 0)
    assert "count(1)" not in plan_of(__spark_entry__.queries()["join_lookback_interval"](spark, small))
