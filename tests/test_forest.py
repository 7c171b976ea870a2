"""Forests grown branch by branch: the best splits, Spark's forest beside them, and the same trees wherever they are grown."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from admitflow.operators import evaluate, forest, learn

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    noise = lambda i: F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) / 1000
    rows = spark.range(6000).select("id", noise(1).alias("a"), (F.pmod(F.hash("id", F.lit(2)), F.lit(5))).alias("b"), noise(3).alias("c"), noise(4).alias("d"))
    return rows.withColumn("y", (F.col("a") + F.col("b") / 5 + 0.4 * F.col("d") > 1.3).cast("int")).cache()


def gini(y, w):
    total = w.sum()
    return 1 - sum((w[y == c].sum() / total) ** 2 for c in (0, 1)) if total else 0.0


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    cuts = [np.arange(4) + 0.5, np.arange(2) + 0.5, np.array([])]
    plan = forest.Plan(1, 1, 3, 0.9, 2, 1, np.array([1.0, 2.5]), cuts)
    for _ in range(20):
        n = 40
        codes, y, drawn = np.stack([rng.integers(0, len(c) + 1, n) for c in cuts]).astype(np.uint8), rng.integers(0, 2, n), rng.integers(1, 4, n).astype(float)
        got = forest.grow(plan, 0, 1, codes, y, drawn).set_index("node")
        w, best = drawn * plan.weights[y], 0.0
        for f, cut in itertools.chain(*([(f, i) for i in range(len(c))] for f, c in enumerate(cuts))):
            low = codes[f] <= cut
            if min(drawn[low].sum(), drawn[~low].sum()) >= 2:
                gain = gini(y, w) - sum(w[s].sum() / w.sum() * gini(y[s], w[s]) for s in (low, ~low))
                best = max(best, gain)
        if got.loc[1, "feature"] >= 0:
            assert got.loc[1, "gain"] == pytest.approx(best) and len(got) == 3 and got.loc[2:, "n"].sum() == drawn.sum()
        else:  # no gain, or both sides say the same
            assert len(got) == 1
        assert got.loc[1, ["w0", "w1"]].tolist() == pytest.approx([w[y == 0].sum(), w[y == 1].sum()])


def test_trees_do_not_depend_on_where_they_are_grown(planted, monkeypatch):
    """Split by summed statistics down to small branches, or each grown by one task: every tree says the same of every row."""
    make = lambda: learn.forest(trees=6, depth=7, features=2, seed=5)
    whole = learn.fit(planted, FEATURES, make()).stages[-1]
    monkeypatch.setattr(forest, "BRANCH", 400)
    parts = learn.fit(planted, FEATURES, make()).stages[-1]
    rows = [r.features for r in learn.PipelineModel(learn._assembly(FEATURES)).transform(planted.limit(300)).select("features").collect()]
    assert parts.totalNumNodes >= whole.totalNumNodes > 60
    for one, two in zip(whole.trees, parts.trees):
        assert [one.predict(v) for v in rows] == [two.predict(v) for v in rows]
        assert max(one.depth, two.depth) <= 7


def test_as_good_as_sparks(planted):
    train, test = planted.where("id % 4 <> 0"), planted.where("id % 4 = 0")
    made = learn.forest(trees=20, depth=8, features="all", seed=2)
    spark_made = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=8, featureSubsetStrategy="all", subsamplingRate=0.9, minInstancesPerNode=2, seed=2, weightCol="weight")
    one, two = (learn.fit(train, FEATURES, e) for e in (made, spark_made))
    area = [evaluate.roc_auc(learn.score(m, test, "id"), "y", "score").first()[0] for m in (one, two)]
    assert area[0] == pytest.approx(area[1], abs=0.01) and area[0] > 0.9
    shares = [m.stages[-1].featureImportances.toArray() for m in (one, two)]
    assert shares[0] == pytest.approx(shares[1], abs=0.06) and one.stages[-1].getNumTrees == 20


def test_few_rows_and_one_class(spark):
    few = spark.createDataFrame([(0, 0.0, 0), (1, 1.0, 1)], "id long, a double, y int")
    assert learn.score(learn.fit(few, ["a"], learn.forest(trees=12, depth=3, features="all")), few, "id").where("score between 0 and 1").count() == 2
    alone = few.where("y = 0")
    assert learn.score(learn.fit(alone, ["a"], learn.forest(trees=2, depth=3, features="all", weighted=False)), alone, "id").first().prediction == 0


@pytest.mark.parametrize("share", [0.9, 0.3, 1.0])
def test_draws_are_poisson_and_come_from_bits(share):
    """Chi-squared of the draws; they are settled by 16 bits, but for a few values."""
    table, n = forest.draw_table(share), 400_000
    assert (table[0] == 255).sum() < 12
    got = np.bincount(forest.draws(np.random.default_rng(7), table, n), minlength=12)[:6]
    want = n * np.exp(-share) * np.cumprod([1.0, *(share / k for k in range(1, 6))])
    assert ((got - want) ** 2 / want).sum() < 25
    edge = table[0].copy()
    edge[:] = 255  # every draw by its further bits
    assert np.bincount(forest.draws(np.random.default_rng(8), (edge, table[1]), n), minlength=12)[:6] == pytest.approx(want, rel=0.15, abs=40)


def test_a_row_goes_where_its_path_leads():
    """Nodes of rows by one table look-up a level, against the tree read row by row; leaves hold their rows."""
    rng = np.random.default_rng(1)
    top = forest.Top(rng.integers(-1, 3, (2, 16)), rng.integers(0, 4, (2, 16)), np.zeros((2, 16), bool), 3)
    codes = rng.integers(0, 5, (200, 4)).astype(np.uint8)
    for tree in (0, 1):
        for row, node in zip(codes, top.nodes_of(codes, tree)):
            at = 1
            for _ in range(3):
                f = top.feature[tree, at]
                at = at if f < 0 else 2 * at + int(row[f] > top.bin[tree, at])
            assert at == node


def test_rows_of_the_last_level_are_not_brought_together(planted, monkeypatch):
    """A shallow tree's leaves may hold most of a table: they come from the sums, and say what they say when grown from rows."""
    make = lambda: learn.forest(trees=4, depth=2, features="all", seed=3)
    whole = learn.fit(planted, FEATURES, make()).stages[-1]
    monkeypatch.setattr(forest, "BRANCH", 1)
    monkeypatch.setattr(forest, "_branches", lambda *given: pytest.fail("rows are dealt to leaves"))
    parts = learn.fit(planted, FEATURES, make()).stages[-1]
    rows = [r.features for r in learn.PipelineModel(learn._assembly(FEATURES)).transform(planted.limit(200)).select("features").collect()]
    for one, two in zip(whole.trees, parts.trees):
        assert two.depth == 2 and [one.predictProbability(v).toArray().argmax() for v in rows] == [two.predictProbability(v).toArray().argmax() for v in rows]
    assert [parts.predict(v) for v in rows] == [whole.predict(v) for v in rows]
