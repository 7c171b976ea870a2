"""Perceptrons over blocks: the gradient, the minimum, nets side by side, and frames that are left to Spark."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from admitflow.operators import evaluate, learn, perceptron
from admitflow.presets import clinical
from workload import learning

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def planted(spark):
    noise = lambda i: F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) / 1000
    rows = spark.range(5000).select("id", noise(1).alias("a"), (noise(2) * 100).alias("b"))
    return rows.withColumns({"y": (F.col("a") + F.col("b") / 100 > 1).cast("int"), "z": (F.col("a") > 0.7).cast("int")}).cache()


def test_the_gradient_is_that_of_the_loss():
    rng, layers = np.random.default_rng(0), [3, 5, 4, 2]
    x, y, flat = rng.normal(size=(40, 3)), rng.integers(0, 2, 40), perceptron.start_of(layers, 1)
    gradient = perceptron.loss_and_gradient(layers, flat, x, y)[1]
    each = [(perceptron.loss_and_gradient(layers, flat + e, x, y)[0] - perceptron.loss_and_gradient(layers, flat - e, x, y)[0]) / 2e-6 for e in np.eye(len(flat)) * 1e-6]
    assert gradient == pytest.approx(each, abs=1e-6)


def test_the_minimum_is_found():
    steps = perceptron.minimize(np.array([-1.2, 1.0]), 100, 0.0)
    at = next(steps)
    while True:
        a, b = at
        try:
            at = steps.send(((1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])))
        except StopIteration as end:
            assert end.value == pytest.approx([1.0, 1.0], abs=1e-5)
            return


def test_sums_by_piece_and_nets_side_by_side_change_nothing(planted, monkeypatch):
    make = lambda nodes, label: learn.perceptron(2, nodes, 8, label=label)
    alone = [learn.fit(planted, FEATURES, make(nodes, label)).stages[-1] for nodes, label in (([5], "y"), ([4, 3], "z"))]
    monkeypatch.setattr(perceptron, "SENT", 0)
    monkeypatch.setattr(perceptron, "PIECE", 7)
    monkeypatch.setattr(perceptron, "BLOCK", 600)
    both = learn.fit_perceptrons(planted, FEATURES, [make([5], "y"), make([4, 3], "z")])
    for one, other in zip(alone, both):
        assert isinstance(other.stages[-1], type(one)) and other.stages[-1].getMaxIter() == 8
        assert other.stages[-1].weights.toArray() == pytest.approx(one.weights.toArray(), rel=0.02, abs=0.02)


def test_as_good_as_sparks(planted):
    ours = learn.perceptron(2, [6, 4], 40)
    sparks = MultilayerPerceptronClassifier(featuresCol=learn.SCALED, labelCol="y", layers=[2, 6, 4, 2], maxIter=40, seed=42)
    area = [evaluate.roc_auc(learn.score(learn.fit(planted, FEATURES, e), planted, "id"), "y", "score").first()[0] for e in (ours, sparks)]
    assert area[0] > 0.99 and area[0] > area[1] - 0.01


def test_labels_that_are_no_classes_are_left_to_spark(planted):
    with pytest.raises(Exception):
        learn.fit(planted.withColumn("y", F.col("y") + 0.5), FEATURES, learn.perceptron(2, [3], 2))


def test_the_grid_has_the_studys_widths(monkeypatch):
    asked = []
    monkeypatch.setattr(learning, "_split", lambda t: (None, None))
    monkeypatch.setattr(learn, "grid_sweep", lambda *given, **named: asked.extend(given[4]))
    with pytest.raises(AttributeError):
        learning.grid_sweep(None)
    assert asked == clinical.LAYER_GRID
