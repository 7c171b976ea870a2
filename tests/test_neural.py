"""Nets trained by replicas: gradients, plain mini-batch training, independence of partitions, and what they learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.operators import evaluate, learn, neural
from admitflow.operators.neural import Net, Training
from admitflow.presets import clinical

NETS = [
    Net((4, 3, 2, 4), "relu", norm=False, code=2),
    Net((4, 5, 3, 1), "elu", norm=True),
    Net((4, 5, 4, 3, 2, 2), "elu", dropout=0.4, norm=True),
    Net((4, 1), "elu"),
]


@pytest.mark.parametrize("net", NETS)
def test_gradient_matches_differences(net):
    rng = np.random.default_rng(0)
    x, y = rng.random((7, 4)), (rng.random((7, net.widths[-1])) > 0.5).astype(float)
    flat = neural.initial(net, [1])
    draw = lambda: np.random.default_rng(5)
    loss, grad = neural.step(net, neural.views(net, flat.copy()), x, y, draw())
    whole = np.concatenate([grad[name].ravel() for name, _ in net.shapes() if name in grad])
    assert len(whole) == net.trained()
    for i in range(0, len(whole), 3):
        moved = flat.copy()
        moved[i] += 1e-6
        up = neural.step(net, neural.views(net, moved), x, y, draw())[0]
        assert (up - loss) / 1e-6 == pytest.approx(whole[i], abs=2e-4)


def test_batch_norm_moments_and_scoring_use_no_noise():
    net = Net((3, 8, 1), dropout=0.5)
    p = neural.views(net, neural.initial(net, [2]))
    x = np.random.default_rng(1).random((50, 3))
    for _ in range(200):
        neural.step(net, p, x, np.ones((50, 1)), np.random.default_rng(3))
    a = neural.forward(net, p, x)[0]
    assert (a == neural.forward(net, p, x)[0]).all()
    # Each row is scored on its own, whatever else is in its batch.
    assert np.allclose(a[:7], neural.forward(net, p, x[:7])[0])


def rows_of(spark, n=400, inputs=4):
    cells = F.array(*((F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) / 1000) for i in range(inputs)))
    rows = spark.range(n).select("id", cells.alias("x"))
    planted = (F.col("x")[0] + F.col("x")[1] > F.col("x")[2] + 0.5).cast("double")
    return rows.withColumn("y", F.array(planted))


def by_hand(rows, net, how):
    """One replica without Spark: the same rows, order, draws and steps."""
    first = rows.select("id", F.xxhash64(F.struct("id"), F.lit(how.seed)).alias("o"), "x", "y").orderBy("o").collect()
    table = np.array([[*r.x, *r.y] for r in first], np.float32)
    replica, losses = neural._Replica(net, neural.initial(net, [how.seed, 0])), []
    for epoch in range(how.epochs):
        rng = np.random.default_rng([how.seed, 0, 0, epoch])
        losses.append(replica.epoch(table, rng.permutation(len(table)), how, rng) / len(table))
    return replica, losses


def test_one_replica_is_plain_mini_batch_training(spark):
    net, how = Net((4, 6, 1), dropout=0.2), Training(epochs=5, batch=32, replicas=1, epochs_a_round=2, rate=0.01, decay=1e-4)
    rows = rows_of(spark)
    replica, losses = by_hand(rows, net, how)
    done = neural.train(rows, "id", "x", "y", [net], how)
    assert done.losses[0] == pytest.approx(losses, abs=1e-6)
    assert np.concatenate([a.ravel() for a in done.numbers(0).values()]) == pytest.approx(replica.flat, abs=1e-5)


def test_losses_do_not_depend_on_partitions_or_lanes(spark):
    nets = [Net((4, 6, 1), dropout=0.3), Net((4, 3, 1), "relu", norm=False), Net((4, 2, 2, 1))]
    how = Training(epochs=4, batch=16, replicas=3, epochs_a_round=2, keep=0.9)
    losses = [neural.train(rows_of(spark).repartition(n), "id", "x", "y", nets, how, lanes).losses for n, lanes in ((1, 1), (5, 2), (3, 3))]
    for other in losses[1:]:
        assert all(other[i] == pytest.approx(losses[0][i], abs=1e-6) for i in range(3))


def test_replicas_learn_a_planted_rule(spark):
    rows = rows_of(spark, 4000)
    nets = [Net((4, 16, 8, 1), dropout=p) for p in (0.0, 0.1)]
    how = Training(epochs=20, batch=32, replicas=4, rate=0.01, balance=True)
    done = neural.train(rows.where("id < 3200"), "id", "x", "y", nets, how, lanes=2)
    scored = neural.score(done, rows.where("id >= 3200"), ["id", "y"], "x", lanes=2)
    assert scored.count() == 1600
    flat = scored.select("net", F.col("y")[0].cast("int").alias("y"), F.col("scores")[0].alias("score"))
    for r in evaluate.roc_auc(flat, "y", "score", ["net"]).collect():
        assert r.roc_auc > 0.95


def test_done_nets_keep_their_numbers_while_others_train_on(spark):
    """One net's loss falls below the stop at once, the other's never does."""
    rows = rows_of(spark).withColumn("y", F.array(F.lit(0.5)))
    nets = [Net((4, 1)), Net((4, 3, 1), dropout=0.9)]
    done = neural.train(rows, "id", "x", "y", nets, Training(epochs=3, replicas=2, rate=0.05, stop=0.7, batch=64))
    assert len(done.losses[0]) <= len(done.losses[1]) <= 3
    assert {r.net for r in done.state.select("net").distinct().collect()} == {0, 1}
    assert neural.score(done, rows, ["id"], "x").count() == 800


def test_no_rows_nulls_and_several_labels(spark):
    net, how = Net((4, 5, 2)), Training(epochs=2, replicas=2)
    empty = neural.train(rows_of(spark).limit(0), "id", "x", "y", [net], how)
    assert empty.losses == {0: []} and empty.numbers(0)["w1"].shape == (4, 5)
    rows = rows_of(spark, 50).withColumn("y", F.array(F.col("y")[0], 1 - F.col("y")[0]))
    holes = rows.unionByName(rows.select((F.col("id") + 100).alias("id"), F.lit(None).cast("array<double>").alias("x"), "y"))
    done = neural.train(holes, "id", "x", "y", [net], how)
    assert done.losses == neural.train(rows, "id", "x", "y", [net], how).losses
    got = neural.score(done, holes, ["id"], "x").collect()
    assert len(got) == 50 and {len(r.scores) for r in got} == {2}
    assert neural.loss_table(done, spark).count() == 2


def test_neither_weights_nor_gradients_are_collected(spark, monkeypatch):
    """What the driver fetches in training is one row per net and epoch."""
    from pyspark.sql.classic.dataframe import DataFrame

    fetched, plain = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (fetched.append(len(rows)), rows)[1])(plain(self)))
    neural.train(rows_of(spark), "id", "x", "y", [Net((4, 300, 300, 1))], Training(epochs=4, replicas=2, epochs_a_round=2))
    assert fetched == [2, 2]


def test_skill_of_a_label_is_more_than_its_share(spark):
    """A label of which little can be known is still known a little (AUC 0.633); scores that say nothing are no skill."""
    from workload.learning import label_skills

    little = [(1, int(i % 4 == 0 or i % 8 == 1), 0.5 if i % 2 == 0 else 0.25) for i in range(800)]
    nothing = [(2, i % 2, 0.3 + 0.4 * (i % 4 > 1)) for i in range(800)]
    planted = [(0, i % 2, 0.1 + 0.8 * (i % 2)) for i in range(800)]
    got = {r.label_id: (r.support, r.skilled) for r in label_skills(spark.createDataFrame(little + nothing + planted, "label_id int, y int, score double")).collect()}
    assert got == {0: (400, True), 1: (300, True), 2: (400, False)}


def test_lanes_share_the_work_of_the_layouts():
    nets = {i: learn.net_shape(64, nodes) for i, nodes in enumerate(n for n in clinical.LAYER_GRID for _ in range(5))}
    work = [0] * 24
    for i, lane in neural.lanes_of(nets, 24).items():
        work[lane] += nets[i].size()
    assert sum(work) == sum(n.size() for n in nets.values())
    assert max(work) <= max(max(n.size() for n in nets.values()), 2 * sum(work) / 24)


def test_adam_in_spans_is_adam():
    net = learn.net_shape(20, [300, 100])
    replica, plain, rng = neural._Replica(net, neural.initial(net, [1])), neural.initial(net, [1]).astype(np.float32), np.random.default_rng(3)
    first, second = np.zeros(replica.n, np.float32), np.zeros(replica.n, np.float32)
    assert replica.n > 2 * neural.SPAN
    for i in range(1, 4):
        replica.g[: replica.n] = given = rng.normal(size=replica.n).astype(np.float32)
        replica._adam(neural.Training(decay=1e-3))
        g = given + np.float32(1e-3) * plain[: replica.n]
        first, second = first + np.float32(0.1) * (g - first), second + np.float32(0.001) * (g * g - second)
        plain[: replica.n] -= np.float32(1e-3 / (1 - 0.9**i)) * first / (np.sqrt(second / np.float32(1 - 0.999**i)) + np.float32(1e-8))
    assert np.allclose(replica.flat, plain, atol=1e-7)
