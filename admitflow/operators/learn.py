"""Training and scoring on DataFrames, with Spark ML estimators.

A training frame has a unique key, numeric feature columns and a 0/1 label.
Scored frames have (key, label, prediction, score). Result tables of sweeps and
folds hold one row per fitted model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.operators import evaluate, neural, sampling
from admitflow.operators.forest import BranchForest
from admitflow.operators.perceptron import BlockPerceptron, fit_all
from admitflow.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
SCALED = "scaled_features"  # an estimator that reads this column gets features of mean 0 and deviation 1


def _weight_column(sizes: dict, label: str) -> Column:
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for c, n in sizes.items():
        weight = F.when(F.col(label) == c, total / (len(sizes) * n)).otherwise(weight)
    return weight


def balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add weights n / (classes * class size)."""
    return df.withColumn(name, _weight_column(sampling.class_counts(df, label), label))


def forest(
    trees: int = 150, depth: int = 13, features: int | str = 40, share: float = 0.9, leaf: int = 2, weighted: bool = True, seed: int = 42, label: str = "y",
    statistics_mb: int = 1024,
) -> RandomForestClassifier:
    """Random forest; ``features`` candidates per split, ``share`` of the rows per tree.

    It is grown branch by branch (``admitflow.operators.forest``). ``statistics_mb`` is
    the memory for split statistics where Spark's own way is taken: the more nodes fit
    into it, the fewer passes over the rows a level takes. Results do not depend on it.
    """
    model = BranchForest(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(features),
        subsamplingRate=share, minInstancesPerNode=leaf, seed=seed, maxMemoryInMB=statistics_mb,
    )
    return model.setWeightCol("weight") if weighted else model


def boosted(rounds: int = 100, depth: int = 5, eta: float = 0.3, seed: int = 42, label: str = "y") -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=eta, lossType="logistic", seed=seed)


def perceptron(inputs: int, nodes: Sequence[int], epochs: int = 10, seed: int = 42, label: str = "y") -> MultilayerPerceptronClassifier:
    """Layers ``inputs``, ``nodes``..., 2; sigmoid between, softmax at the end.

    It learns from scaled features: on raw ones its sigmoids are saturated, and most
    of its passes over the rows are line searches that find nothing. It is trained
    over blocks of rows (``admitflow.operators.perceptron``).
    """
    return BlockPerceptron(featuresCol=SCALED, labelCol=label, layers=[inputs, *nodes, 2], maxIter=epochs, seed=seed)


def _assembly(features: Sequence[str]) -> list:
    """Stages that make the vector ``features``. The columns are aliased first, since an assembler takes a dot in a name for a nested field."""
    quoted = (f"`{name.replace('`', '``')}` AS `_feature_{i}`" for i, name in enumerate(features))
    aliases = SQLTransformer(statement=f"SELECT *, {', '.join(quoted)} FROM __THIS__")
    return [aliases, VectorAssembler(inputCols=[f"_feature_{i}" for i in range(len(features))], outputCol="features")]


def feature_names(model: PipelineModel) -> list[str]:
    """The columns a model of ``fit`` was fitted on, in the order of its vector. They are stored with the model."""
    found = re.findall(r"`((?:[^`]|``)+)` AS `_feature_\d+`", model.stages[0].getStatement())
    return [name.replace("``", "`") for name in found]


def fit(df: DataFrame, features: Sequence[str], estimator: Estimator) -> PipelineModel:
    """Assemble the features and fit; adds balanced weights or scaled features if the estimator uses them.

    Training passes over the rows many times, so the assembled vectors are
    persisted (memory, then disk) while it lasts.
    """
    label = estimator.getLabelCol()
    assembly = _assembly(features)
    rows = PipelineModel(stages=assembly).transform(df).select("features", label).persist()
    try:
        if estimator.getFeaturesCol() == SCALED:
            scaler = StandardScaler(withMean=True, inputCol="features", outputCol=SCALED).fit(rows)
            return PipelineModel(stages=[*assembly, scaler, estimator.fit(scaler.transform(rows))])
        if estimator.hasParam("weightCol") and estimator.isSet("weightCol"):
            return PipelineModel(stages=[*assembly, estimator.fit(balanced(rows, label, estimator.getWeightCol()))])
        return PipelineModel(stages=[*assembly, estimator.fit(rows)])
    finally:
        rows.unpersist()


def fit_perceptrons(df: DataFrame, features: Sequence[str], estimators: Sequence[BlockPerceptron]) -> list[PipelineModel]:
    """``fit`` of several perceptrons on the same features; all are trained in the same passes over the rows."""
    labels = dict.fromkeys(e.getLabelCol() for e in estimators)
    assembly = _assembly(features)
    rows = PipelineModel(stages=assembly).transform(df).select("features", *labels).persist()
    try:
        scaler = StandardScaler(withMean=True, inputCol="features", outputCol=SCALED).fit(rows)
        return [PipelineModel(stages=[*assembly, scaler, model]) for model in fit_all(estimators, scaler.transform(rows))]
    finally:
        rows.unpersist()


def score(model: Model, df: DataFrame, key: str | Sequence[str], label: str = "y") -> DataFrame:
    """Probability of class 1 and the predicted class, per row. ``key``: one column, or several."""
    scored = model.transform(df)
    p = vector_to_array("probability")
    return scored.select(*sampling.key_columns(key), F.col(label).cast("int").alias(label), F.col("prediction").cast("int").alias("prediction"), F.get(p, F.lit(1)).alias("score"))


def measure(frames: Sequence[tuple[Mapping, DataFrame]], label: str = "y", auc: bool = True) -> DataFrame:
    """Metrics of several scored frames, one row per frame, with its tags as columns.

    All frames are scored and measured together, in one pass grouped by the tags.
    Without ``auc`` that pass counts predictions where they are made, and only the metrics are stored.
    """
    tags = list(frames[0][0])
    tagged = [scored.select(*(F.lit(v).alias(t) for t, v in named.items()), label, "prediction", "score") for named, scored in frames]
    rows = sampling.union_rows(*tagged)
    rows = cut_lineage(rows) if auc else rows
    basic = evaluate.binary_metrics(rows, label, "prediction", tags).drop("no_skill")
    return basic.join(evaluate.roc_auc(rows, label, "score", tags), tags) if auc else cut_lineage(basic)


def fit_multilabel(df: DataFrame, features: Sequence[str], labels: Sequence[str], make: Callable[[str], Estimator], parallelism: int = 1) -> dict[str, PipelineModel]:
    """One binary model per label column; ``parallelism`` of them are fitted at once, and perceptrons all side by side."""
    estimators = [make(name) for name in labels]
    if all(isinstance(e, BlockPerceptron) and e.getFeaturesCol() == SCALED for e in estimators):
        return dict(zip(labels, fit_perceptrons(df, features, estimators)))
    with ThreadPool(parallelism) as pool:
        return dict(zip(labels, pool.map(lambda e: fit(df, features, e), estimators)))


def score_multilabel(models: Mapping[str, PipelineModel], df: DataFrame, key: str) -> DataFrame:
    """(key, labels, scores): arrays in label order. Each model adds its column to the same rows."""
    out = df
    for name, model in models.items():
        columns = out.columns
        p = F.get(vector_to_array("probability"), F.lit(1)).alias(f"_score_{name}")
        out = model.transform(out).select(*columns, p)
    return out.select(
        key,
        F.array(*(F.col(n).cast("int") for n in models)).alias("labels"),
        F.array(*(F.col(f"_score_{n}") for n in models)).alias("scores"),
    )


def grid_sweep(train: DataFrame, test: DataFrame, features: Sequence[str], key: sampling.Key, layouts: Sequence[Sequence[int]], epochs: int, label: str = "y") -> DataFrame:
    """Metrics of one neural classifier per hidden-layer layout; all are trained side by side."""
    made = fit_perceptrons(train, features, [perceptron(len(features), nodes, epochs, label=label) for nodes in layouts])
    frames = [({"layout": "-".join(map(str, nodes))}, score(model, test, key, label)) for nodes, model in zip(layouts, made)]
    return measure(frames, label)


def net_frame(df: DataFrame, features: Sequence[str] | str, key: sampling.Key, labels: Sequence[str]) -> DataFrame:
    """(key, x, y): features (columns, or one array column) and 0/1 labels as arrays, for ``neural``."""
    x = F.col(features) if isinstance(features, str) else F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    return df.select(*sampling.key_columns(key), x.alias("x"), F.array(*(F.col(c).cast("double") for c in labels)).alias("y"))


def net_shape(inputs: int, nodes: Sequence[int], dropout: float = 0.5, outputs: int = 1) -> neural.Net:
    """The study's classifier: hidden layers of linear, dropout, ELU, batch norm; sigmoid outputs."""
    return neural.Net((inputs, *nodes, outputs), "elu", dropout, norm=True)


def score_nets(trained: neural.Trained, rows: DataFrame, key: sampling.Key, label: str = "y", lanes: int = 1) -> DataFrame:
    """(net, key, label, prediction, score) of every net with one output; a score of 0.5 or more is class 1. ``rows``: of ``net_frame``."""
    keys = [key] if isinstance(key, str) else list(key)
    scored = neural.score(trained, rows, [*keys, "y"], "x", lanes=lanes)
    p = F.col("scores")[0]
    return scored.select("net", *keys, F.col("y")[0].cast("int").alias(label), (p >= 0.5).cast("int").alias("prediction"), p.alias("score"))


def net_sweep(
    train: DataFrame, test: DataFrame, features: Sequence[str] | str, inputs: int, key: sampling.Key, layouts: Sequence[Sequence[int]],
    dropouts: Sequence[float], training: neural.Training, label: str = "y", lanes: int = 4,
) -> DataFrame:
    """Metrics of the study's classifier per hidden-layer layout and dropout; all are trained and scored side by side."""
    grid = [(layout, p) for layout in layouts for p in dropouts]
    nets = [net_shape(inputs, layout, p) for layout, p in grid]
    done = neural.train(net_frame(train, features, key, [label]), sampling.key_columns(key), "x", "y", nets, training, lanes)
    scored = cut_lineage(score_nets(done, net_frame(test, features, key, [label]), key, label, lanes), "net-scores")
    tags = [(i, "-".join(map(str, layout)), float(p), done.losses[i][-1] if done.losses[i] else None) for i, (layout, p) in enumerate(grid)]
    named = train.sparkSession.createDataFrame(tags, "net int, layout string, dropout double, loss double")
    basic = evaluate.binary_metrics(scored, label, "prediction", ["net"]).drop("no_skill")
    return named.join(basic, "net", "left").join(evaluate.roc_auc(scored, label, "score", ["net"]), "net", "left").drop("net")


def fit_label_chain(df: DataFrame, features: Sequence[str], labels: Sequence[str], key: sampling.Key, make: Callable[[str], Estimator], seed, folds: int = 3, parallelism: int = 4) -> dict[str, PipelineModel]:
    """One model per label, in order; each also sees the scores of the labels before it.

    Those scores are out-of-fold: a row's score comes from a model that did not see
    the row, so a label's model learns from scores like those it gets later. The
    models returned are fitted on all rows. A label's models do not need one another;
    ``parallelism`` of them are fitted at once.
    """
    fold = "_chain_fold"
    rows, seen, models = cut_lineage(sampling.kfold_assign(df, key, labels[0], seed, folds, fold), "chain"), list(features), {}
    for name in labels:
        trained_on = [rows] if name == labels[-1] else [rows, *(rows.where(F.col(fold) != i) for i in range(folds))]
        with ThreadPool(parallelism) as pool:
            models[name], *others = pool.map(lambda df: fit(df, seen, make(name)), trained_on, chunksize=1)  # noqa: B023
        if name == labels[-1]:
            break
        parts = [_with_score(model, rows.where(F.col(fold) == i), f"_chain_{name}") for i, model in enumerate(others)]
        rows = cut_lineage(sampling.union_rows(*parts), "chain")
        seen.append(f"_chain_{name}")
    return models


def _with_score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).select(*(F.col(f"`{c}`") for c in df.columns), F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def score_label_chain(models: Mapping[str, PipelineModel], df: DataFrame, key: str) -> DataFrame:
    """(key, labels, scores): arrays in label order; each model sees the scores before its own."""
    out = df
    for name, model in models.items():
        out = _with_score(model, out, f"_chain_{name}")
    return out.select(key, F.array(*(F.col(n).cast("int") for n in models)).alias("labels"), F.array(*(F.col(f"_chain_{n}") for n in models)).alias("scores"))


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    key: sampling.Key,
    make: Callable[[], Estimator],
    folds: int,
    label: str = "y",
    fold: str = "fold",
    resample: Callable[[DataFrame], DataFrame] | None = None,
    parallelism: int = 1,
) -> DataFrame:
    """Metrics per fold. ``fold`` numbers original rows, so with ``resample`` (applied
    to the training folds only) no copy of a row is on both sides. Number the
    folds of an already resampled frame to let copies leak, as the study did.
    """
    df = cut_lineage(df)

    def one(i: int) -> tuple[dict, DataFrame]:
        train = df.where(F.col(fold) != i)
        model = fit(resample(train) if resample else train, features, make())
        return {"fold": i}, score(model, df.where(F.col(fold) == i), key, label)

    with ThreadPool(parallelism) as pool:
        return measure(pool.map(one, range(folds)), label)


def summarize_folds(folds: DataFrame) -> DataFrame:
    """mean, (population) std and 2 * std of each metric."""
    long = folds.unpivot([], list(METRICS), "metric", "value")
    std = F.stddev_pop("value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), std.alias("std"), (2 * std).alias("spread"))


def _fit_points(points: Sequence[tuple[Mapping, DataFrame, DataFrame, Estimator]], features: Sequence[str], key: sampling.Key, label: str, metric: str, parallelism: int) -> DataFrame:
    """Train and test score of every point of a curve: its tags, training rows, test rows and estimator. Points do not
    need one another, and a fit has many short jobs, so ``parallelism`` of them are fitted at once."""

    def one(point: tuple[Mapping, DataFrame, DataFrame, Estimator]) -> list[tuple[Mapping, DataFrame]]:
        tags, train, test, estimator = point
        model = fit(train, features, estimator)
        return [({**tags, "part": "train"}, score(model, train, key, label)), ({**tags, "part": "test"}, score(model, test, key, label))]

    with ThreadPool(parallelism) as pool:
        found = pool.map(one, points, chunksize=1)
    return _train_and_test([frame for frames in found for frame in frames], label, metric)


def _train_and_test(frames: Sequence[tuple[Mapping, DataFrame]], label: str, metric: str) -> DataFrame:
    """One row per fitted model: ``metric`` on its training rows and on its test rows."""
    tags = [t for t in frames[0][0] if t != "part"]
    side = lambda part: F.max(F.when(F.col("part") == part, F.col(metric))).alias(f"{part}_score")
    return measure(frames, label, auc=metric == "roc_auc").groupBy(*tags).agg(side("train"), side("test"))


def learning_curve(
    df: DataFrame, features: Sequence[str], key: sampling.Key, make: Callable[[], Estimator], seed,
    shares: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 3, label: str = "y", metric: str = "f1",
    parallelism: int = 4,
) -> DataFrame:
    """Train and test score per (training size, fold). Sizes are nested: each is a
    prefix of the hash order of the fold's training rows."""
    numbered = cut_lineage(sampling.kfold_assign(df, key, label, seed, folds))
    points = []
    for i in range(folds):
        train, test = numbered.where(F.col("fold") != i), numbered.where(F.col("fold") == i)
        n = train.count()
        sizes = [int(share * n) for share in shares]
        cuts = sampling.hash_cuts(train, key, f"{seed}:size", {None: sizes})
        for j, size in enumerate(sizes):
            points.append(({"size": size, "fold": i}, train.where(sampling.below_cut(key, f"{seed}:size", cuts, j)), test, make()))
    points.sort(key=lambda point: -point[0]["size"])  # the longest fits begin first
    return _fit_points(points, features, key, label, metric, parallelism)


def validation_curve(
    df: DataFrame, features: Sequence[str], key: sampling.Key, make: Callable[[object], Estimator], values: Sequence, seed,
    folds: int = 3, label: str = "y", metric: str = "f1", parallelism: int = 4,
) -> DataFrame:
    """Train and test score per (parameter value, fold)."""
    numbered = cut_lineage(sampling.kfold_assign(df, key, label, seed, folds))
    sides = [(numbered.where(F.col("fold") != i), numbered.where(F.col("fold") == i)) for i in range(folds)]
    points = [({"value": str(value), "fold": i}, train, test, make(value)) for value in values for i, (train, test) in enumerate(sides)]
    return _fit_points(points, features, key, label, metric, parallelism)


def feature_importance(model: PipelineModel, df: DataFrame, top: int | None = None) -> DataFrame:
    """(rank, label, importance) of the features of a fitted tree model, highest first."""
    names = feature_names(model)
    values = model.stages[-1].featureImportances.toArray()
    table = df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "label string, importance double")
    return evaluate.rank_table(table, "label", "importance", top)


def topk_retrain(train: DataFrame, features: Sequence[str], make: Callable[[], Estimator], top: int = 50) -> tuple[PipelineModel, list[str]]:
    """Fit, keep the ``top`` most important features, and fit again on those."""
    first = fit(train, features, make())
    best = [r["label"] for r in feature_importance(first, train, top).orderBy("rank").collect()]
    return fit(train, best, make()), best
