"""Row encoders: PCA, and a denoising autoencoder.

The autoencoder is trained by ``neural``: replicas take steps over batches of
their own rows and their weights are averaged, so no gradient reaches the
driver. What is fetched there is the fitted encoder, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitflow.operators import neural


def fit_pca(df: DataFrame, column: str, k: int) -> PCAModel:
    vectors = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="encoded").fit(vectors)


def encode_pca(model: PCAModel, df: DataFrame, column: str, name: str = "encoded") -> DataFrame:
    vectors = df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
    return model.setOutputCol("_pca").transform(vectors).withColumn(name, vector_to_array("_pca")).drop("_pca", "features")


@dataclass
class Autoencoder:
    """Weights of d -> d/2 -> 256 -> 128 and back; the last ``depth`` layers decode."""

    widths: list[int]
    weights: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)

    @property
    def code_layer(self) -> int:
        return len(self.weights) // 2


def new_autoencoder(d: int, hidden: tuple[int, ...] | None = None, code: int = 128, seed: int = 42) -> Autoencoder:
    hidden = (max(d // 2, 1), 256) if hidden is None else hidden
    widths = [d, *hidden, code, *reversed(hidden), d]
    rng = np.random.default_rng(seed)
    weights = []
    for a, b in zip(widths, widths[1:]):
        bound = 1.0 / np.sqrt(a)
        weights.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return Autoencoder(widths, weights)


def _net(model: Autoencoder) -> neural.Net:
    return neural.Net(tuple(model.widths), "relu", norm=False, code=model.code_layer)


def _flat(model: Autoencoder) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in model.weights for a in pair])


def fit_autoencoder(
    df: DataFrame,
    key: str,
    column: str,
    model: Autoencoder,
    epochs: int = 170,
    rate: float = 1e-3,
    decay: float = 1e-5,
    keep: float | None = 0.1,
    stop: float = 0.005,
    seed: int = 42,
    batch: int = 512,
    replicas: int = 8,
    epochs_a_round: int = 10,
) -> Autoencoder:
    """Train on an array column with entries in [0, 1]; without rows the model stays as it is.

    ``keep`` is the chance that an input entry x stays as it is; otherwise it is
    fed as 1 - x (None: no noise). The target is always the clean row. Adam with
    L2 ``decay`` over batches of ``batch`` rows in each of ``replicas``, averaged
    after every ``epochs_a_round`` epochs; ends early when the mean loss at the
    end of a round is below ``stop``.
    """
    spark = df.sparkSession
    pieces = neural.pieces_of(0, 1, _flat(model))
    state = spark.createDataFrame(pieces, neural.STATE)
    how = neural.Training(epochs, batch, rate, decay, keep, stop, False, replicas, epochs_a_round, seed)
    done = neural.train(df.select(F.col(key).alias("_key"), F.col(column).alias("_x")), "_key", "_x", "_x", [_net(model)], how, state=state)
    found = done.numbers(0)
    layers = range(1, len(model.widths))
    return Autoencoder(model.widths, [(found[f"w{i}"].copy(), found[f"b{i}"].copy()) for i in layers], done.losses[0])


def loss_history(model: Autoencoder, spark) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.losses, 1)], "epoch int, loss double")


def encode_rows(df: DataFrame, column: str, model: Autoencoder, keep: list[str], name: str = "encoded") -> DataFrame:
    """The code of every row, with the columns of ``keep``; one narrow stage."""
    net, flat = _net(model), _flat(model)
    shared = df.sparkSession.sparkContext.broadcast((tuple(net.widths), net.code, flat))
    out = T.StructType([*df.select(*keep).schema, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        widths, code, numbers = shared.value
        net = neural.Net(widths, "relu", norm=False, code=code)
        weights = neural.views(net, numbers)
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch[column].to_numpy()).astype(float)
            coded = batch[keep].copy()
            coded[name] = list(neural.forward(net, weights, x, stop=code)[0])
            yield coded

    return df.select(*keep, column).mapInPandas(work, out)
