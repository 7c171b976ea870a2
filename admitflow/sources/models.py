"""Persistence of Spark ML models and of row encoders."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import SparkSession

from admitflow.operators.encode import Autoencoder


def save_model(model: Transformer, path: str) -> str:
    if not isinstance(model, PipelineModel):
        model = PipelineModel(stages=[model])
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_encoder(spark: SparkSession, model: Autoencoder, path: str) -> str:
    """An encoder as a parquet table: its losses, and one row per input of each layer and per bias."""
    rows = [(-1, 0, [float(x) for x in model.losses])]
    for layer, (weights, bias) in enumerate(model.weights):
        rows += [(layer, i, row.tolist()) for i, row in enumerate(weights)]
        rows.append((layer, len(weights), bias.tolist()))
    spark.createDataFrame(rows, "layer int, input int, weights array<double>").write.parquet(path)
    return path


def load_encoder(spark: SparkSession, path: str) -> Autoencoder:
    found: dict[int, list[list[float]]] = {}
    for r in spark.read.parquet(path).orderBy("layer", "input").collect():
        found.setdefault(r.layer, []).append(r.weights)
    losses = found.pop(-1)[0]
    weights = [(np.array(rows[:-1]), np.array(rows[-1])) for _, rows in sorted(found.items())]
    return Autoencoder([len(weights[0][0]), *(len(b) for _, b in weights)], weights, losses)
