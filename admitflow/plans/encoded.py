"""The encoded cohort: an encoder fitted on all admissions, applied to the labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from admitflow.operators import encode
from admitflow.params import Params
from admitflow.plans.cohort import build_cohort
from admitflow.session import cut_lineage
from admitflow.sources import matrix


def encoded_cohort(
    features: DataFrame,
    labels: DataFrame,
    params: Params,
    key: str = "hadm_id",
    hidden: tuple[int, ...] | None = None,
    code: int = 128,
    rate: float = 1e-3,
) -> tuple[DataFrame, encode.Autoencoder]:
    """(key, charttime, y, encoded) of the cohort, and the fitted encoder.

    ``features`` is the binned table: its 0/1 columns suit the encoder's
    cross-entropy loss.
    """
    names = [c for c in features.columns if c != key]
    rows = cut_lineage(matrix.split_xy(matrix.to_matrix(features, key)).select(key, "x"))
    start = encode.new_autoencoder(len(names), hidden, code)
    model = encode.fit_autoencoder(rows, key, "x", start, params.encoder_training_epochs, rate)
    cohort = build_cohort(labels, rows)
    return encode.encode_rows(cohort, "x", model, [c for c in cohort.columns if c != "x"]), model
