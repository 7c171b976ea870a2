"""The baseline run: split, oversample, train, cross-validate, score, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame

from admitflow.operators import evaluate, learn, sampling
from admitflow.session import cut_lineage


@dataclass
class Baseline:
    model: PipelineModel
    balance: DataFrame
    folds: DataFrame | None
    scored: DataFrame
    label: str

    @property
    def report(self) -> DataFrame:
        return evaluate.classification_report(self.scored, self.label, "prediction")

    @property
    def confusion(self) -> DataFrame:
        return evaluate.confusion_matrix(self.scored, self.label, "prediction")

    @property
    def roc(self) -> DataFrame:
        return evaluate.roc_points(self.scored, self.label, "score")

    @property
    def pr(self) -> DataFrame:
        return evaluate.pr_points(self.scored, self.label, "score")


def run(
    df: DataFrame,
    key: sampling.Key,
    label: str,
    features: Sequence[str],
    make: Callable[[], Estimator] = learn.forest,
    seed: int = 42,
    test: float = 0.1,
    folds: int = 5,
) -> Baseline:
    """Train on an oversampled 1 - ``test`` share and score the rest.

    Folds number the original training rows and are oversampled one by one, so
    copies of a row stay on one side (``folds=0``: no cross-validation).
    """
    split = sampling.split_stratified(cut_lineage(df), key, label, seed, test)
    train, held = (split.where(split["split"] == part).drop("split") for part in ("train", "test"))
    over = sampling.oversample_minority(train, key, label, seed)
    checked = None
    if folds:
        numbered = sampling.kfold_assign(train, key, label, seed, folds)
        resample = partial(sampling.oversample_minority, key=key, label=label, seed=seed)
        checked = learn.cross_validate(numbered, features, key, make, folds, label, resample=resample)
    model = learn.fit(over, features, make())
    balance = sampling.balance_table(label, original=train, oversampled=over)
    return Baseline(model, balance, checked, learn.score(model, held, key, label), label)
