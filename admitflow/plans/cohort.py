"""The labelled cohort: labels of tests after the window, joined to the features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from admitflow.operators import labels, reshape
from admitflow.params import Params
from admitflow.presets import clinical

KEY = "hadm_id"
ROW_KEY = (KEY, "charttime")  # a row of the resistance cohort


def resistance_labels(
    admissions: DataFrame,
    tests: DataFrame,
    params: Params,
    drugs: Sequence[str] = tuple(clinical.ANTIBIOTICS),
    organisms: Sequence[int] = tuple(clinical.ORGANISMS),
) -> DataFrame:
    """(key, charttime, RESISTANT_YN), one row per test time: the two name a row, as an admission may have several."""
    found = labels.tests_after_window(admissions, tests, params.observation_window_hours, drugs, organisms)
    return labels.label_per_test(found).select(*ROW_KEY, "RESISTANT_YN")


def organism_labels(
    admissions: DataFrame,
    tests: DataFrame,
    params: Params,
    drugs: Sequence[str] = tuple(clinical.ANTIBIOTICS),
    organisms: Sequence[int] = tuple(clinical.ORGANISMS),
) -> DataFrame:
    """(key, resistant_label): the largest tested organism id."""
    found = labels.tests_after_window(admissions, tests, params.observation_window_hours, drugs, organisms)
    return labels.label_per_admission(found)


def build_cohort(label_rows: DataFrame, features: DataFrame, label: str = "RESISTANT_YN", name: str = "y") -> DataFrame:
    """Label rows with their admission's features, label last. Several label rows
    of one admission each get a copy of the features; their own key columns
    (``ROW_KEY``) tell them apart. Sample and split by those."""
    return reshape.label_last(label_rows.join(features, KEY), label, name)
