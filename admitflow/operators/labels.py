"""Labels per test and per admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import recode
from admitflow.operators.population import after_window

# Interpretation codes of a susceptibility test.
RESISTANT = ("R", "I")
SENSITIVE = ("S",)


def resistance_columns(tests: DataFrame, interpretation: str = "interpretation", organism: str = "org_itemid") -> DataFrame:
    """0/1 indicators, and the organism id of any interpreted test (0 otherwise).

    ``RESISTANT_BACT`` says which organism was tested, whatever the outcome.
    """
    return tests.select(
        "*",
        F.when(recode.listed(interpretation, RESISTANT), 1).otherwise(0).alias("RESISTANT_YN"),
        F.when(recode.listed(interpretation, SENSITIVE), 1).otherwise(0).alias("SENSITIVE_YN"),
        F.when(recode.listed(interpretation, RESISTANT + SENSITIVE), F.col(organism))
        .otherwise(F.lit(0))
        .alias("RESISTANT_BACT"),
    )


def tests_after_window(
    admissions: DataFrame, tests: DataFrame, window_hours: int, drugs: Sequence[str], organisms: Sequence[int]
) -> DataFrame:
    """Tests of listed drugs on listed organisms, later than the observation window."""
    chosen = tests.where(F.col("ab_name").isin(list(drugs)) & F.col("org_itemid").isin(list(organisms)))
    joined = admissions.select("subject_id", "hadm_id", "admittime").join(chosen, "hadm_id")
    return resistance_columns(after_window(joined, window_hours))


def label_per_test(tests: DataFrame, keys=("subject_id", "hadm_id", "admittime", "charttime")) -> DataFrame:
    """One row per test time; resistant if any result at that time is."""
    return tests.groupBy(*keys).agg(F.max("RESISTANT_YN").alias("RESISTANT_YN"))


def label_per_admission(tests: DataFrame, key: str = "hadm_id") -> DataFrame:
    return tests.groupBy(key).agg(F.max("RESISTANT_BACT").alias("resistant_label"))


def organism_or_negative_screen(
    tests: DataFrame, organisms: Sequence[int], screen: str, organism: str = "org_itemid", kind: str = "spec_type_desc"
) -> DataFrame:
    """Tests of a listed organism, or of the screening kind without an organism (a negative)."""
    found = recode.listed(organism, organisms)
    negative = (F.col(kind) == screen) & F.col(organism).isNull()
    return tests.where(F.col("spec_itemid").isNotNull() & F.col("charttime").isNotNull() & (found | negative))


def ordered_results(tests: DataFrame, key: str, fields: Sequence[str], name: str = "results") -> DataFrame:
    """All results of an admission as one sorted array of structs (order made definite)."""
    return tests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
