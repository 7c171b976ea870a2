"""The research table: first values of common early labs, IQR-scaled, for labelled admissions.

The variant differs from the main table in its base (labelled admissions only),
the labs (items common in the first day, by LOINC code, first value), the
scaling (statistics of all measured values) and the reference levels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import recode, text, times
from admitflow.operators import events, joins, labels, population, profile, reshape, scale
from admitflow.operators.totals import quantiles
from admitflow.params import Params
from admitflow.plans import features
from admitflow.plans.features import KEY, Sources
from admitflow.presets import clinical
from admitflow.session import cut_lineage

DIMS = ["itemid", "category", "label", "fluid", "loinc_code"]


@dataclass(frozen=True)
class ResearchRules(features.Rules):
    drugs: Sequence[str] = tuple(clinical.ANTIBIOTICS)
    organisms: Sequence[int] = tuple(clinical.ORGANISMS)
    early_drugs: Sequence[str] = ("CEFTAZIDIME",)
    common: int = clinical.COMMON_LAB_COUNT
    early_hours: int = clinical.EARLY_TEST_HOURS
    lab_recodes: Sequence[tuple[str, str, Mapping]] = tuple(clinical.LOINC_RECODES)
    strips: Sequence[tuple[str, str]] = tuple(clinical.MEASUREMENT_STRIPS)
    failures: Sequence[str] = tuple(clinical.FAILURE_MESSAGES)
    reference_levels: Sequence[str] = tuple(clinical.RESEARCH_REFERENCE_LEVELS)
    unusable: Sequence[str] = tuple(clinical.UNUSABLE_LOINC)


def important_labs(src: Sources, tests: DataFrame, rules: ResearchRules) -> DataFrame:
    """How often each item of the wanted fluids is measured in the first day of
    admissions whose first listed test came early; most frequent first."""
    chosen = tests.where(
        F.col("ab_name").isin(list(rules.early_drugs)) & F.col("org_itemid").isin(list(rules.organisms)) & F.col("charttime").isNotNull()
    )
    stays = src.admissions.select(KEY, "admittime")
    first = events.first_event_hours(chosen.join(stays, KEY), [KEY, "admittime"], "admittime", "charttime")
    early = first.where(F.col("hours") < rules.early_hours).select(KEY, "admittime")
    items = src.lab_items.where(recode.contains_any(F.lower("fluid"), rules.fluids)).select(*DIMS)
    seen = src.labs.select(KEY, "itemid", "charttime").join(early, KEY)
    seen = seen.where(F.col("charttime") <= F.col("admittime") + times.hours(24)).join(items, "itemid")
    return events.item_counts(seen, DIMS)


def cohort_labels(src: Sources, tests: DataFrame, rules: ResearchRules, params: Params) -> DataFrame:
    """One row per labelled admission: (subject, key, admittime, index_date, RESISTANT_YN)."""
    hours = params.observation_window_hours
    found = labels.tests_after_window(src.admissions, tests, hours, rules.drugs, rules.organisms)
    return population.label_after_index(labels.label_per_test(found), hours)


def _measured(src: Sources, codes: DataFrame) -> DataFrame:
    """Lab rows of the listed items, with their LOINC code."""
    value = recode.prefer_number("valuenum", "value")
    return src.labs.withColumn("value", value).join(codes.select("itemid", "loinc_code"), "itemid").where("loinc_code is not null")


def _cleaned(cells: DataFrame, rules: ResearchRules) -> DataFrame:
    """Measurement wording stripped; failures dropped."""
    shown = cells.where(F.col("value").isNotNull()).withColumn("value", text.measurement_text("value", rules.strips))
    return shown.where(recode.not_failed("value", rules.failures))


def research_table(
    src: Sources, tests: DataFrame, rules: ResearchRules, params: Params, widest: int = reshape.WIDEST
) -> DataFrame:
    """One row per labelled admission with a lab value; label last, as ``RESISTANT_YN``.

    Codes and levels become columns, at most ``widest`` of them.
    """
    cohort = cut_lineage(cohort_labels(src, tests, rules, params))
    # The catalogue has one row per lab item.
    codes = cut_lineage(important_labs(src, tests, rules).where(F.col("cnt") >= rules.common).select("itemid", "loinc_code"))
    measured = _measured(src, codes)
    seen = joins.events_in_lookback(measured.where(F.col(KEY).isNotNull()), cohort, params.lab_lookback_days)
    first = events.keep_first(seen, ["subject_id", KEY, "loinc_code"], "charttime", ["itemid", "value"])
    cells = cut_lineage(
        first.join(cohort.select(KEY), KEY, "left_semi").select(KEY, F.col("loinc_code").alias("code"), "value")
    )
    # One count per (code, value) serves kinds and reference statistics: all values are read once for both.
    counted = measured.groupBy(F.col("loinc_code").alias("code"), "value").agg(F.count(F.lit(1)).alias("n"))
    all_values = cut_lineage(_cleaned(counted, rules))
    kinds = profile.code_kinds(profile.code_profile(all_values, weight="n"))
    kinds = {r["code"]: r["kind"] for r in reshape.bounded(kinds, widest, "codes")}
    kinds = {c: k for c, k in kinds.items() if c not in rules.unusable}
    numeric = sorted(c for c, k in kinds.items() if k == "numeric")
    words = sorted(c for c, k in kinds.items() if k == "categorical")

    reference = all_values.where(F.col("code").isin(numeric)).select("code", recode.to_number("value").alias("x"), "n")
    numbers = cells.where(F.col("code").isin(numeric)).select(KEY, "code", recode.to_number("value").alias("x"))
    scaled = cut_lineage(scale.scale_iqr(numbers, reference, "x", ["code"], "n").where("x is not null"))
    medians = {r["code"]: r["median"] for r in reshape.bounded(quantiles(scaled, "x", {"median": 0.5}, ["code"]), widest, "codes")}

    base = cells.select(KEY).distinct()
    recoded = features.recode_labs("code", "value", rules.lab_recodes)
    lab_words = cells.where(F.col("code").isin(words)).select(KEY, F.col("code").alias("column"), recoded.alias("level"))
    stays = features.static_rows(src, cohort, rules).join(base, KEY, "left_semi")
    static = stays.select(KEY, *rules.static).unpivot([KEY], list(rules.static), "column", "level")
    levels = lab_words.unionByName(static).where("level is not null")
    drugs = features.drug_rows(src, cohort, rules)
    prev = features.previous_counts(src, cohort, params)
    wounds = features.indicator_rows(src, cohort, rules)[0]

    one = F.lit(1.0)
    facts = base.select(KEY, F.lit("_base").alias("name"), one.alias("v"))
    for part in (
        scaled.select(KEY, F.col("code").alias("name"), F.col("x").alias("v")),
        levels.select(KEY, F.concat("column", F.lit("_"), "level").alias("name"), one.alias("v")),
        drugs.select(KEY, F.col("drug").alias("name"), one.alias("v")),
        prev.select(KEY, F.lit("n_admits").alias("name"), F.col("n_admits").cast("double").alias("v")),
        wounds.select(KEY, F.lit("wounds").alias("name"), one.alias("v")),
        cohort.select(KEY, F.lit("RESISTANT_YN").alias("name"), F.col("RESISTANT_YN").cast("double").alias("v")),
    ):
        facts = facts.unionByName(part)
    dropped = set(rules.reference_levels)
    level_names = [n for n in reshape.vocabulary(levels.select(F.concat("column", F.lit("_"), "level").alias("n")), "n") if n not in dropped]
    names = [*numeric, *level_names, *reshape.vocabulary(drugs, "drug"), "n_admits", "wounds"]
    wide = reshape.pivot_values(facts, KEY, "name", "v", ["_base", *names, "RESISTANT_YN"])
    # A scaled lab that is missing takes the column's median, anything else 0.
    cell = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(float(medians.get(n) or 0.0))).alias(n)
    return wide.where("_base is not null").select(KEY, *(cell(n) for n in sorted(names)), cell("RESISTANT_YN"))
