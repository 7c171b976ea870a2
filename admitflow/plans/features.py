"""The feature table of all admissions still open at their index date.

Three steps. ``feature_blocks`` cuts each source down to the rows that matter and
stores them. ``fit_features`` runs the aggregations whose results become part of
the schema or of the arithmetic (codes, levels, medians, bins); each is a small
table. ``feature_table`` is then one lazy plan over the blocks. Every feature is written as
facts (key, name, value); one pivot over the known names lays them out, so the
blocks need no joins with one another and a missing fact becomes 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions import recode, times
from admitflow.operators import events, joins, profile, reshape, scale
from admitflow.operators.population import still_admitted
from admitflow.params import Params
from admitflow.presets import clinical
from admitflow.session import cut_lineage, together

KEY = "hadm_id"
_STATIC_MARK, _LAB_MARK = "_in_population", "_has_labs"


@dataclass(frozen=True)
class Sources:
    """One frame per role; columns as in the study's tables."""

    admissions: DataFrame
    patients: DataFrame
    labs: DataFrame
    lab_items: DataFrame
    prescriptions: DataFrame
    diagnoses: DataFrame
    procedures: DataFrame
    notes: DataFrame


def clinical_static(column: str) -> Column:
    """The study's grouping of each categorical column."""
    c = F.col(column)
    if column == "admission_location":
        return recode.recode_open(c, clinical.ADMISSION_LOCATIONS)
    if column == "language":
        return recode.keep_listed(c, clinical.LANGUAGES)
    if column == "religion":
        return recode.recode_open(recode.keep_listed(c, clinical.RELIGIONS), clinical.RELIGION_GROUPS)
    if column == "ethnicity":
        return recode.recode_open(c, clinical.ETHNICITIES)
    if column == "marital_status":
        return F.coalesce(c, F.lit(clinical.UNKNOWN_MARITAL_STATUS))
    return c


@dataclass(frozen=True)
class Rules:
    """What to look for. The defaults are the clinical study's."""

    fluids: Sequence[str] = tuple(clinical.LAB_FLUIDS)
    drug_stems: Sequence[str] = tuple(clinical.DRUG_STEMS)
    wound_prefixes: Sequence[str] = tuple(clinical.OPEN_WOUND_PREFIXES)
    procedure_codes: Sequence[str] = tuple(clinical.INTUBATION_CODES)
    keywords: Sequence[str] = tuple(clinical.NOTE_KEYWORDS)
    lab_recodes: Sequence[tuple[str, str, Mapping]] = tuple(clinical.LAB_RECODES)
    dropped_labs: Sequence[str] = tuple(clinical.DROPPED_LABS)
    static: Sequence[str] = tuple(clinical.STATIC_CATEGORIES)
    static_recode: object = clinical_static
    max_age: float = clinical.MAX_AGE


@dataclass(frozen=True)
class FeatureSpec:
    """The fitted part of a feature table. Training and scoring share it."""

    binned: bool
    numeric: list[str]
    text: list[str]
    flags: list[str]
    drugs: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    stats: list[tuple] = field(default_factory=list)


def recode_labs(code: str, value: str, steps: Sequence[tuple[str, str, Mapping]]) -> Column:
    """Apply the recodes of each lab code, in order; other codes keep their value."""
    out: dict[str, Column] = {}
    for lab, mode, mapping in steps:
        before = out.get(lab, F.col(value))
        out[lab] = (recode.recode_open if mode == "open" else recode.recode_closed)(before, mapping)
    result = None
    for lab, expression in out.items():
        hit = F.col(code) == lab
        result = F.when(hit, expression) if result is None else result.when(hit, expression)
    return F.col(value) if result is None else result.otherwise(F.col(value))


def population(src: Sources, params: Params) -> DataFrame:
    return still_admitted(src.admissions, params.observation_window_hours)


def static_rows(src: Sources, pop: DataFrame, rules: Rules) -> DataFrame:
    """Key, grouped categories and age of the listed admissions."""
    listed = src.admissions.join(pop.select(KEY), KEY, "left_semi").join(src.patients, "subject_id", "left")
    age = recode.below(times.whole_years("dob", "admittime").cast("double"), rules.max_age)
    return listed.select(KEY, *(rules.static_recode(c).alias(c) for c in rules.static), age.alias("age"))


def lab_events(src: Sources, pop: DataFrame, rules: Rules, params: Params) -> DataFrame:
    """The last value of each item per admission, from items of the wanted fluids
    seen in the look-back of any index date of the subject.

    An event that matches several admissions would come out once per match and
    be picked once; here it is kept once from the start.
    """
    fluid = F.lower("fluid")
    wanted = src.lab_items.where(recode.contains_any(fluid, rules.fluids)).select("itemid")
    measured = src.labs.withColumn("value", recode.prefer_number("valuenum", "value"))
    measured = measured.where(F.col("value").isNotNull() & F.col(KEY).isNotNull()).join(wanted, "itemid", "left_semi")
    seen = joins.events_in_lookback(measured, pop, params.lab_lookback_days)
    last = events.keep_last(seen, [KEY, "itemid"], "charttime", ["value", "flag"])
    return last.select(KEY, F.col("itemid").cast("string").alias("code"), "value", "flag")


def lab_cells(labs: DataFrame, rules: Rules) -> DataFrame:
    """Recoded cells (key, code, value); values recoded to null are gone."""
    kept = labs.where(~recode.listed("code", rules.dropped_labs)) if rules.dropped_labs else labs
    cleaned = kept.select(KEY, "code", recode_labs("code", "value", rules.lab_recodes).alias("value"))
    return cleaned.where(F.col("value").isNotNull())


def drug_rows(src: Sources, pop: DataFrame, rules: Rules) -> DataFrame:
    named = src.prescriptions.where(recode.contains_any("drug", rules.drug_stems))
    until = joins.events_until_index(named, pop.select(KEY, "index_date"), KEY, "startdate")
    return until.select(KEY, "drug").distinct()


def previous_counts(src: Sources, pop: DataFrame, params: Params) -> DataFrame:
    counted = events.count_before(src.admissions, params.previous_admission_days)
    return counted.join(pop.select(KEY), KEY, "left_semi")


def indicator_rows(src: Sources, pop: DataFrame, rules: Rules) -> list[DataFrame]:
    """(key, name) of admissions with an open wound, a listed procedure, a note keyword."""
    keys = pop.select(KEY)
    wounds = src.diagnoses.where(recode.starts_any("icd9_code", rules.wound_prefixes)).join(keys, KEY, "left_semi")
    tubes = src.procedures.where(F.col("cpt_cd").isin(list(rules.procedure_codes))).join(keys, KEY, "left_semi")
    noted = events.keyword_rows(src.notes.where(F.col("iserror").isNull()), rules.keywords)
    noted = joins.events_until_index(noted, pop.select(KEY, "index_date"), KEY, "charttime")
    return [
        events.any_event(wounds, KEY, "wounds"),
        events.any_event(tubes, KEY, "intubation"),
        events.any_event(noted, KEY, "antibiotic_yn"),
    ]


def _numeric_cells(cells: DataFrame, numeric: Sequence[str], static: DataFrame, prev: DataFrame, lab_keys: DataFrame) -> DataFrame:
    """Numbers to scale or bin: labs and age of admissions with both, and previous counts."""
    labs = cells.where(F.col("code").isin(list(numeric))) if numeric else cells.where(F.lit(False))
    labs = labs.join(static.select(KEY), KEY, "left_semi")
    labs = labs.select(KEY, "code", recode.to_number("value").alias("x"))
    age = static.join(lab_keys, KEY, "left_semi").select(KEY, F.lit("age").alias("code"), F.col("age").alias("x"))
    counts = prev.select(KEY, F.lit("n_admits").alias("code"), F.col("n_admits").cast("double").alias("x"))
    return labs.unionByName(age).unionByName(counts).where(F.col("x").isNotNull())


@dataclass(frozen=True)
class Blocks:
    """The rows features are made of, each far smaller than its source."""

    static: DataFrame
    labs: DataFrame
    cells: DataFrame
    drugs: DataFrame
    prev: DataFrame
    indicators: list[DataFrame]


def feature_blocks(
    src: Sources,
    params: Params,
    rules: Rules = Rules(),
    labs: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Blocks:
    """Build the blocks. ``keep`` stores those that the fit and the table both
    read, so each source is read once; ``labs`` may be a stage of ``lab_events``.
    """
    pop = population(src, params)
    labs, static, drugs, prev = together(
        lambda: keep(lab_events(src, pop, rules, params)) if labs is None else labs,
        lambda: keep(static_rows(src, pop, rules)),
        lambda: keep(drug_rows(src, pop, rules)),
        lambda: keep(previous_counts(src, pop, params)),
    )
    return Blocks(static, labs, lab_cells(labs, rules), drugs, prev, indicator_rows(src, pop, rules))


def _text_cells(b: Blocks, text: Sequence[str], static: Sequence[str]) -> DataFrame:
    """(key, column, level) of the categorical labs and static columns of admissions with both."""
    lab_keys = b.labs.select(KEY).distinct()
    rows = b.static.join(lab_keys, KEY, "left_semi").select(KEY, *static)
    cells = rows.unpivot([KEY], list(static), "column", "level")
    if text:
        labs = b.cells.where(F.col("code").isin(list(text))).join(b.static.select(KEY), KEY, "left_semi")
        cells = cells.unionByName(labs.select(KEY, F.col("code").alias("column"), F.col("value").alias("level")))
    return cells.where(F.col("level").isNotNull())


def _binned_cells(numbers: DataFrame, stats: DataFrame) -> DataFrame:
    joined = numbers.join(stats, "code")
    label = scale.bin_label(F.col("x"), F.col("bin_lo"), F.col("bin_step"), F.col("bin_count"))
    return joined.select(KEY, F.col("code").alias("column"), label.alias("level"))


def _flag_cells(labs: DataFrame) -> DataFrame:
    name = F.concat("code", F.lit("_flag"))
    return labs.select(KEY, name.alias("column"), recode.flag_word("flag").alias("level")).where("level is not null")


def _stats_frame(spec: FeatureSpec, spark) -> DataFrame:
    columns = "code string, bin_lo double, bin_step double, bin_count int" if spec.binned else "code string, median double, width double"
    return spark.createDataFrame(spec.stats, columns)


def _collect_levels(cells: DataFrame, most: int) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for column, level in reshape.bounded(cells.select("column", "level").distinct(), most, "levels"):
        found.setdefault(column, []).append(level)
    return {c: sorted(v) for c, v in sorted(found.items())}


def fit_features(
    b: Blocks, params: Params, rules: Rules = Rules(), binned: bool = False, widest: int = reshape.WIDEST
) -> FeatureSpec:
    """Find codes, column kinds, levels and statistics.

    Sparsity and kinds are judged over all admissions with a lab event; scaling
    and binning over those also in the population. All that comes to the driver
    is named in a column of the result: at most ``widest`` codes or levels.
    """
    lab_keys = b.labs.select(KEY).distinct()
    n_rows, flags, drugs = together(
        lab_keys.count,
        lambda: reshape.vocabulary(b.labs, "code", widest),
        lambda: reshape.vocabulary(b.drugs, "drug", widest),
    )
    dense = profile.dense_codes(profile.code_profile(b.cells), n_rows, params.max_sparsity)
    kinds = {r["code"]: r["kind"] for r in reshape.bounded(profile.code_kinds(dense), widest, "codes")}
    numeric = sorted(c for c, k in kinds.items() if k == "numeric")
    text = sorted(c for c, k in kinds.items() if k != "numeric")
    numbers = _numeric_cells(b.cells, numeric, b.static, b.prev, lab_keys)
    if binned:
        fitted = scale.fit_bins(numbers, "x", ["code"])
        stats = [tuple(r) for r in reshape.bounded(fitted.select("code", "bin_lo", "bin_step", F.col("bin_count").cast("int")), widest, "codes")]
    else:
        spread = scale.fit_spread(numbers, "x", ["code"], 0.01, 0.99)
        stats = [tuple(r) for r in reshape.bounded(spread.select("code", "median", (F.col("low") - F.col("high")).alias("width")), widest, "codes")]
    cells = _text_cells(b, text, rules.static)
    if binned:
        frame = _stats_frame(FeatureSpec(True, [], [], [], [], {}, stats), b.labs.sparkSession)
        cells = cells.unionByName(_binned_cells(numbers, frame)).unionByName(
            _flag_cells(b.labs).join(b.static.select(KEY), KEY, "left_semi")
        )
    levels = _collect_levels(cells, widest)
    return FeatureSpec(binned, numeric, text, flags, drugs, levels, stats)


def _level_name(column, level):
    return F.concat(column, F.lit("_"), level)


def _facts(b: Blocks, spec: FeatureSpec, rules: Rules) -> DataFrame:
    """Every feature as (key, name, value), with marks for the two inner-joined sides."""
    spark = b.labs.sparkSession
    lab_keys = b.labs.select(KEY).distinct()
    numbers = _numeric_cells(b.cells, spec.numeric, b.static, b.prev, lab_keys)
    stats = _stats_frame(spec, spark)
    one = F.lit(1.0)
    levels = _text_cells(b, spec.text, rules.static)
    parts = [
        b.static.select(KEY, F.lit(_STATIC_MARK).alias("name"), one.alias("v")),
        lab_keys.select(KEY, F.lit(_LAB_MARK).alias("name"), one.alias("v")),
        b.drugs.select(KEY, F.col("drug").alias("name"), one.alias("v")),
        *(i.select(KEY, F.lit(i.columns[-1]).alias("name"), one.alias("v")) for i in b.indicators),
    ]
    if spec.binned:
        levels = levels.unionByName(_binned_cells(numbers, stats)).unionByName(_flag_cells(b.labs))
    else:
        joined = numbers.join(stats, "code")
        x = scale.scaled(F.col("x"), F.col("median"), F.col("width"))
        parts.append(joined.select(KEY, F.col("code").alias("name"), x.alias("v")))
        flag = recode.flag_code("flag").cast("double")
        parts.append(b.labs.select(KEY, F.concat("code", F.lit("_flag")).alias("name"), flag.alias("v")))
    parts.append(levels.select(KEY, _level_name(F.col("column"), F.col("level")).alias("name"), one.alias("v")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _output_columns(spec: FeatureSpec) -> list[tuple[str, Column]]:
    """(name, expression over the pivoted facts) of every feature, sorted by name."""
    cell = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(0.0))
    out = {name: cell(name) for name in spec.drugs}
    out |= {name: cell(name) for name in ("wounds", "intubation", "antibiotic_yn")}
    if not spec.binned:
        out |= {c: cell(c) for c in [*spec.numeric, "age", "n_admits"]}
        out |= {f"{c}_flag": cell(f"{c}_flag") for c in spec.flags}
    # A number that is missing falls in bin 0, except the previous count, which
    # joins after binning; its levels and those of text columns can be absent.
    binned_numbers = {*spec.numeric, "age"} if spec.binned else set()
    for column, found in spec.levels.items():
        if not found:  # an empty column has no levels and makes no columns
            continue
        out |= {f"{column}_{v}": cell(f"{column}_{v}") for v in found[1:]}
        if column in binned_numbers:
            out[f"{column}_nan"] = F.lit(0.0)
        else:
            seen = F.coalesce(*(F.col(f"`{column}_{v}`") for v in found))
            out[f"{column}_nan"] = seen.isNull().cast("double")
    return sorted(out.items())


def feature_table(b: Blocks, spec: FeatureSpec, rules: Rules = Rules()) -> DataFrame:
    """One row per admission in the population that has a lab event; all features as doubles."""
    names = [_STATIC_MARK, _LAB_MARK, *spec.drugs, "wounds", "intubation", "antibiotic_yn"]
    if not spec.binned:
        names += [*spec.numeric, "age", "n_admits", *(f"{c}_flag" for c in spec.flags)]
    names += [f"{column}_{v}" for column, found in spec.levels.items() for v in found]
    wide = reshape.pivot_values(_facts(b, spec, rules), KEY, "name", "v", list(dict.fromkeys(names)))
    both = wide.where(F.col(_STATIC_MARK).isNotNull() & F.col(_LAB_MARK).isNotNull())
    return both.select(KEY, *(cell.alias(name) for name, cell in _output_columns(spec)))


def build_features(
    src: Sources, params: Params, rules: Rules = Rules(), binned: bool = False, labs: DataFrame | None = None
) -> tuple[DataFrame, FeatureSpec]:
    b = feature_blocks(src, params, rules, labs)
    spec = fit_features(b, params, rules, binned)
    return feature_table(b, spec, rules), spec
