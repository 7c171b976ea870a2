"""The population sample, the early labs, the research table and the encoded cohort."""

from pyspark.sql import functions as F

from admitflow.operators import population, sampling
from admitflow.params import Params
from admitflow.plans import cohort, encoded, research
from admitflow.plans.features import build_features
from workload.features import CTES, RULES, sources, staged_labs
from workload.learning import loss_rows
from workload.registry import query

RESEARCH = research.ResearchRules(
    fluids=RULES.fluids,
    drug_stems=RULES.drug_stems,
    wound_prefixes=RULES.wound_prefixes,
    lab_recodes=(("L5", "open", {"Clear": ["CLEAR"], "Hazy": ["HAZY"]}),),
    static=("admission_type", "admission_location"),
    drugs=("F", "O"),
    organisms=tuple(range(60)),
    early_drugs=("F",),
    reference_levels=("admission_type_P", "admission_location_5-LOW"),
)


@query(
    "all_pts_sample",
    """
    select subject_id, hadm_id, admittime, admittime + to_hours(24) as index_date from admissions
    where not coalesce(deathtime < admittime + to_hours(24), false) order by md5(hadm_id::varchar || ':11') limit 10000""",
)
def all_pts_sample(t):
    everyone = population.still_admitted(t.admissions, 24, ends=["deathtime"], closed=False)
    return sampling.sample_n(everyone, "hadm_id", 10000, 11)


_EARLY = """
    early as (
      select hadm_id, admittime from (
        select a.hadm_id, a.admittime, min(date_sub('second', a.admittime, m.charttime) // 3600)::int as hours
        from microbiology m join admissions a on a.hadm_id = m.hadm_id
        where m.ab_name = 'F' and m.org_itemid < 60 and m.charttime is not null group by 1, 2) where hours < 12),
    common as (
      select i.itemid, i.category, i.label, i.fluid, i.loinc_code, count(*) as cnt
      from labs l join early e on e.hadm_id = l.hadm_id join lab_items i on i.itemid = l.itemid
      where l.charttime <= e.admittime + interval 24 hour and (lower(i.fluid) like '%blood%' or lower(i.fluid) like '%urine%')
      group by 1, 2, 3, 4, 5)"""


@query("important_labs", f"with {_EARLY.strip()} select * from common")
def important_labs(t):
    return research.important_labs(sources(t), t.microbiology, RESEARCH)


def _has(rows: str, column: str) -> str:
    return f"""(exists (select 1 from {rows}))::int::double as "{column}" """


_NUMERIC = ["L1", "L2", "L4"]
_WORDS = {"L5": {"CLEAR": "Clear", "HAZY": "Hazy", "Cloudy": "Cloudy"}, "L7": {"0-2": "0-2", "3-5": "3-5", "LOADED": "LOADED"}}
_DRUGS = [f"{look} {kind}" for look in ("blue", "cold", "hot", "large", "new", "old", "red", "small") for kind in ("bolt", "ring")]
_COLUMNS = [
    *(
        f"""round(coalesce((select max(x) from scaled s where s.hadm_id = b.hadm_id and s.code = '{c}'),
          (select median(x) from scaled s where s.code = '{c}')), 6) + 0.0 as "{c}" """
        for c in _NUMERIC
    ),
    *(
        _has(f"cells c where c.hadm_id = b.hadm_id and c.code = '{code}' and c.value = '{raw}'", f"{code}_{level}")
        for code, levels in _WORDS.items()
        for raw, level in levels.items()
    ),
    *(f"""(admission_type = '{v}')::int::double as "admission_type_{v}" """ for v in "FO"),
    *(f"""(admission_location = '{v}')::int::double as "admission_location_{v}" """ for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")),
    *(
        _has(f"prescriptions r where r.hadm_id = b.hadm_id and r.drug = '{d}' and r.startdate <= b.index_date", d)
        for d in _DRUGS
    ),
    _has("diagnoses d where d.hadm_id = b.hadm_id and d.icd9_code like 'Brand#1%'", "wounds"),
    """coalesce((select count(distinct p.hadm_id) from admissions p where p.subject_id = b.subject_id and p.admittime < b.admittime
      and p.admittime >= b.admittime - interval 360 day), 0)::double as n_admits""",
    'yn::double as "RESISTANT_YN"',
]


@query(
    "research_table",
    f"""
    with cohort as (
      select a.subject_id, a.hadm_id, a.admittime, a.admittime + to_hours(24) as index_date, a.admission_type, a.admission_location,
             max(case when m.interpretation in ('R', 'I') then 1 else 0 end) as yn
      from admissions a join microbiology m on m.hadm_id = a.hadm_id
      where m.ab_name in ('F', 'O') and m.org_itemid < 60 and date_sub('hour', a.admittime, m.charttime) > 24
      group by 1, 2, 3, 4, 5, 6),
    {_EARLY.strip()},
    measured as (
      select l.subject_id, l.hadm_id, l.charttime, l.itemid, c.loinc_code as code, coalesce(l.valuenum::varchar, l.value) as value
      from labs l join common c on c.itemid = l.itemid where c.cnt >= 100),
    cells as (
      select hadm_id, code, value from (
        select *, row_number() over (partition by hadm_id, code order by charttime, itemid, value nulls first) as rn from measured m
        where exists (select 1 from cohort p where p.subject_id = m.subject_id and m.charttime <= p.index_date
                      and date_sub('day', m.charttime, p.admittime) <= 7))
      where rn = 1 and hadm_id in (select hadm_id from cohort)),
    stats as (
      select code, quantile_cont(x, 0.25) as p25, median(x) as mid, quantile_cont(x, 0.75) as p75 from (
        select code, try_cast(case when value = '<1' then '1' else value end as double) as x from measured where code in ('L1', 'L2', 'L4'))
      group by 1),
    scaled as (
      select c.hadm_id, c.code, (try_cast(c.value as double) - mid) / (p75 - p25) as x from cells c join stats s on s.code = c.code
      where try_cast(c.value as double) is not null),
    b as (select * from cohort where hadm_id in (select hadm_id from cells))
    select b.hadm_id, {", ".join(_COLUMNS)} from b""",
)
def research_table(t):
    out = research.research_table(sources(t), t.microbiology, RESEARCH, Params())
    return out.select(*((F.round(c, 6) + 0.0).alias(c) if c in _NUMERIC else F.col(f"`{c}`") for c in out.columns))


EPOCHS = Params().encoder_training_epochs
_TESTED = """
    select a.hadm_id, m.charttime, max(case when m.interpretation in ('R', 'I') then 1 else 0 end) as y
    from admissions a join microbiology m on m.hadm_id = a.hadm_id
    where m.ab_name = 'F' and m.org_itemid < 60 and date_sub('hour', a.admittime, m.charttime) > 24 group by 1, 2"""


def _encoded(t, name: str):
    src, params = sources(t), Params()
    table, _ = build_features(src, params, RULES, binned=True, labs=staged_labs(t, src, params, name))
    labels = cohort.resistance_labels(t.admissions, t.microbiology, params, ["F"], range(60))
    return encoded.encoded_cohort(table, labels, params)


@query("encoded_cohort", f"{CTES} select c.hadm_id, c.charttime, c.y, 128 as width from ({_TESTED}) c join base b on b.hadm_id = c.hadm_id")
def encoded_cohort(t):
    coded = _encoded(t, "encoded")[0]
    finite = F.forall("encoded", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return coded.select("hadm_id", "charttime", "y", F.when(finite, F.size("encoded")).alias("width"))


@query("encoder_loss", f"select range::int as epoch, true as valid from range(1, {EPOCHS} + 1)")
def encoder_loss(t):
    losses = _encoded(t, "loss")[1].losses
    return loss_rows(t, losses, EPOCHS, 0.005, losses[-1] < losses[0])
