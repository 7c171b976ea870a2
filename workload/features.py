"""The feature table and the labelled cohort."""

from functools import partial

from pyspark.sql import functions as F

from admitflow.operators import learn, sampling
from admitflow.params import Params
from admitflow.plans import baseline, cohort
from admitflow.plans.features import Rules, Sources, build_features, clinical_static, lab_events, population
from admitflow.session import cut_lineage
from admitflow.sources.tables import stage
from workload.registry import query

# The study's lab codes do not occur in the stand-in, so its recodes are given
# for the stand-in's codes: 5 holds words and 7 counted ranges.
RULES = Rules(
    fluids=("blood", "urine"),
    drug_stems=("ring", "bolt"),
    wound_prefixes=("Brand#1",),
    procedure_codes=("purchase", "error"),
    keywords=("license", "ation"),
    lab_recodes=(("5", "open", {"Clear": ["CLEAR"], "Hazy": ["HAZY"]}), ("7", "closed", {"0-2": "1.0", "3-5": "4.0"})),
    dropped_labs=("2",),
    static=("admission_type", "marital_status"),
    static_recode=clinical_static,
)


def sources(t) -> Sources:
    return Sources(t.admissions, t.patients, t.labs, t.lab_items, t.prescriptions, t.diagnoses, t.procedures, t.notes)


def staged_labs(t, src, params, name: str):
    """Each query has its own stage, so running one does not rewrite files another still reads."""
    return stage(t.spark, f"{t.tag}_{name}_lab_events", lambda: lab_events(src, population(src, params), RULES, params))


CTES = r"""
    with events as (
      select hadm_id, itemid::varchar as code, value, flag from (
        select *, row_number() over (partition by hadm_id, itemid order by charttime desc, value desc nulls last, flag desc nulls last) as rn
        from (select l.subject_id, l.hadm_id, l.itemid, l.charttime, coalesce(l.valuenum::varchar, l.value) as value, l.flag
              from labs l join lab_items i on i.itemid = l.itemid
              where (lower(i.fluid) like '%blood%' or lower(i.fluid) like '%urine%') and coalesce(l.valuenum::varchar, l.value) is not null) l
        where exists (select 1 from population p where p.subject_id = l.subject_id and l.charttime <= p.index_date
                      and date_sub('day', l.charttime, p.admittime) <= 7)) where rn = 1),
    cells as (
      select hadm_id, code, value from (
        select hadm_id, code, case when code = '5' then case value when 'CLEAR' then 'Clear' when 'HAZY' then 'Hazy' else value end
          when code = '7' then case value when '0-2' then '1.0' when '3-5' then '4.0' end else value end as value
        from events where code <> '2') where value is not null),
    n as (select count(distinct hadm_id) as n from events),
    kinds as (
      select code, case when n_bad / n_present < 0.05::double then 'numeric' else 'text' end as kind from (
        select code, count(*) as n_present, count(*) filter (try_cast(value as double) is null) as n_bad from cells group by 1), n
      where n.n - n_present <= 0.95::double * n.n),
    static as (
      select a.hadm_id, a.admission_type, coalesce(a.marital_status, 'UNKNOWN') as marital_status,
             case when date_sub('year', s.dob, a.admittime) < 105 then date_sub('year', s.dob, a.admittime)::double end as age
      from admissions a join population p on p.hadm_id = a.hadm_id left join patients s on s.subject_id = a.subject_id),
    base as (select static.* from static where hadm_id in (select hadm_id from events)),
    prev as (
      select a.hadm_id, count(distinct b.hadm_id)::double as x from admissions a join population p on p.hadm_id = a.hadm_id
      join admissions b on a.subject_id = b.subject_id and b.admittime < a.admittime and b.admittime >= a.admittime - interval 360 day group by 1),
    numbers as (
      select c.hadm_id, c.code, try_cast(c.value as double) as x from cells c join kinds k on k.code = c.code and k.kind = 'numeric'
        where c.hadm_id in (select hadm_id from base) and try_cast(c.value as double) is not null
      union all select hadm_id, 'age', age from base where age is not null
      union all select hadm_id, 'n_admits', x from prev),
    hits as (
      select hadm_id, 'wounds' as name from diagnoses where icd9_code like 'Brand#1%'
      union all select hadm_id, 'intubation' from procedures where cpt_cd in ('purchase', 'error')
      union all select n.hadm_id, 'antibiotic_yn' from (
        select hadm_id, charttime, regexp_replace(regexp_replace(lower(text),
          '(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|([\p{L}\p{N}_]+://\S+)|^rt|http.+?', '', 'g'), '\d+', '', 'g') as tx
        from notes where iserror is null) n join population p on p.hadm_id = n.hadm_id and n.charttime <= p.index_date
        where tx like '%license%' or tx like '%ation%'
      union all select r.hadm_id, 'drug:' || drug from prescriptions r join population p on p.hadm_id = r.hadm_id and r.startdate <= p.index_date
        where drug like '%ring%' or drug like '%bolt%')
"""

_HIT_NAMES = ["wounds", "intubation", "antibiotic_yn"]


def _hit(name: str, column: str) -> str:
    return f"""(exists (select 1 from hits h where h.hadm_id = b.hadm_id and h.name = '{name}'))::int::double as "{column}" """


def _words(column: str, levels) -> str:
    """Level columns of a text lab, first level dropped, and its nan column."""
    cell = f"(select max(value) from cells c where c.hadm_id = b.hadm_id and c.code = '{column}')"
    parts = [f"""coalesce({cell} = '{v}', false)::int::double as "{column}_{v}" """ for v in levels[1:]]
    return ", ".join([*parts, f"""({cell} is null)::int::double as "{column}_nan" """])


_DRUGS = [f"{look} {kind}" for look in ("blue", "cold", "hot", "large", "new", "old", "red", "small") for kind in ("bolt", "ring")]
_STATIC_LEVELS = {
    "admission_type": ["F", "O", "P"],
    "marital_status": [
        *(f"{s}{p}" for s in "FOP" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), "UNKNOWN"
    ],
}


def _static_columns() -> list[str]:
    out = []
    for column, levels in _STATIC_LEVELS.items():
        out += [f"""({column} = '{v}')::int::double as "{column}_{v}" """ for v in levels[1:]]
        out.append(f"""({column} is null)::int::double as "{column}_nan" """)
    return out


def _scaled(code: str) -> str:
    return f"""round(coalesce((select max(case when s.low = s.high then null else (x.x - s.median) / (s.low - s.high) end)
      from numbers x join stats s on s.code = x.code where x.hadm_id = b.hadm_id and x.code = '{code}'), 0), 6) + 0.0 as "{code}" """


def _flag(code: str) -> str:
    return f"""coalesce((select max(case when flag is null then -1 else 1 end) from events e where e.hadm_id = b.hadm_id and e.code = '{code}'), 0)::double as "{code}_flag" """


def _bins(code: str, n: int) -> str:
    label = f"""coalesce((select max((x.x > lo + 1 * step and 1 < k)::int + (x.x > lo + 2 * step and 2 < k)::int + (x.x > lo + 3 * step and 3 < k)::int
      + (x.x > lo + 4 * step and 4 < k)::int + (x.x > lo + 5 * step and 5 < k)::int)
      from numbers x join bins s on s.code = x.code where x.hadm_id = b.hadm_id and x.code = '{code}'), {'null' if code == 'n_admits' else '0'})"""
    parts = [f"""coalesce({label} = {i}, false)::int::double as "{code}_{i}" """ for i in range(1, n)]
    nan = f"({label} is null)::int::double" if code == "n_admits" else "0.0::double"
    return ", ".join([*parts, f'{nan} as "{code}_nan"'])


def _flag_words(code: str) -> str:
    word = f"(select max(case when flag is null then 'Normal' else 'Abnormal' end) from events e where e.hadm_id = b.hadm_id and e.code = '{code}')"
    return f"""coalesce({word} = 'Normal', false)::int::double as "{code}_flag_Normal", ({word} is null)::int::double as "{code}_flag_nan" """


def _select(columns: list[str]) -> str:
    return "select b.hadm_id, " + ", ".join(columns) + " from base b"


_HITS = [_hit(n, n) for n in _HIT_NAMES] + [_hit(f"drug:{d}", d) for d in _DRUGS]
_FLAGS = ["1", "2", "4", "5", "7"]
_STATS = """, stats as (
      select code, quantile_cont(x, 0.01) as low, median(x) as median, quantile_cont(x, 0.99) as high from numbers group by 1)"""
_BIN_STATS = """, bins as (
      select code, min(x) as lo, least(count(distinct x), 6) as k, (max(x) - min(x)) / least(count(distinct x), 6) as step from numbers group by 1)"""
_LOOKS = ["Clear", "Cloudy", "Hazy"]

SCALED_SQL = _select([*(_scaled(c) for c in ("1", "4", "7", "age", "n_admits")), *(_flag(c) for c in _FLAGS), _words("5", _LOOKS), *_static_columns(), *_HITS])
BINNED_SQL = _select(
    [_bins("1", 6), _bins("4", 6), _bins("7", 2), _bins("age", 6), _bins("n_admits", 6), *(_flag_words(c) for c in _FLAGS),
     _words("5", _LOOKS), *_static_columns(), *_HITS]
)


def _scaled_features(t, name: str):
    src, params = sources(t), Params()
    features, spec = build_features(src, params, RULES, labs=staged_labs(t, src, params, name))
    numbers = [*spec.numeric, "age", "n_admits"]
    return features.select(*((F.round(f"`{c}`", 6) + 0.0).alias(c) if c in numbers else F.col(f"`{c}`") for c in features.columns))


@query("feature_table", f"{CTES}{_STATS} {SCALED_SQL}")
def feature_table(t):
    return _scaled_features(t, "scaled")


@query("feature_table_binned", f"{CTES}{_BIN_STATS} {BINNED_SQL}")
def feature_table_binned(t):
    src, params = sources(t), Params()
    return build_features(src, params, RULES, binned=True, labs=staged_labs(t, src, params, "binned"))[0]


@query(
    "labelled_cohort",
    f"""{CTES}{_STATS}, features as ({SCALED_SQL})
    select f.*, c.charttime, c.y from features f join (
      select a.hadm_id, m.charttime, max(case when m.interpretation in ('R', 'I') then 1 else 0 end) as y
      from admissions a join microbiology m on m.hadm_id = a.hadm_id
      where m.ab_name = 'F' and m.org_itemid < 60 and date_sub('hour', a.admittime, m.charttime) > 24 group by 1, 2) c
    on c.hadm_id = f.hadm_id""",
)
def labelled_cohort(t):
    labels = cohort.resistance_labels(t.admissions, t.microbiology, Params(), ["F"], range(60))
    return cohort.build_cohort(labels, _scaled_features(t, "cohort"))


@query(
    "organism_cohort",
    f"""{CTES}{_STATS}, features as ({SCALED_SQL})
    select f.*, c.y from features f join (
      select a.hadm_id, max(case when m.interpretation in ('R', 'I', 'S') then m.org_itemid else 0 end) as y
      from admissions a join microbiology m on m.hadm_id = a.hadm_id
      where m.ab_name = 'F' and m.org_itemid < 60 and date_sub('hour', a.admittime, m.charttime) > 24 group by 1) c
    on c.hadm_id = f.hadm_id""",
)
def organism_cohort(t):
    """Admissions labelled with the tested organism, and their features."""
    labels = cohort.organism_labels(t.admissions, t.microbiology, Params(), ["F"], range(60))
    return cohort.build_cohort(labels, _scaled_features(t, "organisms"), "resistant_label")


_COHORT = """
    tested as (
      select a.hadm_id, m.charttime, max(case when m.interpretation in ('R', 'I') then 1 else 0 end) as y
      from admissions a join microbiology m on m.hadm_id = a.hadm_id
      where m.ab_name = 'F' and m.org_itemid < 60 and date_sub('hour', a.admittime, m.charttime) > 24 group by 1, 2),
    cohort as (select t.* from tested t join base b on b.hadm_id = t.hadm_id)"""
_KEYED = "hadm_id::varchar || ':' || strftime(charttime, '%Y-%m-%d %H:%M:%S')"
_MD5 = f"md5({_KEYED} || ':11')"


def _flow_cohort(t, name: str):
    labels = cohort.resistance_labels(t.admissions, t.microbiology, Params(), ["F"], range(60))
    return cohort.build_cohort(labels, _scaled_features(t, name))


@query(
    "cohort_samples",
    f"""{CTES}, {_COHORT.strip()},
    split as (select *, case when r < floor(n * 0.3::double) then 'test' when r < floor(n * 0.3::double) + floor(n * 0.1::double) then 'validation' else 'train' end as split
      from (select *, row_number() over (order by {_MD5}) - 1 as r, count(*) over () as n from cohort)),
    size as (select least(floor(count(*) / 4.0::double), count(*) filter (y = 1)) as pos, count(*) filter (y = 0) as have from split where split = 'train'),
    ranked as (select *, row_number() over (partition by y order by {_MD5}) - 1 as cr, row_number() over (order by {_MD5}) - 1 as g from split where split = 'train'),
    again as (select {_KEYED} as draw, ('0x' || substr(md5({_KEYED} || ':11:draw'), 1, 15))::bigint % have as r from ranked, size where floor(3 * pos) > have and g < floor(3 * pos))
    select hadm_id, charttime, y, split, {_KEYED} as draw from ranked, size
    where (y = 1 and cr < pos) or (y = 0 and floor(3 * pos) <= have and cr < floor(3 * pos))
    union all select x.hadm_id, x.charttime, x.y, x.split, d.draw from again d join ranked x on x.y = 0 and x.cr = d.r
    union all select hadm_id, charttime, y, split, {_KEYED} from split where split <> 'train'""",
)
def cohort_samples(t):
    """The main flow up to training: features, labelled cohort, exact split, ratio sample of the training part."""
    p = Params()
    rows = _flow_cohort(t, "samples").select(*cohort.ROW_KEY, "y")
    out = sampling.generate_samples(
        rows, cohort.ROW_KEY, "y", p.random_state, p.negative_to_positive_ratio, p.test_set_fraction, p.validation_set_fraction
    )
    return out.select(*cohort.ROW_KEY, "y", "split", "draw")


@query(
    "main_flow",
    f"""{CTES}, {_COHORT.strip()},
    exact as (select y, ceil(sum(n) over () * 0.1::double) as want, ceil(sum(n) over () * 0.1::double) * n / sum(n) over () as q from (select y, count(*) as n from cohort group by 1)),
    quota as (select y, floor(q) + (case when row_number() over (order by q - floor(q) desc, y) <= want - sum(floor(q)) over () then 1 else 0 end) as q from exact)
    select hadm_id, charttime, y, true as valid from (select *, row_number() over (partition by y order by {_MD5}) - 1 as r from cohort) join quota using (y) where r < q""",
)
def main_flow(t):
    """Features, labelled cohort, stratified split, oversampling, the study's forest, and the scored test rows."""
    rows = cut_lineage(_flow_cohort(t, "flow"))
    names = [c for c in rows.columns if c not in (*cohort.ROW_KEY, "y")]
    done = baseline.run(rows, cohort.ROW_KEY, "y", names, partial(learn.forest, seed=11), 11, folds=0)
    score = F.col("score")
    fits = F.when(score > 0.5, F.col("prediction") == 1).when(score < 0.5, F.col("prediction") == 0).otherwise(True)
    return done.scored.select(*cohort.ROW_KEY, "y", F.coalesce(score.between(0, 1) & fits, F.lit(False)).alias("valid"))


@query(
    "topk_feature_table",
    f"""{CTES}, {_COHORT.strip()},
    exact as (select y, ceil(sum(n) over () * 0.1::double) as want, ceil(sum(n) over () * 0.1::double) * n / sum(n) over () as q from (select y, count(*) as n from cohort group by 1)),
    quota as (select y, floor(q) + (case when row_number() over (order by q - floor(q) desc, y) <= want - sum(floor(q)) over () then 1 else 0 end) as q from exact)
    select hadm_id, charttime, y, true as valid, 50 as n_kept from (select *, row_number() over (partition by y order by {_MD5}) - 1 as r from cohort) join quota using (y) where r < q""",
)
def topk_feature_table(t):
    """The forest on all features of the labelled cohort, and again on the 50 of them that matter most."""
    rows = cut_lineage(_flow_cohort(t, "topk"))
    names = [c for c in rows.columns if c not in (*cohort.ROW_KEY, "y")]
    split = sampling.split_stratified(rows, cohort.ROW_KEY, "y", 11, 0.1)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    model, best = learn.topk_retrain(train, names, partial(learn.forest, seed=11), 50)
    scored = learn.score(model, test, cohort.ROW_KEY)
    fits = F.col("score").between(0, 1) & F.lit(len(names) > len(best)) & F.lit(set(learn.feature_names(model)) == set(best))
    return scored.select(*cohort.ROW_KEY, "y", F.coalesce(fits, F.lit(False)).alias("valid"), F.lit(len(best)).alias("n_kept"))
