"""Joins by key and time."""

from pyspark.sql import functions as F

from admitflow.functions import recode, times
from admitflow.operators import events, joins
from admitflow.plans import cohort
from admitflow.params import Params
from workload.registry import query


@query(
    "join_events_admissions",
    """
    select a.subject_id, a.hadm_id, m.charttime, m.interpretation from admissions a join microbiology m on m.hadm_id = a.hadm_id""",
)
def join_events_admissions(t):
    tests = t.microbiology.select("hadm_id", "charttime", "interpretation")
    return t.admissions.select("subject_id", "hadm_id").join(tests, "hadm_id")


@query(
    "join_population",
    """
    select d.hadm_id, d.icd9_code, p.index_date from diagnoses d join population p on p.hadm_id = d.hadm_id""",
)
def join_population(t):
    return t.diagnoses.join(t.population.select("hadm_id", "index_date"), "hadm_id")


@query(
    "join_lookback_interval",
    """
    select e.hadm_id, e.itemid, e.charttime, p.hadm_id as for_hadm_id
    from labs e join population p on p.subject_id = e.subject_id and e.charttime <= p.index_date
      and date_sub('day', e.charttime, p.admittime) <= 7""",
)
def join_lookback_interval(t):
    pop = t.population.select("subject_id", F.col("hadm_id").alias("for_hadm_id"), "index_date", "admittime")
    seen = joins.lookback_events(t.labs.select("subject_id", "hadm_id", "itemid", "charttime"), pop)
    return seen.select("hadm_id", "itemid", "charttime", "for_hadm_id")


@query(
    "lookback_any",
    """
    select e.hadm_id, e.itemid, e.charttime from labs e where exists (
      select 1 from population p where p.subject_id = e.subject_id and e.charttime <= p.index_date
      and date_sub('day', e.charttime, p.admittime) <= 7)""",
)
def lookback_any(t):
    seen = joins.events_in_lookback(t.labs.select("subject_id", "hadm_id", "itemid", "charttime"), t.population)
    return seen.select("hadm_id", "itemid", "charttime")


@query(
    "join_hot_subject",
    """
    select e.hadm_id, e.itemid, e.charttime, p.hadm_id as for_hadm_id
    from (select *, case when subject_id % 8 = 0 then 8 else subject_id end as subject from labs) e
    join (select *, case when subject_id % 8 = 0 then 8 else subject_id end as subject from population) p
      on p.subject = e.subject and e.charttime <= p.index_date and date_sub('day', e.charttime, p.admittime) <= 7""",
)
def join_hot_subject(t):
    """One subject has an eighth of all events; its buckets are split."""
    hot = F.when(F.col("subject_id") % 8 == 0, F.lit(8)).otherwise(F.col("subject_id")).cast("bigint")
    pop = t.population.select(hot.alias("subject_id"), F.col("hadm_id").alias("for_hadm_id"), "index_date", "admittime")
    labs = t.labs.select(hot.alias("subject_id"), "hadm_id", "itemid", "charttime")
    return joins.lookback_events(labs, pop, least=50).select("hadm_id", "itemid", "charttime", "for_hadm_id")


@query(
    "join_until_index",
    """
    select r.hadm_id, r.drug, r.startdate::varchar as startdate, p.index_date from prescriptions r join population p on p.hadm_id = r.hadm_id
    and r.startdate <= p.index_date""",
)
def join_until_index(t):
    until = joins.events_until_index(t.prescriptions, t.population.select("hadm_id", "index_date"))
    return until.select("hadm_id", "drug", F.col("startdate").cast("string").alias("startdate"), "index_date")


@query(
    "join_previous_360d",
    """
    select a.hadm_id, a.admittime, b.hadm_id as prev_hadm_id, b.admittime as prev_admittime
    from admissions a join population p on p.hadm_id = a.hadm_id
    left join admissions b on a.subject_id = b.subject_id
    where b.admittime < a.admittime and b.admittime >= a.admittime - interval 360 day""",
)
def join_previous_360d(t):
    return joins.previous_admissions(t.admissions, t.population)


@query(
    "join_dim_filtered",
    """
    select e.hadm_id, e.itemid, i.fluid from labs e left join lab_items i on e.itemid = i.itemid
    where lower(i.fluid) like '%blood%' or lower(i.fluid) like '%urine%'""",
)
def join_dim_filtered(t):
    items = t.lab_items.select("itemid", "fluid")
    both = t.labs.select("hadm_id", "itemid").join(items, "itemid", "left")
    return both.where(recode.contains_any(F.lower("fluid"), ["blood", "urine"])).select("hadm_id", "itemid", "fluid")


@query(
    "static_features",
    """
    select a.hadm_id, a.admission_type, a.admission_location, coalesce(a.marital_status, 'UNKNOWN') as marital_status,
           s.gender, date_sub('year', s.dob, a.admittime) as age
    from admissions a join population p on p.hadm_id = a.hadm_id left join patients s on s.subject_id = a.subject_id""",
)
def static_features(t):
    listed = t.admissions.join(t.population.select("hadm_id"), "hadm_id", "left_semi")
    rows = listed.join(t.patients, "subject_id", "left").withColumn("age", times.whole_years("dob", "admittime"))
    return rows.fillna({"marital_status": "UNKNOWN"}).select(
        "hadm_id", "admission_type", "admission_location", "marital_status", "gender", "age"
    )


def _blocks(t):
    wounds = events.any_event(t.diagnoses.where(recode.starts_any("icd9_code", ["Brand#1"])), "hadm_id", "wounds")
    tubes = events.any_event(t.procedures.where(F.col("cpt_cd") == "purchase"), "hadm_id", "intubation")
    items = t.labs.groupBy("hadm_id").agg(F.max("valuenum").alias("top"))
    return [wounds, tubes, items]


@query(
    "assemble_features",
    """
    select p.hadm_id, coalesce(w.wounds, 0) as wounds, coalesce(i.intubation, 0) as intubation, coalesce(l.top, 0) as top
    from population p
    left join (select hadm_id, 1 as wounds from diagnoses where icd9_code like 'Brand#1%' group by 1) w on w.hadm_id = p.hadm_id
    left join (select hadm_id, 1 as intubation from procedures where cpt_cd = 'purchase' group by 1) i on i.hadm_id = p.hadm_id
    left join (select hadm_id, max(valuenum) as top from labs group by 1) l on l.hadm_id = p.hadm_id""",
)
def assemble_features(t):
    return joins.join_blocks(t.population.select("hadm_id"), _blocks(t), "hadm_id")


@query(
    "assemble_stored_blocks",
    """
    select p.hadm_id, coalesce(w.wounds, 0) as wounds, coalesce(i.intubation, 0) as intubation, coalesce(l.top, 0) as top
    from population p
    left join (select hadm_id, 1 as wounds from diagnoses where icd9_code like 'Brand#1%' group by 1) w on w.hadm_id = p.hadm_id
    left join (select hadm_id, 1 as intubation from procedures where cpt_cd = 'purchase' group by 1) i on i.hadm_id = p.hadm_id
    left join (select hadm_id, max(valuenum) as top from labs group by 1) l on l.hadm_id = p.hadm_id""",
)
def assemble_stored_blocks(t):
    """The same blocks, stored by key once: the joins move no rows."""
    base, *blocks = (joins.store_block(b, "hadm_id", "block", 8) for b in (t.population.select("hadm_id"), *_blocks(t)))
    return joins.join_blocks(base, blocks, "hadm_id")


@query(
    "concat_columns",
    """
    select vec_id, c_custkey, c_name from (select vec_id, row_number() over (order by label, vec_id) as i from embeddings) e
    full join (select c_custkey, c_name, row_number() over (order by c_acctbal desc, c_custkey) as i from customer) c using (i)""",
)
def concat_columns(t):
    """Two tables without a common key, side by side by their ranks."""
    customers = t("customer").select((-F.col("c_acctbal")).alias("_by"), "c_custkey", "c_name")
    both = joins.concat_columns(t("embeddings").select("label", "vec_id"), customers, ["label", "vec_id"], ["_by", "c_custkey"])
    return both.select("vec_id", "c_custkey", "c_name")


@query(
    "cohort_join_features",
    """
    select c.hadm_id, c.charttime, f.top, c."RESISTANT_YN" as y from (
      select a.hadm_id, m.charttime, max(case when m.interpretation in ('R', 'I') then 1 else 0 end) as "RESISTANT_YN"
      from admissions a join microbiology m on m.hadm_id = a.hadm_id
      where m.ab_name in ('F') and m.org_itemid in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
        and date_sub('hour', a.admittime, m.charttime) > 24
      group by 1, 2) c
    join (select hadm_id, max(valuenum) as top from labs group by 1) f on f.hadm_id = c.hadm_id""",
)
def cohort_join_features(t):
    labels = cohort.resistance_labels(t.admissions, t.microbiology, Params(), ["F"], [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    features = t.labs.groupBy("hadm_id").agg(F.max("valuenum").alias("top"))
    return cohort.build_cohort(labels, features)


@query(
    "join_right_catalogue",
    """
    select c.itemid, c.label, l.hadm_id, l.value from (select hadm_id, itemid, value from labs where itemid > 2) l
    right join lab_items c on c.itemid = l.itemid""",
)
def join_right_catalogue(t):
    labs = t.labs.where("itemid > 2").select("hadm_id", "itemid", "value")
    return joins.common_items(labs, t.lab_items.select("itemid", "label"), ["itemid"])
