"""Labels, counts, profiles and selection of rows."""

from pyspark.sql import functions as F

from admitflow.functions import recode, times
from admitflow.operators import evaluate, events, labels, profile, sampling
from workload.registry import query

_TESTS = """
    from admissions a join microbiology m on m.hadm_id = a.hadm_id
    where m.ab_name in ('F') and m.org_itemid in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
      and date_sub('hour', a.admittime, m.charttime) > 24"""


def _tests(t):
    return labels.tests_after_window(t.admissions, t.microbiology, 24, ["F"], [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])


@query(
    "label_per_test",
    f"""
    select a.subject_id, a.hadm_id, a.admittime, m.charttime,
           max(case when m.interpretation in ('R', 'I') then 1 else 0 end) as "RESISTANT_YN" {_TESTS} group by 1, 2, 3, 4""",
)
def label_per_test(t):
    return labels.label_per_test(_tests(t))


@query(
    "label_organism",
    f"""
    select a.hadm_id, max(case when m.interpretation in ('R', 'I', 'S') then m.org_itemid else 0 end) as resistant_label
    {_TESTS} group by 1""",
)
def label_organism(t):
    return labels.label_per_admission(_tests(t))


@query(
    "label_array_agg",
    """
    select hadm_id, string_agg(org || '/' || ab_name || '/' || yn, ';' order by org, ab_name, yn) as results from (
      select m.hadm_id, m.org_itemid::varchar as org, m.ab_name, case when m.interpretation in ('R', 'I') then '1' else '0' end as yn
      from admissions a join microbiology m on m.hadm_id = a.hadm_id where m.org_itemid is not null)
    group by 1""",
)
def label_array_agg(t):
    tests = t.microbiology.where("org_itemid is not null").join(t.admissions.select("hadm_id"), "hadm_id")
    rows = labels.resistance_columns(tests).select(
        "hadm_id", F.col("org_itemid").cast("string").alias("org"), "ab_name", F.col("RESISTANT_YN").cast("string").alias("yn")
    )
    listed = labels.ordered_results(rows, "hadm_id", ["org", "ab_name", "yn"])
    joined = F.transform("results", lambda r: F.concat_ws("/", r["org"], r["ab_name"], r["yn"]))
    return listed.select("hadm_id", F.concat_ws(";", joined).alias("results"))


@query(
    "count_previous",
    """
    select a.hadm_id, count(distinct b.hadm_id) as n_admits
    from admissions a join population p on p.hadm_id = a.hadm_id
    join admissions b on a.subject_id = b.subject_id and b.admittime < a.admittime
      and b.admittime >= a.admittime - interval 360 day group by 1""",
)
def count_previous(t):
    return events.count_before(t.admissions, 360).join(t.population.select("hadm_id"), "hadm_id", "left_semi")


@query(
    "indicator_any",
    "select hadm_id, 1 as wounds from diagnoses where icd9_code like 'Brand#1%' or icd9_code like 'Brand#2%' group by 1",
)
def indicator_any(t):
    hits = t.diagnoses.where(recode.starts_any("icd9_code", ["Brand#1", "Brand#2"]))
    return events.any_event(hits, "hadm_id", "wounds")


@query(
    "first_event_hours",
    """
    select * from (
      select a.hadm_id, a.admittime, min(date_sub('second', a.admittime, m.charttime) // 3600)::int as hours
      from microbiology m join admissions a on a.hadm_id = m.hadm_id where m.charttime is not null group by 1, 2)
    where hours < 12""",
)
def first_event_hours(t):
    joined = t.microbiology.where("charttime is not null").join(t.admissions.select("hadm_id", "admittime"), "hadm_id")
    return events.first_event_hours(joined, ["hadm_id", "admittime"], "admittime", "charttime").where("hours < 12")


@query(
    "common_items",
    """
    select i.itemid, i.category, i.label, i.fluid, i.loinc_code, count(*) as cnt
    from labs e join lab_items i on i.itemid = e.itemid join admissions a on a.hadm_id = e.hadm_id
    where e.charttime <= a.admittime + interval 24 hour and (lower(i.fluid) like '%blood%' or lower(i.fluid) like '%urine%')
    group by 1, 2, 3, 4, 5 having count(*) >= 100""",
)
def common_items(t):
    dims = ["itemid", "category", "label", "fluid", "loinc_code"]
    items = t.lab_items.where(recode.contains_any(F.lower("fluid"), ["blood", "urine"]))
    seen = t.labs.select("hadm_id", "itemid", "charttime").join(items, "itemid")
    seen = seen.join(t.admissions.select("hadm_id", "admittime"), "hadm_id")
    early = seen.where(F.col("charttime") <= F.col("admittime") + times.hours(24))
    return events.item_counts(early, dims, at_least=100)


@query("class_balance", "select o_orderpriority, count(*) as n from orders group by 1")
def class_balance(t):
    return profile.value_counts(t("orders"), "o_orderpriority")


@query(
    "column_nunique",
    """
    select 'l_suppkey' as "column", count(distinct l_suppkey) as n_distinct from lineitem
    union all select 'l_linenumber', count(distinct l_linenumber) from lineitem
    union all select 'l_discount', count(distinct l_discount) from lineitem
    union all select 'l_returnflag', count(distinct l_returnflag) from lineitem
    union all select 'l_shipdate', count(distinct l_shipdate) from lineitem""",
)
def column_nunique(t):
    return profile.distinct_counts(t("lineitem"), ["l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate"])


def _described(column: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(x, {p}), 4) as {n}" for n, p in profile.DESCRIBE_PROBS.items())
    return f"""select '{column}' as "column", count(x) as "count", round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std,
      min(x) as "min", max(x) as "max", {quantiles} from (select nullif({column}, 0) as x from lineitem)"""


@query("describe_numeric", " union all ".join(_described(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_numeric(t):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    df = t("lineitem").select(*(F.nullif(F.col(c), F.lit(0)).alias(c) for c in columns))
    out = profile.describe_columns(df, columns)
    keep = ("column", "count", "min", "max")
    return out.select(*(c if c in keep else F.round(c, 4).alias(c) for c in out.columns))


@query(
    "column_missing",
    """
    select 'charttime' as "column", count(*) - count(charttime) as n_missing, round((count(*) - count(charttime)) / count(*), 6) as ratio from microbiology
    union all select 'org_itemid', count(*) - count(org_itemid), round((count(*) - count(org_itemid)) / count(*), 6) from microbiology
    union all select 'ab_name', count(*) - count(ab_name), round((count(*) - count(ab_name)) / count(*), 6) from microbiology""",
)
def column_missing(t):
    out = profile.missing(t.microbiology, ["charttime", "org_itemid", "ab_name"])
    return out.withColumn("ratio", F.round("ratio", 6))


@query(
    "matrix_range",
    """
    select min(x)::double as "min", max(x)::double as "max", round(avg(x::double), 6) as mean
    from (select unnest(embedding) as x from embeddings)""",
)
def matrix_range(t):
    out = profile.matrix_range(t("embeddings"), "embedding")
    return out.select(F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), F.round("mean", 6).alias("mean"))


@query("distinct_values", "select distinct l_shipdate from lineitem")
def distinct_values(t):
    return profile.distinct_values(t("lineitem"), "l_shipdate")


@query("non_numeric_values", "select distinct value from labs where value is not null and try_cast(value as double) is null")
def non_numeric_values(t):
    return profile.non_numeric_values(t.labs, "value")


_LAST = """
    select hadm_id, itemid, charttime, valuenum from (
      select *, row_number() over (partition by hadm_id, itemid order by charttime {way}, valuenum {way} {nulls}, flag {way} {nulls}) as rn
      from labs) where rn = 1"""


@query("keep_last", _LAST.format(way="desc", nulls="nulls last"))
def keep_last(t):
    last = events.keep_last(t.labs, ["hadm_id", "itemid"], "charttime", ["valuenum", "flag"])
    return last.select("hadm_id", "itemid", "charttime", "valuenum")


@query("keep_first", _LAST.format(way="asc", nulls="nulls first"))
def keep_first(t):
    first = events.keep_first(t.labs, ["hadm_id", "itemid"], "charttime", ["valuenum", "flag"])
    return first.select("hadm_id", "itemid", "charttime", "valuenum")


@query("distinct_on", "select distinct hadm_id, drug from prescriptions")
def distinct_on(t):
    return events.distinct_on(t.prescriptions, ["hadm_id", "drug"])


@query(
    "rank_topk",
    """
    select l_partkey, score, (row_number() over (order by score desc, l_partkey))::int as rank from (
      select l_partkey, sum(l_quantity) as score from lineitem group by 1 order by 2 desc, 1 limit 50)""",
)
def rank_topk(t):
    scores = t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("score"))
    return evaluate.rank_table(scores, "l_partkey", "score", top=50)


@query(
    "sample_n",
    "select o_orderkey, o_totalprice from orders order by md5(o_orderkey::varchar || ':11') limit 1000",
)
def sample_n(t):
    return sampling.sample_n(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 11)


@query("limit_n", "select vec_id, label from embeddings order by vec_id limit 100")
def limit_n(t):
    return sampling.first_n(t("embeddings").select("vec_id", "label"), 100, "vec_id")


@query(
    "union_samples",
    "select id, y from labelled where y = 1 union all select id, y from labelled where y = 0",
)
def union_samples(t):
    rows = t.labelled
    return sampling.union_rows(rows.where("y = 1").select("id", "y"), rows.where("y = 0").select("id", "y"))


