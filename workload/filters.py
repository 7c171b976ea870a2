"""Filters, indicators, value cleaning and recoding."""

from pyspark.sql import functions as F

from admitflow.functions import recode, text, times
from admitflow.operators import labels, population, reshape
from admitflow.operators.events import keyword_flag
from admitflow.plans.features import clinical_static, recode_labs
from admitflow.presets import clinical
from admitflow.session import spread
from admitflow.sources.tables import register_view
from workload.registry import query


@query(
    "filter_codes",
    """
    select hadm_id, org_itemid, ab_name, interpretation from microbiology
    where ab_name in ('F') and org_itemid in (1, 2, 3, 5, 8, 13, 21, 34)""",
)
def filter_codes(t):
    chosen = F.col("ab_name").isin("F") & F.col("org_itemid").isin(1, 2, 3, 5, 8, 13, 21, 34)
    return t.microbiology.where(chosen).select("hadm_id", "org_itemid", "ab_name", "interpretation")


@query(
    "filter_contains_any",
    "select hadm_id, drug, startdate::varchar as startdate from prescriptions where drug like '%ring%' or drug like '%bolt%' or drug like '%Bolt%'",
)
def filter_contains_any(t):
    kept = t.prescriptions.where(recode.contains_any("drug", ["ring", "bolt", "Bolt"]))
    return kept.select("hadm_id", "drug", F.col("startdate").cast("string").alias("startdate"))


@query(
    "filter_prefix_any",
    "select hadm_id, icd9_code from diagnoses where icd9_code like 'Brand#1%' or icd9_code like 'Brand#2%'",
)
def filter_prefix_any(t):
    return t.diagnoses.where(recode.starts_any("icd9_code", ["Brand#1", "Brand#2"]))


@query(
    "filter_dim_contains",
    "select itemid, label, fluid from lab_items where lower(fluid) like '%blood%' or lower(fluid) like '%urine%'",
)
def filter_dim_contains(t):
    return t.lab_items.where(recode.contains_any(F.lower("fluid"), clinical.LAB_FLUIDS)).select("itemid", "label", "fluid")


@query(
    "filter_nulls",
    "select hadm_id, spec_itemid, charttime from microbiology where spec_itemid is not null and charttime is not null and org_itemid is null",
)
def filter_nulls(t):
    m = t.microbiology
    kept = m.where(F.col("spec_itemid").isNotNull() & F.col("charttime").isNotNull() & F.col("org_itemid").isNull())
    return kept.select("hadm_id", "spec_itemid", "charttime")


@query(
    "filter_pos_or_null_neg",
    """
    select hadm_id, org_itemid, spec_type_desc from microbiology
    where spec_itemid is not null and charttime is not null
      and (org_itemid in (1, 2, 3, 5, 8) or (spec_type_desc = 'MRSA SCREEN' and org_itemid is null))""",
)
def filter_pos_or_null_neg(t):
    kept = labels.organism_or_negative_screen(t.microbiology, [1, 2, 3, 5, 8], clinical.SCREEN_SPECIMEN)
    return kept.select("hadm_id", "org_itemid", "spec_type_desc")


@query(
    "filter_elapsed_hours",
    """
    select a.hadm_id, m.charttime, date_sub('hour', a.admittime, m.charttime) as time_to_rslt
    from admissions a join microbiology m on m.hadm_id = a.hadm_id
    where date_sub('hour', a.admittime, m.charttime) > 24""",
)
def filter_elapsed_hours(t):
    joined = t.admissions.select("hadm_id", "admittime").join(t.microbiology.select("hadm_id", "charttime"), "hadm_id")
    return population.after_window(joined, 24).select("hadm_id", "charttime", "time_to_rslt")


@query("population_window", "select subject_id, hadm_id, index_date, admittime from population")
def population_window(t):
    name = register_view(population.still_admitted(t.admissions, 24), "all_pts_24_hours")
    return t.spark.table(name)


@query(
    "population_strict",
    """
    select subject_id, hadm_id, admittime + to_hours(24) as index_date, admittime from admissions
    where not coalesce(deathtime < admittime + to_hours(24), false)""",
)
def population_strict(t):
    return population.still_admitted(t.admissions, 24, ends=["deathtime"], closed=False)


@query("index_date", "select hadm_id, admittime + to_hours(24) as index_date from admissions")
def index_date(t):
    return t.admissions.select("hadm_id", times.index_date("admittime", 24).alias("index_date"))


@query(
    "observation_window",
    """
    select subject_id, a.hadm_id, admittime, admittime + to_hours(24) as index_date,
           max(case when interpretation in ('R', 'I') then 1 else 0 end) as "RESISTANT_YN"
    from admissions a join microbiology m on m.hadm_id = a.hadm_id
    where admittime + to_hours(24) < charttime group by 1, 2, 3, 4""",
)
def observation_window(t):
    joined = t.admissions.select("subject_id", "hadm_id", "admittime").join(t.microbiology, "hadm_id")
    return population.label_after_index(labels.resistance_columns(joined), 24)


@query(
    "case_indicators",
    """
    select hadm_id, interpretation, case when interpretation in ('R', 'I') then 1 else 0 end as "RESISTANT_YN",
           case when interpretation = 'S' then 1 else 0 end as "SENSITIVE_YN",
           case when interpretation in ('R', 'I', 'S') then org_itemid else 0 end as "RESISTANT_BACT"
    from microbiology""",
)
def case_indicators(t):
    return labels.resistance_columns(t.microbiology).select(
        "hadm_id", "interpretation", "RESISTANT_YN", "SENSITIVE_YN", "RESISTANT_BACT"
    )


@query("coalesce_value", "select hadm_id, itemid, coalesce(valuenum::varchar, value) as value from labs")
def coalesce_value(t):
    return t.labs.select("hadm_id", "itemid", recode.prefer_number("valuenum", "value").alias("value"))


@query("drop_null_rows", "select hadm_id, itemid, value from labs where value is not null")
def drop_null_rows(t):
    return t.labs.select("hadm_id", "itemid", "value").dropna(subset=["value"])


@query("label_last", "select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus as y from orders")
def label_last(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return reshape.label_last(df, "o_orderstatus")


@query("sorted_columns", "select * from customer")
def sorted_columns(t):
    return reshape.sort_columns(t("customer"), "c_custkey")


_DIRTY = """case when l_suppkey % 50 = 0 then 'UNABLE TO REPORT' when l_quantity < 2 then 'LESS THAN 0,1'
      when l_quantity > 49 then '>50' when l_quantity between 3 and 5 then '1e3' when l_linenumber = 7 then null
      when l_quantity < 9 then ' ' when l_quantity < 11 then '1.0d' else cast(cast(l_quantity as int) as {text}) end"""


def _dirty():
    return F.expr(_DIRTY.format(text="string")).alias("value")


@query(
    "drop_bad_values",
    f"""
    select * from (select l_orderkey, l_linenumber, {_DIRTY.format(text="varchar")} as value from lineitem)
    where value is null or value not in ('UNABLE TO REPORT', 'UNABLE TO ANALYZE')""",
)
def drop_bad_values(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", _dirty())
    return df.where(recode.not_failed("value", clinical.FAILURE_MESSAGES))


@query(
    "to_numeric_coerce",
    f"""
    select l_orderkey, l_linenumber, value, case when value <> '1.0d' then try_cast(trim(value) as double) end as x
    from (select l_orderkey, l_linenumber, {_DIRTY.format(text="varchar")} as value from lineitem)""",
)
def to_numeric_coerce(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", _dirty())
    return df.withColumn("x", recode.to_number("value"))


@query(
    "strip_charset",
    f"""
    select l_orderkey, l_linenumber, replace(ltrim(rtrim(ltrim(ltrim(ltrim(ltrim(value, 'LESS THAN '), 'GREATER THAN '),
      '>GREATER THAN '), '<LESS THAN '), ' NG/ML'), '<>'), ',', '.') as value
    from (select l_orderkey, l_linenumber, {_DIRTY.format(text="varchar")} as value from lineitem)""",
)
def strip_charset(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", _dirty())
    return df.withColumn("value", text.measurement_text("value", clinical.MEASUREMENT_STRIPS))


@query(
    "recode_open",
    """
    select hadm_id, code, case when code = '51501' and value in ('<1', '1', '2') then '0-2'
      when code = '51506' and value = 'CLEAR' then 'Clear' when code = '51506' and value = 'HAZY' then 'Hazy'
      else value end as value
    from (select hadm_id, case itemid when 5 then '51506' else '51501' end as code, value from labs)""",
)
def recode_open(t):
    code = F.when(F.col("itemid") == 5, "51506").otherwise("51501").alias("code")
    df = t.labs.select("hadm_id", code, "value")
    return df.select("hadm_id", "code", recode_labs("code", "value", clinical.LAB_RECODES).alias("value"))


@query(
    "recode_closed",
    """
    select hadm_id, flag, case flag when 'abnormal' then 'A' when 'delta' then 'D' end as word,
           case value when '<1' then '0.0' end as value
    from labs""",
)
def recode_closed(t):
    steps = [s for s in clinical.LAB_RECODES if s[0] == "50911"]
    df = t.labs.select("hadm_id", F.lit("50911").alias("code"), "value", "flag")
    return df.select(
        "hadm_id",
        "flag",
        recode.recode_closed("flag", {"abnormal": "A", "delta": "D"}).alias("word"),
        recode_labs("code", "value", steps).alias("value"),
    )


@query(
    "recode_range_text",
    """
    select hadm_id, case value when '0-2' then 1.0::double when '3-5' then 4.0::double when '<1' then 0.01::double end as x from labs""",
)
def recode_range_text(t):
    mid = recode.recode_closed("value", clinical.RANGE_MIDPOINTS)
    return t.labs.select("hadm_id", recode.to_number(mid).alias("x"))


@query(
    "recode_not_in",
    """
    select hadm_id, case when marital_status in ('F1-URGENT', 'O2-HIGH') then marital_status else 'OTHER' end as status
    from admissions""",
)
def recode_not_in(t):
    return t.admissions.select("hadm_id", recode.keep_listed("marital_status", ["F1-URGENT", "O2-HIGH"]).alias("status"))


@query(
    "consolidate_categories",
    """
    select hadm_id, case when admission_location in ('1-URGENT', '2-HIGH') then 'SOON'
      when admission_location in ('4-NOT SPECIFIED') then null else admission_location end as place,
      coalesce(marital_status, 'UNKNOWN') as marital_status
    from admissions""",
)
def consolidate_categories(t):
    groups = {"SOON": ["1-URGENT", "2-HIGH"], None: ["4-NOT SPECIFIED"]}
    return t.admissions.select(
        "hadm_id",
        recode.recode_open("admission_location", groups).alias("place"),
        clinical_static("marital_status").alias("marital_status"),
    )


@query("fill_constant", "select hadm_id, coalesce(marital_status, 'UNKNOWN') as marital_status, coalesce(deathtime is not null, false) as died from admissions")
def fill_constant(t):
    df = t.admissions.select("hadm_id", "marital_status", F.col("deathtime").isNotNull().alias("died"))
    return df.fillna({"marital_status": "UNKNOWN"})


@query(
    "null_outliers",
    "select l_orderkey, l_linenumber, case when l_quantity < 45 then l_quantity end as q from lineitem",
)
def null_outliers(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", recode.below("l_quantity", 45).alias("q"))


@query(
    "whole_years",
    """
    select hadm_id, date_sub('year', dob, admittime) as age from admissions a left join patients p on p.subject_id = a.subject_id""",
)
def whole_years(t):
    joined = t.admissions.join(t.patients, "subject_id", "left")
    return joined.select("hadm_id", times.whole_years("dob", "admittime").alias("age"))


@query(
    "whole_units",
    """
    select hadm_id, itemid, date_sub('day', charttime, t) as days, date_sub('hour', charttime, t) as hours,
           date_sub('second', charttime, t) as seconds
    from (select hadm_id, itemid, charttime, timestamp '1998-06-01 13:30:10' as t from labs)""",
)
def whole_units(t):
    moment = F.to_timestamp_ntz(F.lit("1998-06-01 13:30:10"))
    return t.labs.select(
        "hadm_id",
        "itemid",
        *(times.whole_units(u, "charttime", moment).alias(n) for u, n in (("DAY", "days"), ("HOUR", "hours"), ("SECOND", "seconds"))),
    )


@query(
    "flag_recode",
    """
    select hadm_id, case when flag is null then -1 when flag in ('abnormal', 'delta') then 1 else 0 end as code,
      case when flag is null then 'Normal' when flag in ('abnormal', 'delta') then 'Abnormal' end as word
    from (select hadm_id, case when itemid = 7 then 'zzz' else flag end as flag from labs)""",
)
def flag_recode(t):
    df = t.labs.select("hadm_id", F.when(F.col("itemid") == 7, "zzz").otherwise(F.col("flag")).alias("flag"))
    return df.select("hadm_id", recode.flag_code("flag").alias("code"), recode.flag_word("flag").alias("word"))


@query(
    "clean_text",
    r"""
    select doc_id, regexp_replace(regexp_replace(lower(text),
      '(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|([\p{L}\p{N}_]+://\S+)|^rt|http.+?', '', 'g'), '\d+', '', 'g') as clean_tx
    from documents""",
)
def clean_text(t):
    return spread(t("documents").select("doc_id", "text")).select("doc_id", text.clean_text("text").alias("clean_tx"))


@query(
    "text_keyword_flag",
    r"""
    select hadm_id, 1 as antibiotic_yn from (
      select hadm_id, regexp_replace(regexp_replace(lower(text),
        '(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|([\p{L}\p{N}_]+://\S+)|^rt|http.+?', '', 'g'), '\d+', '', 'g') as tx
      from notes)
    where tx like '%license%' or tx like '%copyright%' or tx like '%ationx%' group by 1""",
)
def text_keyword_flag(t):
    return keyword_flag(t.notes, "hadm_id", ["license", "copyright", "ationx"], "antibiotic_yn")


@query(
    "cast_types",
    """
    select hadm_id::varchar as id_text, valuenum::int as number, try_cast(value as int) as from_text,
           (flag is not null)::int as flagged from labs""",
)
def cast_types(t):
    return t.labs.select(
        F.col("hadm_id").cast("string").alias("id_text"),
        F.col("valuenum").cast("int").alias("number"),
        recode.to_whole("value").alias("from_text"),
        F.col("flag").isNotNull().cast("int").alias("flagged"),
    )
