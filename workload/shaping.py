"""Pivots, indicator columns, profiles of codes, scaling and binning."""

from pyspark.sql import functions as F

from admitflow.functions import recode
from admitflow.operators import events, profile, reshape, scale
from admitflow.operators.labels import organism_or_negative_screen
from workload.registry import query

_ITEMS = [1, 2, 3, 4, 5, 6, 7]
_LAST = """(select * from (select *, row_number() over (partition by hadm_id, itemid
      order by charttime desc, valuenum desc nulls last, flag desc nulls last) as rn from labs) where rn = 1)"""


def _last(t):
    return events.keep_last(t.labs, ["hadm_id", "itemid"], "charttime", ["valuenum", "flag"])


@query(
    "pivot_values",
    "select hadm_id, " + ", ".join(f'max(case when itemid = {i} then valuenum end) as "{i}"' for i in _ITEMS) + f" from {_LAST} group by 1",
)
def pivot_values(t):
    return reshape.pivot_values(_last(t), "hadm_id", "itemid", "valuenum", _ITEMS)


@query(
    "pivot_flags",
    "select hadm_id, "
    + ", ".join(
        f"""coalesce(max(case when itemid = {i} then case when flag is null then -1 else 1 end end), 0)::tinyint as "{i}_flag" """
        for i in _ITEMS
    )
    + f" from {_LAST} group by 1",
)
def pivot_flags(t):
    return reshape.pivot_flags(_last(t), "hadm_id", "itemid", recode.flag_code("flag"), _ITEMS)


_DRUGS = ["small ring", "red widget", "blue bolt", "large bolt"]


@query(
    "pivot_one_hot",
    "select hadm_id, "
    + ", ".join(f"""max(case when drug = '{d}' then 1 else 0 end) as "{d}" """ for d in _DRUGS)
    + " from prescriptions where drug in ("
    + ", ".join(f"'{d}'" for d in _DRUGS)
    + ") group by 1",
)
def pivot_one_hot(t):
    return reshape.one_hot(t.prescriptions, "hadm_id", "drug", _DRUGS)


_STATUS, _PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummies(column, levels):
    return [f"""(coalesce({column} = '{v}', false))::int as "{column}_{v}" """ for v in levels]


@query(
    "get_dummies",
    "select hadm_id, "
    + ", ".join(
        _dummies("status", _STATUS)[1:]
        + ["(status is null)::int as status_nan"]
        + _dummies("priority", _PRIORITY)[1:]
        + ["(priority is null)::int as priority_nan"]
    )
    + " from (select hadm_id, case when hadm_id % 7 <> 0 then admission_type end as status, admission_location as priority from admissions)",
)
def get_dummies(t):
    status = F.when(F.col("hadm_id") % 7 != 0, F.col("admission_type")).alias("status")
    df = t.admissions.select("hadm_id", status, F.col("admission_location").alias("priority"))
    return reshape.get_dummies(df, reshape.fit_levels(df, ["status", "priority"]))


@query(
    "dummies_drop_level",
    "select hadm_id, "
    + ", ".join(_dummies("admission_type", _STATUS[1:]) + _dummies("admission_location", _PRIORITY[:4]))
    + " from admissions",
)
def dummies_drop_level(t):
    df = t.admissions.select("hadm_id", "admission_type", "admission_location")
    levels = reshape.fit_levels(df, ["admission_type", "admission_location"])
    return reshape.get_dummies(df, levels, drop_first=False, nan=False, drop=["admission_type_F", "admission_location_5-LOW"])


_ORGANISMS = [1, 2, 3, 5, 8]


@query(
    "multi_hot_labels",
    "select hadm_id, "
    + ", ".join(f"max(case when org_itemid = {o} then 1 else 0 end) as org_{o}" for o in _ORGANISMS)
    + """ from microbiology where spec_itemid is not null and charttime is not null
      and (org_itemid in (1, 2, 3, 5, 8) or (spec_type_desc = 'MRSA SCREEN' and org_itemid is null)) group by 1""",
)
def multi_hot_labels(t):
    kept = organism_or_negative_screen(t.microbiology, _ORGANISMS, "MRSA SCREEN")
    return reshape.multi_hot(kept, "hadm_id", "org_itemid", _ORGANISMS, "org_")


_CELLS = "(select hadm_id, itemid::varchar as code, coalesce(valuenum::varchar, value) as value from labs)"


def _cells(t):
    return t.labs.select("hadm_id", F.col("itemid").cast("string").alias("code"), recode.prefer_number("valuenum", "value").alias("value"))


@query(
    "drop_sparse",
    f"""
    select code, count(value) as n_present from {_CELLS} group by 1
    having (select count(distinct hadm_id) from labs) - count(value) <= 0.5::double * (select count(distinct hadm_id) from labs)""",
)
def drop_sparse(t):
    n = t.labs.select("hadm_id").distinct().count()
    dense = profile.dense_codes(profile.code_profile(_cells(t)), n, 0.5)
    return dense.select("code", "n_present")


@query(
    "detect_types",
    f"""
    select code, n_present, n_bad, n_unique, case when n_present = 0 then 'weird' when n_bad / n_present < 0.05::double then 'numeric'
      when n_bad / n_present > 0.05::double and n_unique < 100 then 'categorical' else 'weird' end as kind from (
      select code, count(value) as n_present,
             count(*) filter (value is not null and try_cast(value as double) is null) as n_bad,
             count(distinct value) as n_unique from {_CELLS} group by 1)""",
)
def detect_types(t):
    return profile.code_kinds(profile.code_profile(_cells(t)))


@query("drop_codes", "select hadm_id, itemid, valuenum from labs where itemid not in (3, 6)")
def drop_codes(t):
    return t.labs.where(~recode.listed("itemid", [3, 6])).select("hadm_id", "itemid", "valuenum")


def _numbers(t):
    return t.labs.select("hadm_id", "itemid", F.col("valuenum").alias("x"))


def _scaled_sql(low: float, high: float, way: str, where: str = "true") -> str:
    return f"""
    select hadm_id, l.itemid, round(case when {way} = 0 then null else (x - median) / ({way}) end, 6) + 0.0 as x
    from (select hadm_id, itemid, valuenum as x from labs) l left join (
      select itemid, quantile_cont(valuenum, {low}) as low, median(valuenum) as median, quantile_cont(valuenum, {high}) as high
      from labs where {where} group by 1) s on s.itemid = l.itemid"""


@query("scale_p1_p99", _scaled_sql(0.01, 0.99, "low - high"))
def scale_p1_p99(t):
    return scale.scale_p1_p99(_numbers(t), "x", ["itemid"]).withColumn("x", F.round("x", 6) + 0.0)


@query("scale_iqr", _scaled_sql(0.25, 0.75, "high - low", "flag is not null"))
def scale_iqr(t):
    flagged = t.labs.where("flag is not null").select("itemid", F.col("valuenum").alias("x"))
    return scale.scale_iqr(_numbers(t), flagged, "x", ["itemid"]).withColumn("x", F.round("x", 6) + 0.0)


@query(
    "impute_median",
    """
    select hadm_id, itemid, coalesce(valuenum, median(valuenum) over (partition by itemid)) as x from labs""",
)
def impute_median(t):
    return scale.impute_median(_numbers(t), "x", ["itemid"])


@query(
    "bin_equal_width",
    """
    select hadm_id, l.itemid, cast(coalesce((x > lo + 1 * step and 1 < k)::int + (x > lo + 2 * step and 2 < k)::int
      + (x > lo + 3 * step and 3 < k)::int + (x > lo + 4 * step and 4 < k)::int + (x > lo + 5 * step and 5 < k)::int, 0) as varchar) as x
    from (select hadm_id, itemid, valuenum as x from labs) l left join (
      select itemid, min(valuenum) as lo, least(count(distinct valuenum), 6) as k,
             case when count(valuenum) > 0 then (max(valuenum) - min(valuenum)) / least(count(distinct valuenum), 6) end as step
      from labs group by 1) s on s.itemid = l.itemid""",
)
def bin_equal_width(t):
    return scale.bin_equal_width(_numbers(t), "x", ["itemid"])
