"""The study's tables, stood in for by the shared test tables.

Each role exists twice with the same columns: as a DataFrame and as SQL text.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.operators.population import still_admitted
from admitflow.session import spread


# Roles in an order where each uses only earlier ones.
ROLE_SQL = {
    "admissions": """
        select o_orderkey as hadm_id, o_custkey as subject_id, o_orderdate as admittime,
               o_orderdate + to_hours(((o_orderkey % 5) * 12)::int) as dischtime,
               case when o_orderkey % 11 = 0 then o_orderdate + to_hours(((o_orderkey % 7) * 12)::int) end as deathtime,
               o_orderstatus as admission_type, o_orderpriority as admission_location,
               case when o_orderkey % 3 = 0 then null else o_orderstatus || o_orderpriority end as marital_status
        from orders""",
    "patients": """
        select c_custkey as subject_id, c_mktsegment as gender,
               timestamp '1980-01-01 00:00:00' - to_days((c_custkey % 36500)::int) as dob
        from customer""",
    "labs": """
        select o.o_custkey as subject_id, l_orderkey as hadm_id, l_linenumber::bigint as itemid, l_shipdate as charttime,
               case when l_linenumber <= 4 and l_quantity >= 2 then l_quantity end as valuenum,
               case when l_linenumber <= 4 then '<1'
                    when l_linenumber = 5 then case l_returnflag when 'A' then 'CLEAR' when 'N' then 'HAZY' else 'Cloudy' end
                    when l_linenumber = 6 then null
                    else case when l_quantity < 11 then '0-2' when l_quantity < 31 then '3-5' else 'LOADED' end end as value,
               case l_returnflag when 'R' then 'abnormal' when 'A' then 'delta' end as flag
        from lineitem join orders o on o.o_orderkey = l_orderkey""",
    "lab_items": """
        select p_partkey as itemid, p_name as label,
               case p_partkey % 3 when 0 then 'Ascites' when 1 then 'Blood' else 'URINE' end as fluid,
               p_brand as category, 'L' || p_partkey as loinc_code
        from part""",
    "microbiology": """
        select l_orderkey as hadm_id, case when l_tax = 0 then null else l_shipdate end as charttime,
               case when l_discount = 0 then null else l_suppkey end as org_itemid, l_linestatus as ab_name,
               case l_returnflag when 'R' then 'R' when 'A' then 'I' else 'S' end as interpretation,
               nullif(l_linenumber, 7) as spec_itemid,
               case when l_linenumber <= 2 then 'MRSA SCREEN' else 'BLOOD CULTURE' end as spec_type_desc
        from lineitem""",
    "prescriptions": """
        select l_orderkey as hadm_id, l_shipdate::date as startdate, l_shipdate::date + 7 as enddate, p_name as drug
        from lineitem join part on p_partkey = l_partkey""",
    "diagnoses": """
        select l_orderkey as hadm_id, p_brand as icd9_code from lineitem join part on p_partkey = l_partkey""",
    "procedures": """
        select user_id as hadm_id, ts::date as chartdate, event_type as cpt_cd from events""",
    "notes": """
        select doc_id as row_id, doc_id % 400 as hadm_id,
               timestamp '1992-01-01 00:00:00' + to_days(((doc_id * 17) % 3000)::int) as charttime, text,
               case when doc_id % 50 = 0 then 1 end as iserror
        from documents""",
    "population": """
        select subject_id, hadm_id, admittime + to_hours(24) as index_date, admittime from admissions
        where not coalesce(deathtime <= admittime + to_hours(24), false)
          and not coalesce(dischtime <= admittime + to_hours(24), false)""",
    # one scored row per order: a coarse score with many ties, and a label it partly predicts
    "scored": """
        select l_orderkey as id, l_linenumber as line, l_discount * 10 as score,
               case when l_discount * 10 >= 0.5 then 1 else 0 end as predicted,
               case when l_returnflag = 'R' or l_discount + l_tax > 0.12 then 1 else 0 end as label
        from lineitem""",
    "labelled": """
        select o_orderkey as id, case when o_orderpriority = '1-URGENT' then 1 else 0 end as y, o_totalprice as x
        from orders""",
}


def with_roles(sql: str) -> str:
    """Prefix the role definitions a query names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for role, body in ROLE_SQL.items():
            if role not in needed and re.search(rf"\b(from|join)\s+{role}\b", text, re.I):
                need(body)
                if role not in needed:
                    needed.append(role)

    need(sql)
    body = sql.strip()
    if not needed:
        return body
    parts = ",\n".join(f"{r} as ({ROLE_SQL[r]})" for r in needed)
    if re.match(r"with\b", body, re.I):
        return f"with {parts},\n{body[4:].lstrip()}"
    return f"with {parts}\n{body}"


class Tables:
    """The tables of one scale folder, and the roles they play."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def tag(self) -> str:
        """A name for this folder, for stages."""
        return re.sub(r"\W+", "_", self.folder).strip("_")

    @cached_property
    def admissions(self) -> DataFrame:
        half_days = lambda n: F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % n * 12).cast("int"))
        at = F.col("o_orderdate")
        return self("orders").select(
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_custkey").alias("subject_id"),
            at.alias("admittime"),
            (at + half_days(5)).alias("dischtime"),
            F.when(F.col("o_orderkey") % 11 == 0, at + half_days(7)).alias("deathtime"),
            F.col("o_orderstatus").alias("admission_type"),
            F.col("o_orderpriority").alias("admission_location"),
            F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_orderstatus", "o_orderpriority")).alias("marital_status"),
        )

    @cached_property
    def patients(self) -> DataFrame:
        start = F.to_timestamp_ntz(F.lit("1980-01-01 00:00:00"))
        back = F.make_dt_interval((F.col("c_custkey") % 36500).cast("int"))
        return self("customer").select(
            F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("gender"), (start - back).alias("dob")
        )

    @cached_property
    def labs(self) -> DataFrame:
        n, q = F.col("l_linenumber"), F.col("l_quantity")
        flag = F.col("l_returnflag")
        looks = F.when(flag == "A", "CLEAR").when(flag == "N", "HAZY").otherwise("Cloudy")
        counts = F.when(q < 11, "0-2").when(q < 31, "3-5").otherwise("LOADED")
        subjects = self("orders").select("o_orderkey", "o_custkey")
        return (
            self("lineitem")
            .join(subjects, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("subject_id"),
                F.col("l_orderkey").alias("hadm_id"),
                n.cast("bigint").alias("itemid"),
                F.col("l_shipdate").alias("charttime"),
                F.when((n <= 4) & (q >= 2), q).alias("valuenum"),
                F.when(n <= 4, "<1").when(n == 5, looks).when(n == 7, counts).alias("value"),
                F.when(flag == "R", "abnormal").when(flag == "A", "delta").alias("flag"),
            )
        )

    @cached_property
    def lab_items(self) -> DataFrame:
        third = F.col("p_partkey") % 3
        return self("part").select(
            F.col("p_partkey").alias("itemid"),
            F.col("p_name").alias("label"),
            F.when(third == 0, "Ascites").when(third == 1, "Blood").otherwise("URINE").alias("fluid"),
            F.col("p_brand").alias("category"),
            F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("loinc_code"),
        )

    @cached_property
    def microbiology(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self("lineitem").select(
            F.col("l_orderkey").alias("hadm_id"),
            F.when(F.col("l_tax") != 0, F.col("l_shipdate")).alias("charttime"),
            F.when(F.col("l_discount") != 0, F.col("l_suppkey")).alias("org_itemid"),
            F.col("l_linestatus").alias("ab_name"),
            F.when(flag == "R", "R").when(flag == "A", "I").otherwise("S").alias("interpretation"),
            F.nullif(F.col("l_linenumber"), F.lit(7)).alias("spec_itemid"),
            F.when(F.col("l_linenumber") <= 2, "MRSA SCREEN").otherwise("BLOOD CULTURE").alias("spec_type_desc"),
        )

    @cached_property
    def _lines_with_part(self) -> DataFrame:
        return self("lineitem").join(self("part"), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def prescriptions(self) -> DataFrame:
        start = F.to_date("l_shipdate")
        return self._lines_with_part.select(
            F.col("l_orderkey").alias("hadm_id"),
            start.alias("startdate"),
            F.date_add(start, 7).alias("enddate"),
            F.col("p_name").alias("drug"),
        )

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self._lines_with_part.select(F.col("l_orderkey").alias("hadm_id"), F.col("p_brand").alias("icd9_code"))

    @cached_property
    def procedures(self) -> DataFrame:
        return self("events").select(
            F.col("user_id").alias("hadm_id"), F.to_date("ts").alias("chartdate"), F.col("event_type").alias("cpt_cd")
        )

    @cached_property
    def notes(self) -> DataFrame:
        start = F.to_timestamp_ntz(F.lit("1992-01-01 00:00:00"))
        shift = F.make_dt_interval((F.col("doc_id") * 17 % 3000).cast("int"))
        return spread(self("documents").select("doc_id", "text")).select(
            F.col("doc_id").alias("row_id"),
            (F.col("doc_id") % 400).alias("hadm_id"),
            (start + shift).alias("charttime"),
            "text",
            F.when(F.col("doc_id") % 50 == 0, 1).alias("iserror"),
        )

    @cached_property
    def population(self) -> DataFrame:
        return still_admitted(self.admissions, 24)

    @cached_property
    def scored(self) -> DataFrame:
        score = F.col("l_discount") * 10
        hit = (F.col("l_returnflag") == "R") | (F.col("l_discount") + F.col("l_tax") > 0.12)
        return self("lineitem").select(
            F.col("l_orderkey").alias("id"),
            F.col("l_linenumber").alias("line"),
            score.alias("score"),
            F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
            F.when(hit, 1).otherwise(0).alias("label"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return self("orders").select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("y"),
            F.col("o_totalprice").alias("x"),
        )


__all__ = ["ROLE_SQL", "Tables", "with_roles"]
