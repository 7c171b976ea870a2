"""Who is in the study: admissions still open at their index date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import times


def still_admitted(
    admissions: DataFrame,
    window_hours: int,
    ends=("deathtime", "dischtime"),
    closed: bool = True,
    key: str = "hadm_id",
    subject: str = "subject_id",
    admitted: str = "admittime",
) -> DataFrame:
    """Admissions with none of ``ends`` by admission + ``window_hours``.

    ``closed`` decides whether an end exactly at the index date excludes. One
    narrow pass over the admissions: no shuffle.
    """
    index = times.index_date(admitted, window_hours)
    out = admissions
    for end in ends:
        out = out.where(~times.ended_by(end, index, closed))
    return out.select(subject, key, index.alias("index_date"), admitted)


def after_window(events: DataFrame, window_hours: int, admitted: str = "admittime", at: str = "charttime") -> DataFrame:
    """Events more than ``window_hours`` whole hours after admission, with ``time_to_rslt``."""
    elapsed = times.whole_units("HOUR", admitted, at)
    return events.withColumn("time_to_rslt", elapsed).where(F.col("time_to_rslt") > window_hours)


def label_after_index(
    events: DataFrame,
    window_hours: int,
    label: str = "RESISTANT_YN",
    keys=("subject_id", "hadm_id", "admittime"),
    at: str = "charttime",
) -> DataFrame:
    """One label per admission: the largest among events later than the index date."""
    index = times.index_date(keys[-1], window_hours)
    return (
        events.withColumn("index_date", index)
        .where(F.col("index_date") < F.col(at))
        .groupBy(*keys, "index_date")
        .agg(F.max(label).alias(label))
    )
