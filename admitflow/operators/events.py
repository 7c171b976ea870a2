"""Selecting and aggregating events of an admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.functions import recode, text, times
from admitflow.operators.joins import HEAVY_ROWS, may_be_heavy
from admitflow.operators.totals import running_totals


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # Filtering the row number to 1 plans a WindowGroupLimit before the shuffle
    # too: each task sends one row per group at most, however large the group.
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str], at: str = "charttime", tiebreak: Sequence[str] = ()) -> DataFrame:
    """The latest row per key; equal times go to the largest tie-break columns."""
    return _pick(df, keys, [F.desc(at), *(F.desc(c) for c in tiebreak)])


def keep_first(df: DataFrame, keys: Sequence[str], at: str = "charttime", tiebreak: Sequence[str] = ()) -> DataFrame:
    return _pick(df, keys, [F.asc(at), *(F.asc(c) for c in tiebreak)])


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, or the bare keys without an order."""
    if not order:
        return df.select(*keys).distinct()
    return _pick(df, keys, [F.asc(c) for c in order])


def any_event(df: DataFrame, key: str, name: str) -> DataFrame:
    """Key and a constant 1 for each key with at least one row."""
    return df.groupBy(key).agg(F.lit(1).alias(name))


def keyword_rows(notes: DataFrame, words: Sequence[str], body: str = "text") -> DataFrame:
    """Notes that hold any of the words after cleaning; the text itself is dropped.

    Runs in the scan's own tasks: call it before a join, and no text is shuffled.
    The words are one pattern, so the cleaned text is made once per note and not
    once per word.
    """
    return notes.where(recode.contains_any_once(text.clean_text(body), words)).drop(body)


def keyword_flag(notes: DataFrame, key: str, words: Sequence[str], name: str, body: str = "text") -> DataFrame:
    """1 for each key with a note that holds any of the words after cleaning."""
    return any_event(keyword_rows(notes, words, body), key, name)


def count_before(
    admissions: DataFrame,
    days: int = 360,
    name: str = "n_admits",
    key: str = "hadm_id",
    subject: str = "subject_id",
    admitted: str = "admittime",
    least: int = HEAVY_ROWS,
) -> DataFrame:
    """Number of the subject's admissions in ``[t - days, t)``, for keys with any.

    Equals a distinct count over ``previous_admissions`` but makes no pairs: it
    is the running count before t less the running count before t - days. Whether
    a subject can be heavy (``least``) is counted first, in a job of its own. If none can, a
    subject's counts run in one piece; else they are summed per (subject, moment)
    first, then run per (subject, day).
    """
    dated = admissions.select(key, subject, admitted).where(F.col(subject).isNotNull() & F.col(admitted).isNotNull())
    if not may_be_heavy(dated.select(subject), [subject], least):
        return _count_before_whole(dated, days, name, key, subject, admitted)
    moments = admissions.groupBy(subject, admitted).agg(F.count(F.lit(1)).alias("_n"))
    now = moments.select(subject, admitted, F.col(admitted).alias("_at"), "_n", F.lit(1).alias("_sign"))
    old = moments.select(
        subject, admitted, (F.col(admitted) - times.days(days)).alias("_at"), F.lit(0).alias("_n"), F.lit(-1).alias("_sign")
    )
    marks = now.unionByName(old).withColumn("_day", times.day_number("_at"))
    # At one moment the question about the past (sign -1) comes before the admission itself.
    run = running_totals(marks, [subject], ["_at", "_sign"], ["_n"], bucket="_day", inclusive=False)
    counted = run.groupBy(subject, admitted).agg(F.sum(F.col("_sign") * F.col("_n_run")).alias(name))
    return admissions.select(key, subject, admitted).join(counted.where(F.col(name) > 0), [subject, admitted]).select(key, name)


def _count_before_whole(dated: DataFrame, days: int, name: str, key: str, subject: str, admitted: str) -> DataFrame:
    """``count_before`` with all rows of a subject in one task: they are shuffled once, and all else happens where they are.

    Each row asks how many came before t and before t - days (``_sign``), and is one that is counted (``_n``); at one
    moment questions come first.
    """
    at = F.col(admitted)
    mark = lambda at, sign, n: F.struct(at.alias("_at"), F.lit(n).alias("_n"), F.lit(sign).alias("_sign"))
    marks = F.explode(F.array(mark(at, 1, 0), mark(at - times.days(days), -1, 0), mark(at, 0, 1)))
    rows = dated.repartition(subject).withColumn("_row", F.monotonically_increasing_id()).select(key, subject, "_row", marks.alias("_m"))
    before = Window.partitionBy(subject).orderBy("_at", "_n").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.select(key, subject, "_row", "_m.*").withColumn("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counted = run.where("_sign <> 0").groupBy(subject, "_row", key).agg(F.sum(F.col("_sign") * F.col("_run")).alias(name))
    return counted.where(F.col(name) > 0).select(key, name)


def first_event_hours(events: DataFrame, keys: Sequence[str], admitted: str, at: str, name: str = "hours") -> DataFrame:
    """Whole hours from admission to the first event; an event up to 59 minutes before is at hour 0."""
    return events.groupBy(*keys).agg(F.min(times.whole_units("HOUR", admitted, at)).cast("int").alias(name))


def item_counts(events: DataFrame, dims: Sequence[str], at_least: int = 1, name: str = "cnt") -> DataFrame:
    """How often each dimension tuple occurs, most frequent first."""
    counted = events.groupBy(*dims).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= at_least)
    return counted.orderBy(F.desc(name), *dims)
