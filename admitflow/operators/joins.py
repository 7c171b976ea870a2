"""Joins of events to admissions by key and time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.functions import times
from admitflow.session import cut_lineage, run_dir


# A key is heavy if it holds more than one row in so many of its side's, so there
# are at most as many heavy keys; and more than so many rows.
HEAVY_KEYS, HEAVY_ROWS = 10_000, 100_000
# Into so many parts keys are hashed to see whether any can be heavy.
COARSE = 65_536


def heavy_keys(df: DataFrame, keys: Sequence[str], name: str, least: int = HEAVY_ROWS) -> DataFrame:
    """(*keys, ``name``): keys with more rows than a part should have, and into how many parts to split them.

    A part has ``least`` rows, or one in ``HEAVY_KEYS`` of all rows where that is
    more. So at most ``HEAVY_KEYS`` keys are returned, however large the input.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fair = F.greatest(F.lit(least), F.ceil(counts.agg(F.sum("_n")).scalar() / HEAVY_KEYS))
    return counts.where(F.col("_n") > fair).select(*keys, F.ceil(F.col("_n") / fair).cast("int").alias(name))


def may_be_heavy(df: DataFrame, keys: Sequence[str], least: int = HEAVY_ROWS) -> bool:
    """Whether ``heavy_keys`` could return any. Keys are counted by a coarse hash, so that no more than
    ``COARSE`` counts a task are shuffled, however many keys there are; two numbers come to the driver."""
    part = F.pmod(F.xxhash64(*keys), F.lit(COARSE))
    counts = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    return most is not None and most > max(least, -(-total // HEAVY_KEYS))


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], keep: Column | None = None, least: int = HEAVY_ROWS) -> DataFrame:
    """Inner join on ``keys`` in which heavy keys are split on either side.

    A heavy key's rows are dealt to parts, and the rows of the other side are copied
    to each of them; keys heavy on both sides become a grid of parts. Each pair
    meets once. The heavy keys are broadcast: there are at most ``HEAVY_KEYS`` of
    each side. A row's part follows from its content and its partition, so a task
    that is run again deals alike, and rows that repeat spread too. Null keys match
    nothing. Columns of both sides but the keys must differ.
    """
    keys = list(keys)
    heavy = {"_p": heavy_keys(left, keys, "_p", least), "_q": heavy_keys(right, keys, "_q", least)}
    known = left.join(F.broadcast(heavy["_p"]), keys, "left").join(F.broadcast(heavy["_q"]), keys, "left")
    other = right.join(F.broadcast(heavy["_p"]), keys, "left").join(F.broadcast(heavy["_q"]), keys, "left")
    p, q = F.coalesce("_p", F.lit(1)), F.coalesce("_q", F.lit(1))

    def dealt(df: DataFrame, parts: Column) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns), F.spark_partition_id()), parts).cast("int")

    def copies(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1))

    one = known.withColumn("_i", F.when(p > 1, dealt(left, p)).otherwise(F.lit(0))).withColumn("_j", copies(q)).drop("_p", "_q")
    two = other.withColumn("_j", F.when(q > 1, dealt(right, q)).otherwise(F.lit(0))).withColumn("_i", copies(p)).drop("_p", "_q")
    joined = one.join(two, [*keys, "_i", "_j"])
    return (joined if keep is None else joined.where(keep)).drop("_i", "_j")


def window_join(
    points: DataFrame,
    spans: DataFrame,
    on: str,
    at: str,
    start: Column,
    end: Column,
    keep: Column,
    bucket_days: int,
    least: int = HEAVY_ROWS,
) -> DataFrame:
    """Pair points with the spans of the same ``on`` that hold them.

    ``start`` and ``end`` are expressions over ``spans`` that bound the time of
    any match; they are computed once per span, as ``_start`` and ``_end``.
    ``keep`` is the exact test over both sides and may use these two: it runs for
    every pair in a bucket, so it should only compare. Time is cut into buckets of
    ``bucket_days``: a point lies in one bucket and a span is copied to each bucket
    it touches, so each pair meets exactly once. The join key is (on, bucket): a
    subject with very many rows spreads over its buckets, only rows near in time
    are compared, and a bucket that is still heavy is split. Whether there is one
    is counted first, in a job of its own.
    """
    left = points.withColumn("_bucket", _bucket(F.col(at), bucket_days))
    bounded = spans.withColumns({"_start": start, "_end": end})
    right = _copied_to_buckets(bounded, F.col("_start"), F.col("_end"), bucket_days)
    keys = [on, "_bucket"]
    if may_be_heavy(left.select(*keys), keys, least) or may_be_heavy(right.select(*keys), keys, least):
        matched = split_join(left, right, keys, keep, least)
    else:
        matched = left.join(right, keys).where(keep)
    matched = matched.drop("_bucket")
    return matched.select(*points.columns, *(c for c in spans.columns if c != on))


def _bucket(moment: Column, bucket_days: int) -> Column:
    return F.floor(times.day_number(moment) / F.lit(bucket_days))


def _copied_to_buckets(spans: DataFrame, start: Column, end: Column, bucket_days: int) -> DataFrame:
    return spans.withColumn("_bucket", F.explode(F.sequence(_bucket(start, bucket_days), _bucket(end, bucket_days))))


def events_in_lookback(
    events: DataFrame, population: DataFrame, days: int = 7, on: str = "subject_id", at: str = "charttime"
) -> DataFrame:
    """The events that ``lookback_events`` pairs with at least one admission, once each.

    A span lasts at least ``days`` + 1 days, the width of a bucket, so within a
    bucket it covers the bucket's start or its end. All spans of a subject in a
    bucket therefore come down to two moments, the latest end of those over its
    start and the earliest beginning of those over its end: one row per (subject,
    bucket) to join, however many admissions there are.
    """
    width = days + 1
    oldest, index = F.col("admittime") - times.days(days + 1), F.col("index_date")
    spans = _copied_to_buckets(population.select(on, "admittime", "index_date"), oldest, index, width)
    first_moment = lambda number: F.date_from_unix_date((number * width).cast("int")).cast(population.schema["index_date"].dataType)
    over_start = oldest < first_moment(F.col("_bucket"))
    over_end = index >= first_moment(F.col("_bucket") + 1)
    bounds = spans.groupBy(on, "_bucket").agg(
        F.max(F.when(over_start, index)).alias("_upto"), F.min(F.when(over_end, oldest)).alias("_since")
    )
    near = events.withColumn("_bucket", _bucket(F.col(at), width)).join(bounds, [on, "_bucket"])
    inside = F.coalesce(F.col(at) <= F.col("_upto"), F.lit(False)) | F.coalesce(F.col(at) > F.col("_since"), F.lit(False))
    return near.where(inside).select(*(near[c] for c in events.columns))


def lookback_events(
    events: DataFrame, population: DataFrame, days: int = 7, on: str = "subject_id", at: str = "charttime", least: int = HEAVY_ROWS
) -> DataFrame:
    """Events of a subject at or before an index date and at most ``days`` whole
    days before that admission, once per admission they match.

    ``population`` has ``index_date`` and ``admittime``; its other columns must
    not clash with those of ``events``.
    """
    return window_join(
        events,
        population,
        on,
        at,
        start=F.col("admittime") - times.days(days + 1),
        end=F.col("index_date"),
        keep=(F.col(at) <= F.col("_end")) & (F.col(at) > F.col("_start")),
        bucket_days=days + 2,
        least=least,
    )


def events_until_index(events: DataFrame, population: DataFrame, on: str = "hadm_id", at: str = "startdate") -> DataFrame:
    """Events of an admission up to its index date."""
    return events.join(population, on).where(F.col(at) <= F.col("index_date"))


def previous_admissions(
    admissions: DataFrame,
    population: DataFrame,
    days: int = 360,
    key: str = "hadm_id",
    subject: str = "subject_id",
    admitted: str = "admittime",
) -> DataFrame:
    """Each listed admission with each earlier one of its subject in ``[t - days, t)``."""
    current = admissions.join(population.select(key), key, "left_semi").select(subject, key, admitted)
    earlier = admissions.select(
        subject, F.col(key).alias(f"prev_{key}"), F.col(admitted).alias(f"prev_{admitted}")
    )
    now, then = F.col(admitted), F.col(f"prev_{admitted}")
    pairs = window_join(
        earlier,
        current,
        subject,
        f"prev_{admitted}",
        start=now - times.days(days),
        end=now,
        keep=(then < now) & (then >= F.col("_start")),
        bucket_days=days,
    )
    return pairs.select(key, admitted, f"prev_{key}", f"prev_{admitted}")


def common_items(labs: DataFrame, catalogue: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every catalogue entry with its lab rows, if it has any (right join)."""
    return labs.join(catalogue, list(on), "right")


def positions(df: DataFrame, order: Sequence[str], name: str = "_pos") -> DataFrame:
    """Number rows from 0 in the given order, nulls first.

    Rows are laid out by range and numbered within their range; ranges start where
    the rows before them end. Rows that are equal in ``order`` follow their other
    columns, so a frame's numbers are the same each time.
    """
    rest = [c for c in df.columns if c not in order]
    laid_out = cut_lineage(df.repartitionByRange(*order, *rest).withColumn("_range", F.spark_partition_id()), "positions")
    counts = laid_out.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range reaches this window.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, *rest))
    placed = laid_out.join(starts, "_range")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_start") + within - 1).alias(name))


def concat_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Two frames side by side, row by row in their orders; the shorter one's columns end in nulls.

    The frames need no common key. Their column names must differ.
    """
    one, two = positions(left, left_order), positions(right, right_order)
    return one.join(two, "_pos", "full").drop("_pos")


def store_block(df: DataFrame, on: str, name: str, buckets: int) -> DataFrame:
    """Write a feature block bucketed and sorted by the key, and read it back.

    Blocks stored with the same number of buckets join on the key without a
    shuffle, as often as they are used. Each call makes a table of its own, whose
    files lie in the shared folder.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    # Rows are dealt to the buckets first, so a bucket is one file, not one per task.
    dealt = df.repartition(buckets, on)
    dealt.write.bucketBy(buckets, on).sortBy(on).option("path", f"{run_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def join_blocks(base: DataFrame, blocks: Sequence[DataFrame], on: str, fill=0) -> DataFrame:
    """Left-join feature blocks on the key and fill the gaps.

    Blocks that come out of an aggregation by ``on`` are partitioned by it
    already, so only ``base`` may move.
    """
    out = base
    for block in blocks:
        out = out.join(block, on, "left")
    return out.fillna(fill)
