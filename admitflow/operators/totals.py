"""Running totals and exact quantiles that never put a whole group in one task.

Both work in two levels. Rows are first summed per (group, value) and laid out
by range, so that each partition holds a stretch of one or more groups. Totals
of earlier stretches give each stretch its starting point, and a window runs
only inside one stretch of one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.session import cut_lineage


def range_bucket(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_range``, the range partition of (by, order) a row falls in.

    Spark's range partitioner samples the rows for even splits, so a large group
    spreads over many partitions. The result is checkpointed: it is the one pass
    over what made ``df``, and it fixes the partition numbers.
    """
    return cut_lineage(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    bucket: str,
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``<c>_run``, the total of c up to this row of the group, and ``<c>_all``, the group's total.

    ``order`` must be unique within (by, bucket), and ``bucket`` must grow with
    its first column within a group.
    """
    by = list(by)
    direction = F.desc if descending else F.asc
    per_bucket = df.groupBy(*by, bucket).agg(*(F.sum(c).alias(f"{c}_here") for c in sums))
    ahead = Window.partitionBy(*by).orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # One row per range of a group reaches these two windows.
    starts = per_bucket.select(
        *by,
        bucket,
        *(F.coalesce(F.sum(f"{c}_here").over(ahead), F.lit(0)).alias(f"{c}_start") for c in sums),
        *(F.sum(f"{c}_here").over(whole).alias(f"{c}_all") for c in sums),
    )
    upto = (
        Window.partitionBy(*by, bucket)
        .orderBy(*(direction(c) for c in order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    joined = df.join(starts, [*by, bucket])
    return joined.select(
        *df.columns,
        *((F.col(f"{c}_start") + F.coalesce(F.sum(c).over(upto), F.lit(0))).alias(f"{c}_run") for c in sums),
        *(f"{c}_all" for c in sums),
    )


def _covers(rank: Column) -> Column:
    return (F.col("_n_run") - F.col("_n") <= rank) & (rank < F.col("_n_run"))


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probs`` maps output names to probabilities. Nulls are left out; a group of
    only nulls gives no row (without ``by``: one row of nulls). Also returns
    ``n``, the number of values. The source rows are read once, to count
    (group, value) pairs; the rest works on those counts. ``weight`` names a
    column that says how many rows a row stands for.
    """
    by = list(by)
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(times.alias("_n"))
    run = running_totals(range_bucket(counts, value, by), by, [value], ["_n"], bucket="_range")
    place = {name: (F.col("_n_all") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = F.lit(False)
    ends = []
    for name, at in place.items():
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted = wanted | _covers(rank)
            ends.append(F.max(F.when(_covers(rank), F.col(value))).alias(f"_{name}_{side}"))
    found = run.where(wanted).groupBy(*by).agg(F.max("_n_all").alias("_n_all"), *ends)
    out = [F.col(c) for c in by] + [F.col("_n_all").alias("n")]
    for name, at in place.items():
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*out)
