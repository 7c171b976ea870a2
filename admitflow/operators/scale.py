"""Scaling, imputing and binning of numeric cells in long form (code, value).

The fitted statistics are a frame with one row per code, joined by code. Whether
it is small enough to be broadcast is seen by Spark from its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.operators.totals import quantiles

def _with_stats(cells: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.join(stats, list(by), "left")


def fit_spread(
    cells: DataFrame, value: str, by: Sequence[str], low: float, high: float, weight: str | None = None
) -> DataFrame:
    """Per code: ``low`` and ``high`` percentile and the median, exact."""
    return quantiles(cells, value, {"low": low, "median": 0.5, "high": high}, by, weight).drop("n")


def scaled(value: Column, median: Column, denominator: Column) -> Column:
    """(x - median) / denominator; a degenerate column (denominator 0) gives null."""
    return F.try_divide(value - median, denominator)


def scale_p1_p99(cells: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(x - median) / (p1 - p99). The denominator is negative: the sign flips."""
    stats = fit_spread(cells, value, by, 0.01, 0.99)
    joined = _with_stats(cells, stats, by)
    out = scaled(F.col(value), F.col("median"), F.col("low") - F.col("high"))
    return joined.withColumn(value, out).drop("low", "median", "high")


def scale_iqr(
    cells: DataFrame, reference: DataFrame, value: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """(x - median) / (p75 - p25), with the statistics of ``reference``, whose rows may have a ``weight``."""
    stats = fit_spread(reference, value, by, 0.25, 0.75, weight)
    joined = _with_stats(cells, stats, by)
    out = scaled(F.col(value), F.col("median"), F.col("high") - F.col("low"))
    return joined.withColumn(value, out).drop("low", "median", "high")


def impute_median(cells: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Fill null cells with the exact median of their code."""
    stats = quantiles(cells, value, {"median": 0.5}, by).drop("n")
    joined = _with_stats(cells, stats, by)
    return joined.withColumn(value, F.coalesce(F.col(value), F.col("median"))).drop("median")


def fit_bins(cells: DataFrame, value: str, by: Sequence[str], most: int = 6) -> DataFrame:
    """Per code: smallest value, step and number of equal-width bins, min(distinct, most)."""
    stats = cells.groupBy(*by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count_distinct(value).alias("_n")
    )
    return stats.select(
        *by,
        F.col("_lo").alias("bin_lo"),
        F.try_divide(F.col("_hi") - F.col("_lo"), F.least(F.col("_n"), F.lit(most))).alias("bin_step"),
        F.least(F.col("_n"), F.lit(most)).alias("bin_count"),
    )


def bin_label(value: Column, lo: Column, step: Column, count: Column, most: int = 6) -> Column:
    """Number of inner edges below the value, as text. Bins are closed on the
    right, the lowest edge belongs to bin 0, and null goes to bin 0."""
    above = [((value > lo + i * step) & (F.lit(i) < count)).cast("int") for i in range(1, most)]
    return F.coalesce(reduce(add, above), F.lit(0)).cast("string")


def bin_equal_width(cells: DataFrame, value: str, by: Sequence[str], most: int = 6) -> DataFrame:
    joined = _with_stats(cells, fit_bins(cells, value, by, most), by)
    label = bin_label(F.col(value), F.col("bin_lo"), F.col("bin_step"), F.col("bin_count"), most)
    return joined.withColumn(value, label).drop("bin_lo", "bin_step", "bin_count")
