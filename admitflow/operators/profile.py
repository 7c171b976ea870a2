"""Column and code profiles, computed in long form (one row per measured cell)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions import recode
from admitflow.operators.totals import quantiles, range_bucket, running_totals

# The percentiles of a description.
DESCRIBE_PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}

# Bad share that separates numeric columns, and the distinct
# values a categorical column stays below.
BAD_SHARE = 0.05
CATEGORY_LIMIT = 100


def to_long(df: DataFrame, columns: Sequence[str], kind: str = "string", name: str = "code", value: str = "value") -> DataFrame:
    """One row (code, value) per cell; null cells are kept."""
    cells = df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c in columns))
    return cells.unpivot([], list(columns), name, value)


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, max and exact percentiles, per group."""
    by = list(by)
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    spread = quantiles(df, value, DESCRIBE_PROBS, by).drop("n")
    if by:
        return basic.join(spread, by, "left")
    row = spread.select(F.struct(*spread.columns).alias("s")).scalar()
    return basic.withColumn("_s", row).select("*", "_s.*").drop("_s")


def describe_columns(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """count, mean, std, min, max and exact percentiles of each column; null cells do not count.

    The rows are read twice and never turned into cells. The first pass aggregates,
    and brackets each percentile between two quantiles of a mergeable sketch whose
    ranks are off by at most one in ``accuracy`` of the values. The second counts
    what lies below each bracket and how often each value in it occurs, and the
    percentile is selected exactly among those. A bracket that should miss its
    ranks is opened to the whole column and counted again.
    """
    columns = list(columns)
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    margin, probs = 2.0 / accuracy, list(DESCRIBE_PROBS.values())
    sides = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    one = df.agg(
        *(
            F.struct(
                F.count(x[c]).alias("count"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"),
                F.percentile_approx(x[c], sides, accuracy).alias("sides"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        )
    ).first()
    basic = [one[i] for i in range(len(columns))]
    brackets, ranks = {}, {}
    for i, b in enumerate(basic):
        for j, p in enumerate(probs):
            if b["count"]:
                at = (b["count"] - 1) * p
                ranks[i, j] = (math.floor(at), math.ceil(at))
                lowest, highest = ranks[i, j][0] == 0, ranks[i, j][1] == b["count"] - 1
                brackets[i, j] = (b["min"] if lowest else b["sides"][j], b["max"] if highest else b["sides"][len(probs) + j])
    found: dict[tuple[int, int], tuple[float, float]] = {}
    while brackets:
        seen = _selected(df, [x[c] for c in columns], brackets, ranks)
        for place in list(brackets):
            ends = [seen.get(place, {}).get(rank) for rank in ranks[place]]
            if None in ends:
                brackets[place] = (-math.inf, math.inf)
            else:
                found[place] = tuple(ends)
                del brackets[place]
    rows = []
    for i, (c, b) in enumerate(zip(columns, basic)):
        cells = []
        for j, p in enumerate(probs):
            if (i, j) in found:
                low, high = found[i, j]
                cells.append(low + (high - low) * ((b["count"] - 1) * p - ranks[i, j][0]))
            else:
                cells.append(None)
        rows.append((c, b["count"], b["mean"], b["std"], b["min"], b["max"], *cells))
    names = ", ".join(f"{n} double" for n in ("mean", "std", "min", "max", *DESCRIBE_PROBS))
    return df.sparkSession.createDataFrame(rows, f"column string, count long, {names}")


def _selected(df: DataFrame, columns: Sequence[Column], brackets: dict, ranks: dict) -> dict[tuple[int, int], dict[int, float]]:
    """{(column, bracket): {rank: value}} of the asked ranks whose values lie in their brackets.

    Per task: how many values lie below each bracket, and counts of those in it.
    Spark sums them, lays the values out by range and carries totals from range to
    range; only the values at the asked ranks come to the driver.
    """
    wanted = sorted(brackets.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, inside = Counter(), {place: Counter() for place, _ in wanted}
        for batch in batches:
            arrays = {i: batch.column(i).drop_null().to_numpy(zero_copy_only=False) for i in {i for (i, _), _ in wanted}}
            for place, (low, high) in wanted:
                v = arrays[place[0]]
                below[place] += int((v < low).sum())
                values, counts = np.unique(v[~(v < low) & ~(v > high)], return_counts=True)
                inside[place].update(dict(zip(values.tolist(), counts.tolist())))
        rows = [(*place, None, n) for place, n in below.items() if n]
        rows += [(*place, v, n) for place, held in inside.items() for v, n in held.items()]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64())
        for at in range(0, len(rows), 1 << 16):
            part = list(zip(*rows[at : at + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], ["i", "j", "v", "n"])

    cells = df.select(*(c.alias(f"_{i}") for i, c in enumerate(columns)))
    counted = cells.mapInArrow(work, "i int, j int, v double, n long").groupBy("i", "j", "v").agg(F.sum("n").alias("_n"))
    run = running_totals(range_bucket(counted, "v", ["i", "j"]), ["i", "j"], ["v"], ["_n"], "_range")
    asked = F.create_map(*(F.lit(x) for (i, j), _ in wanted for x in (f"{i}:{j}", list(ranks[i, j]))))
    rank = F.explode(asked[F.concat_ws(":", F.col("i").cast("string"), F.col("j").cast("string"))].cast("array<long>"))
    hits = run.withColumn("_rank", rank).where((F.col("_n_run") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_n_run")))
    out: dict[tuple[int, int], dict[int, float]] = {}
    for r in hits.where(F.col("v").isNotNull()).select("i", "j", "v", "_rank").collect():
        out.setdefault((r.i, r.j), {})[r["_rank"]] = r.v
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of each column, most first."""
    cells = to_long(df, columns, name="column")
    return cells.groupBy("column").agg(F.count_distinct("value").alias("n_distinct")).orderBy(F.desc("n_distinct"), "column")


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and ratio of each column, in one pass over the rows."""
    nulls = df.agg(
        F.count(F.lit(1)).alias("_all"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns)
    )
    cells = nulls.unpivot(["_all"], list(columns), "column", "n_missing")
    return cells.select("column", "n_missing", F.try_divide("n_missing", "_all").alias("ratio"))


def matrix_range(df: DataFrame, row: str) -> DataFrame:
    """min, max and mean over all entries of an array column."""
    per_row = df.select(
        F.array_min(row).alias("lo"),
        F.array_max(row).alias("hi"),
        F.aggregate(row, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"),
        F.size(row).alias("n"),
    )
    mean = F.try_divide(F.sum("total"), F.sum("n"))
    return per_row.agg(F.min("lo").alias("min"), F.max("hi").alias("max"), mean.alias("mean"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def non_numeric_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that do not read as a number."""
    return df.where(F.col(column).isNotNull() & recode.to_number(column).isNull()).select(column).distinct()


def code_profile(cells: DataFrame, code: str = "code", value: str = "value", weight: str | None = None) -> DataFrame:
    """Per code: values present, values that are not numbers, distinct values.

    ``weight`` names a column that says how many rows a row stands for.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    present = F.col(value).isNotNull()
    none = F.lit(0).cast("bigint")
    return cells.groupBy(code).agg(
        F.sum(F.when(present, times).otherwise(none)).alias("n_present"),
        F.sum(F.when(present & recode.to_number(value).isNull(), times).otherwise(none)).alias("n_bad"),
        F.count_distinct(value).alias("n_unique"),
    )


def dense_codes(profile: DataFrame, n_rows, max_sparsity: float) -> DataFrame:
    """Codes missing in at most ``max_sparsity`` of ``n_rows`` rows (exactly that share stays)."""
    total = F.lit(n_rows)
    return profile.where(total - F.col("n_present") <= F.lit(max_sparsity) * total)


def code_kinds(profile: DataFrame) -> DataFrame:
    """numeric, categorical or weird. An empty column, and a bad share of exactly
    the limit, are weird."""
    share = F.try_divide("n_bad", "n_present")
    kind = (
        F.when(share < BAD_SHARE, "numeric")
        .when((share > BAD_SHARE) & (F.col("n_unique") < CATEGORY_LIMIT), "categorical")
        .otherwise("weird")
    )
    return profile.withColumn("kind", kind)
