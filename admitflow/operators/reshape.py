"""Long to wide, indicator columns, column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 20_000  # columns a table gets from its data, unless the caller states another bound
NARROW = 32  # up to so many columns a pivot is one aggregation with a condition per column


def bounded(rows: DataFrame, most: int, what: str) -> list:
    """The rows of a frame whose values become columns; more than the caller's bound is an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{what}: more than the stated {most}; keep the long form, or state a larger bound")
    return found


def vocabulary(df: DataFrame, code: str, most: int = WIDEST) -> list:
    """Sorted distinct codes, at most ``most``, since they become column names."""
    rows = df.select(code).where(F.col(code).isNotNull()).distinct()
    return sorted(r[0] for r in bounded(rows, most, f"values of {code}"))


def pivot_values(df: DataFrame, key: str, code: str, value: str, codes: Sequence) -> DataFrame:
    """One column per code. (key, code) must be unique: pick rows first.

    Partitioning by the key up front serves both aggregations that a pivot
    plans, so rows move once. A key has at most one row per code. Spark's pivot
    holds a task's rows by (key, code), and then its keys; a narrow one is
    aggregated by key at once and never holds the rows.
    """
    codes = list(codes)
    keyed = df.where(F.col(key).isNotNull()).select(key, code, value).repartition(F.col(key))
    if len(codes) > NARROW or any(type(c) not in (str, int) for c in codes):
        return keyed.groupBy(key).pivot(code, codes).agg(F.max(value))
    return keyed.groupBy(key).agg(*(F.max(F.when(F.col(code) == F.lit(c), F.col(value))).alias(str(c)) for c in codes))


def pivot_flags(df: DataFrame, key: str, code: str, flag: Column, codes: Sequence) -> DataFrame:
    """``<code>_flag`` columns of -1, 0, 1; no test gives 0."""
    named = df.select(key, F.concat(F.col(code).cast("string"), F.lit("_flag")).alias("_name"), flag.alias("_flag"))
    names = [f"{c}_flag" for c in codes]
    wide = pivot_values(named, key, "_name", "_flag", names)
    return wide.select(key, *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("tinyint").alias(n) for n in names))


def one_hot(df: DataFrame, key: str, code: str, codes: Sequence) -> DataFrame:
    """0/1 column per code that occurs with the key."""
    marked = df.where(F.col(code).isin(list(codes))).select(key, code).distinct().withColumn("_one", F.lit(1))
    return pivot_values(marked, key, code, "_one", codes).fillna(0)


def multi_hot(df: DataFrame, key: str, code: str, codes: Sequence, prefix: str) -> DataFrame:
    """0/1 label columns per key; keys with none of the codes keep a row of zeros."""
    cells = [F.max(F.when(F.col(code) == c, 1).otherwise(0)).alias(f"{prefix}{c}") for c in codes]
    return df.groupBy(key).agg(*cells)


def fit_levels(df: DataFrame, columns: Sequence[str], most: int = WIDEST) -> dict[str, list[str]]:
    """Sorted distinct non-null levels of each string column, at most ``most`` in all."""
    cells = df.select(*columns).unpivot([], list(columns), "_column", "_level").where(F.col("_level").isNotNull())
    rows = bounded(cells.distinct(), most, "levels")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for column, level in rows:
        levels[column].append(level)
    return {c: sorted(found) for c, found in levels.items()}


def dummy_columns(levels: dict[str, list[str]], drop_first: bool = True, nan: bool = True, drop: Sequence[str] = ()) -> list[tuple[str, Column]]:
    """(name, 0/1 expression) per level, in column and level order.

    ``nan`` adds a ``<column>_nan`` indicator; with ``drop_first`` the first of
    the levels and the nan column goes; ``drop`` names further reference levels.
    """
    out = []
    for column, found in levels.items():
        c = F.col(f"`{column}`")
        made = [(f"{column}_{v}", c.eqNullSafe(F.lit(v)).cast("int")) for v in found]
        if nan:
            made.append((f"{column}_nan", c.isNull().cast("int")))
        out += made[1:] if drop_first else made
    return [(name, cell) for name, cell in out if name not in set(drop)]


def get_dummies(df: DataFrame, levels: dict[str, list[str]], **options) -> DataFrame:
    """Replace the string columns by their dummy columns."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in levels]
    return df.select(*kept, *(cell.alias(name) for name, cell in dummy_columns(levels, **options)))


def label_last(df: DataFrame, label: str, name: str = "y") -> DataFrame:
    """Rename the label and put it last."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != label), F.col(f"`{label}`").alias(name))


def sort_columns(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(F.col(f"`{c}`") for c in sorted(df.columns) if c != key))
