"""Numeric matrices as parquet rows: ``row: array<double>``, label last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import vectors


def to_matrix(df: DataFrame, key: str, label: str | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """Key and one array of all features, the label (or 0.0 without one) last."""
    names = list(features) if features else [c for c in df.columns if c not in (key, label)]
    cells = [F.col(f"`{c}`").cast("double") for c in names]
    y = F.col(f"`{label}`").cast("double") if label else F.lit(0.0)
    return df.select(key, F.array(*cells, y).alias("row"))


def split_xy(df: DataFrame, row: str = "row") -> DataFrame:
    """All but the last entry as ``x``, the last as ``y``."""
    return df.withColumn("x", vectors.all_but_last(row)).withColumn("y", vectors.last(row)).drop(row)


def num_features(df: DataFrame, row: str = "row") -> int:
    first = df.select(F.size(row).alias("n")).first()
    return first.n - 1 if first else 0
