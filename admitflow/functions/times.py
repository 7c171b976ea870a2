"""Elapsed-time expressions. Units are whole elapsed units, truncated toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def whole_units(unit: str, start, end) -> Column:
    """Whole ``unit``s from ``start`` to ``end``: 24h59m is 24 hours."""
    return F.timestamp_diff(unit, _col(start), _col(end))


def whole_years(born, at) -> Column:
    """Whole years between two moments: n years have passed once the earlier plus n years is reached.

    A date that a year lacks moves to the month's last day, as in date additions:
    who was born on February 29 is a year older on February 28 of a common year.
    """
    born, at = _col(born), _col(at)
    earlier, later = F.least(born, at), F.greatest(born, at)
    years = whole_units("YEAR", earlier, later)
    years = years + (earlier + F.make_ym_interval((years + 1).cast("int")) <= later).cast("bigint")
    return F.when(born.isNotNull() & at.isNotNull(), F.when(at < born, -years).otherwise(years))


def index_date(admitted, window_hours: int) -> Column:
    return _col(admitted) + hours(window_hours)


def ended_by(end, moment, closed: bool = True) -> Column:
    """Did the stay end by ``moment``? An open end counts as not ended."""
    end, moment = _col(end), _col(moment)
    return F.coalesce(end <= moment if closed else end < moment, F.lit(False))


def day_number(moment) -> Column:
    return F.unix_date(F.to_date(_col(moment)))
