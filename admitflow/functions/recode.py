"""Value recoding: open and closed maps, list tests, numeric coercion."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# A finite decimal number, or infinity. "1.0d" and "1f", which a Java cast
# accepts, are text here; "nan" is a missing value.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def listed(c, values: Iterable) -> Column:
    """``isin`` that is False, not null, for a null value."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def recode_open(c, groups: Mapping) -> Column:
    """``{target: [sources]}``; a value in no group stays as it is.

    A target of None turns its sources into null.
    """
    c = _col(c)
    out = None
    for target, sources in groups.items():
        hit, value = c.isin(list(sources)), F.lit(target).cast("string")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return c if out is None else out.otherwise(c)


def recode_closed(c, mapping: Mapping) -> Column:
    """``{source: target}``; a value that is not listed becomes null."""
    c = _col(c)
    by_target: dict = {}
    for source, target in mapping.items():
        if target is not None:
            by_target.setdefault(target, []).append(source)
    out = F.lit(None).cast("string")
    branches = None
    for target, sources in by_target.items():
        hit = c.isin(sources)
        branches = F.when(hit, F.lit(target)) if branches is None else branches.when(hit, F.lit(target))
    return out if branches is None else branches.otherwise(out)


def keep_listed(c, keep: Iterable, other: str = "OTHER") -> Column:
    """Values outside ``keep``, and null, become ``other``."""
    c = _col(c)
    return F.when(listed(c, keep), c).otherwise(F.lit(other))


def below(c, limit) -> Column:
    """Null out values that are not below ``limit``."""
    c = _col(c)
    return F.when(c < limit, c)


def flag_code(flag) -> Column:
    """Abnormal 1, normal (no flag) -1, unknown flag 0."""
    flag = _col(flag)
    return F.when(flag.isNull(), -1).when(flag.isin("abnormal", "delta"), 1).otherwise(0)


def flag_word(flag) -> Column:
    flag = _col(flag)
    return F.when(flag.isNull(), "Normal").when(flag.isin("abnormal", "delta"), "Abnormal")


def to_number(c) -> Column:
    """Text to double; whatever does not read as a number becomes null."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_whole(c) -> Column:
    """Text to integer; anything but digits with a sign becomes null.

    The test comes first because a failing cast costs far more than a pattern.
    """
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def prefer_number(number, text) -> Column:
    return F.coalesce(_col(number).cast("string"), _col(text))


def not_failed(c, messages: Iterable) -> Column:
    """True for rows whose value is none of the failure messages (null passes)."""
    return ~listed(c, messages)


def contains_any(c, parts: Iterable[str]) -> Column:
    """Any part occurs in the text. Parts that contain another part are implied by it."""
    c = _col(c)
    parts = list(dict.fromkeys(parts))
    needed = [p for p in parts if not any(q != p and q in p for q in parts)]
    return reduce(or_, [c.contains(p) for p in needed], F.lit(False))


def contains_any_once(c: Column, parts: Iterable[str]) -> Column:
    """As ``contains_any``, naming the text once: for a text that is costly to make."""
    parts = list(dict.fromkeys(parts))
    needed = [p for p in parts if not any(q != p and q in p for q in parts)]
    return c.rlike("|".join(re.escape(p) for p in needed)) if needed else F.lit(False)


def starts_any(c, prefixes: Iterable[str]) -> Column:
    c = _col(c)
    return reduce(or_, [c.startswith(p) for p in dict.fromkeys(prefixes)], F.lit(False))
