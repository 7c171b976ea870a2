"""Expressions on array-valued rows and on hashed uniform numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


HASH_BITS = 60  # of hash_int: 15 hex digits


def hash_text(key, seed) -> Column:
    """An order that looks random, and that every SQL engine can repeat. ``key``: a column, or a list of columns."""
    parts = [key] if isinstance(key, (str, Column)) else key
    return F.md5(F.concat_ws(":", *(_col(k).cast("string") for k in parts), F.lit(str(seed))))


def hash_int(key, seed) -> Column:
    """Uniform integer in [0, 2^60): wide enough that its remainder by any number of rows is uniform too."""
    return F.conv(F.substring(hash_text(key, seed), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def argmax(a) -> Column:
    """Zero-based position of the first largest entry."""
    a = _col(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def tail_max(a, k) -> Column:
    """Largest of the last ``k`` entries."""
    a = _col(a)
    k = F.lit(k) if isinstance(k, int) else k
    return F.array_max(F.slice(a, -k, k))


def upper_half_max(a) -> Column:
    """Largest of the second half: the positive labels of a multi-label row."""
    a = _col(a)
    return tail_max(a, F.floor(F.size(a) / 2).cast("int"))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def at_least(p, cut: float = 0.5) -> Column:
    return F.when(_col(p) >= cut, 1).otherwise(0)


def all_but_last(a) -> Column:
    a = _col(a)
    return F.slice(a, F.lit(1), F.size(a) - 1)


def last(a) -> Column:
    return F.element_at(_col(a), -1)


def flip_noise(a, key, p: float, seed) -> Column:
    """Keep each entry x of [0, 1] with chance ``p``, else turn it into 1 - x.

    The draw for entry i of row ``key`` is the hash of "key:i:seed".
    """
    key = _col(key).cast("string")
    limit = int(p * 2**HASH_BITS)

    def flip(x, i):
        draw = hash_int(F.concat_ws(":", key, i.cast("string")), seed)
        return F.when(draw < limit, x).otherwise(1.0 - x)

    return F.transform(_col(a), flip)
