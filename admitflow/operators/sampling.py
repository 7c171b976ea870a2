"""Seeded sampling and splitting with exact counts.

Rows are ordered by md5("key:seed"). A sample of n rows is "all rows whose hash
is at most the n-th smallest hash", so only that one hash must be found: bucket
counts by hash prefix locate it, and rows are ranked only inside the bucket it
falls in. Class sizes and these cut hashes are fitted first (a few values per
class); the sample itself is then a filter, and no row moves to be sampled.
A key is a column or a list of columns that name a row uniquely; rows with an
equal key stay together, and counts are then those of keys' rows only nearly.
Labels are not null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.functions.vectors import hash_int, hash_text
from admitflow.session import cut_lineage

PREFIX = 4  # hex digits: 65,536 buckets per class
Key = str | Sequence[str]


def class_sizes(df: DataFrame, label: str, name: str = "n") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(name))


def class_counts(df: DataFrame, label: str, most: int | None = None) -> dict:
    """{class: rows}, in class order. ``most`` is the caller's bound on the classes, if more would be a mistake."""
    sizes = class_sizes(df, label)
    rows = (sizes if most is None else sizes.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return dict(sorted((r[0], r[1]) for r in rows))


def key_columns(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def draw_key(key: Key) -> Column:
    """One value that names a row: the key column, or its columns joined by colons."""
    return F.col(key) if isinstance(key, str) else F.concat_ws(":", *(F.col(k).cast("string") for k in key))


def _per_class(label: str | None, values: dict, default: Column) -> Column:
    """The value of the row's class; without a label there is one class, None."""
    if label is None:
        return values[None]
    out = None
    for c, value in values.items():
        out = F.when(F.col(label) == c, value) if out is None else out.when(F.col(label) == c, value)
    return default if out is None else out.otherwise(default)


def hash_cuts(df: DataFrame, key: Key, seed, quotas: dict, label: str | None = None) -> dict:
    """For ``{class: [row counts]}``, the hash of the q-th row of the class, for each q.

    A count of 0 has the cut None: no row is below it. Counts must not exceed
    the class size.
    """
    if not any(q > 0 for qs in quotas.values() for q in qs):
        return {c: [None] * len(qs) for c, qs in quotas.items()}
    wanted = {c: F.array(*(F.lit(q).cast("bigint") for q in sorted({q for q in qs if q > 0}))) for c, qs in quotas.items()}
    by = [label] if label else []
    h = hash_text(key, seed)
    hashed = df.select(*by, h.alias("_h"), F.substring(h, 1, PREFIX).alias("_b"))
    counts = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16^PREFIX rows per class reach this window.
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("_run", F.sum("_n").over(upto))
    none = F.array().cast("array<bigint>")
    asked = run.withColumn("_q", F.explode(_per_class(label, wanted, none)))
    edge = asked.where((F.col("_q") > F.col("_run") - F.col("_n")) & (F.col("_q") <= F.col("_run")))
    edge = edge.select(*by, "_b", "_q", (F.col("_q") - F.col("_run") + F.col("_n")).alias("_place"))
    # One edge bucket per class and cut.
    inside = hashed.join(F.broadcast(edge), [*by, "_b"])
    place = F.row_number().over(Window.partitionBy(*by, "_b", "_q").orderBy("_h"))
    found = inside.withColumn("_rn", place).where(F.col("_rn") == F.col("_place")).select(*by, "_q", "_h")
    cut = {(r[label] if label else None, r["_q"]): r["_h"] for r in found.collect()}
    return {c: [cut.get((c, q)) for q in qs] for c, qs in quotas.items()}


def below_cut(key: Key, seed, cuts: dict, i: int = 0, label: str | None = None) -> Column:
    """Is the row among the first q of its class, for cut number ``i``?"""
    h = hash_text(key, seed)
    tests = {c: F.lit(False) if found[i] is None else h <= F.lit(found[i]) for c, found in cuts.items()}
    return _per_class(label, tests, F.lit(False))


def hash_rank(df: DataFrame, key: Key, seed, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Zero-based position of every row in the hash order of its class.

    Rows are ranked inside (class, hash bucket) and shifted by the bucket's start.
    """
    by = list(by)
    h = hash_text(key, seed)
    full = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, PREFIX))
    counts = full.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h"))
    ranked = full.join(starts, [*by, "_b"])
    return ranked.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_start") + inside - 1).alias(name))


def sample_n(df: DataFrame, key: Key, n: int, seed) -> DataFrame:
    """The n first rows in hash order (all rows when there are fewer), filtered where they are."""
    cuts = hash_cuts(df, key, seed, {None: [min(n, df.count())]})
    return df.where(below_cut(key, seed, cuts))


def _before(order: Sequence[str], cut: Sequence) -> tuple[Column, Column]:
    """Whether a row comes before the cut in the order (nulls first), and whether it is level with it."""
    before, level = F.lit(False), F.lit(True)
    for name, value in zip(order, cut):
        c = F.col(f"`{name}`")
        less = F.lit(False) if value is None else c.isNull() | (c < F.lit(value))
        before, level = before | (level & less), level & c.eqNullSafe(F.lit(value))
    return F.coalesce(before, F.lit(False)), F.coalesce(level, F.lit(False))


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` first rows in the order, nulls first; rows level in it follow their other columns. All rows if there are fewer.

    Only the order's values move: they are counted, laid out by range, and totals
    carried from range to range give the value at which the n-th row lies. The rows
    are then filtered where they are, however many are asked for. Rows that are
    level at the cut are settled in the same way by the rest of their columns, and
    of rows alike in all of them as many copies are made as are wanted.
    """
    if n <= 0:
        return df.limit(0)
    rest = [c for c in df.columns if c not in order]
    counts = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    laid_out = cut_lineage(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "order")
    sizes = laid_out.groupBy("_range").agg(F.sum("_n").alias("_here"))
    # One row per range reaches this window.
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_here").over(ahead), F.lit(0)))
    edge = starts.where((F.col("_start") < n) & (F.col("_start") + F.col("_here") >= n)).first()
    if edge is None:
        return df
    inside = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = laid_out.where(F.col("_range") == edge["_range"]).withColumn("_run", F.sum("_n").over(inside) + edge["_start"])
    at = run.where(F.col("_run") >= n).orderBy("_run").first()
    spare = n - (at["_run"] - at["_n"])
    before, level = _before(order, [at[c] for c in order])
    if spare == at["_n"]:
        return df.where(before | level)
    if rest:
        return df.where(before).unionByName(first_n(df.where(level), spare, *order, *rest))
    # Alike in all columns: one row of theirs, as often as wanted.
    again = df.where(level).distinct().withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(spare)))).drop("_copy")
    return df.where(before).unionByName(again)


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _split(df: DataFrame, key: Key, seed, test: int, validation: int) -> DataFrame:
    cuts = hash_cuts(df, key, seed, {None: [test, test + validation]})
    part = F.when(below_cut(key, seed, cuts, 0), "test").when(below_cut(key, seed, cuts, 1), "validation")
    return df.withColumn("split", part.otherwise("train"))


def split_exact(df: DataFrame, key: Key, seed, test: float, validation: float) -> DataFrame:
    """Add ``split``: int(test * n) test rows, int(validation * n) validation rows, the rest train."""
    n = df.count()
    return _split(df, key, seed, int(test * n), int(validation * n))


def split_three_way(df: DataFrame, key: Key, seed, test: float, validation: float, train: float) -> DataFrame:
    """Cut off ceil(test * n); of the rest, ceil of validation / (validation + train) validates."""
    n = df.count()
    tested = math.ceil(test * n)
    return _split(df, key, seed, tested, math.ceil((n - tested) * (validation / (validation + train))))


def stratified_quota(sizes: dict, test: float) -> dict:
    """Rows per class for a test share: ceil(test * n) in all, by largest remainder."""
    total = sum(sizes.values())
    want = math.ceil(total * test)
    exact = {c: want * n / total for c, n in sizes.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(sizes, key=lambda c: (quota[c] - exact[c], c))
    for c in by_remainder[: want - sum(quota.values())]:
        quota[c] += 1
    return quota


def split_stratified(df: DataFrame, key: Key, label: str, seed, test: float) -> DataFrame:
    """Add ``split`` with the test share spread over the classes."""
    quota = stratified_quota(class_counts(df, label), test)
    cuts = hash_cuts(df, key, seed, {c: [q] for c, q in quota.items()}, label)
    return df.withColumn("split", F.when(below_cut(key, seed, cuts, 0, label), "test").otherwise("train"))


def kfold_assign(df: DataFrame, key: Key, label: str, seed, k: int, name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1: each class is cut, in hash order, into k runs of even length."""
    quotas = {c: [n * i // k for i in range(1, k)] for c, n in class_counts(df, label).items()}
    cuts = hash_cuts(df, key, seed, quotas, label)
    past = [(~below_cut(key, seed, cuts, i, label)).cast("int") for i in range(k - 1)]
    return df.withColumn(name, sum(past, F.lit(0)))


def _draw(draws: DataFrame, pool: DataFrame, key: Key, seed, sizes: dict, label: str | None = None) -> DataFrame:
    """For each draw key, one row of the pool (of its class): position hash mod pool size.

    ``draws`` has ``draw`` and the label, if there is one; ``sizes`` has the pool
    size of each class. Positions are spread evenly by the hash, so the join on
    (class, position) has no hot key.
    """
    by = [label] if label else []
    placed = hash_rank(pool, key, seed, by, "_pos")
    size = _per_class(label, {c: F.lit(n).cast("bigint") for c, n in sizes.items()}, F.lit(1).cast("bigint"))
    aimed = draws.select(*by, "draw", F.pmod(hash_int("draw", f"{seed}:draw"), size).alias("_pos"))
    return aimed.join(placed, [*by, "_pos"]).drop("_pos")


def ratio_sample(df: DataFrame, key: Key, label: str, seed, ratio: float) -> DataFrame:
    """Positives : negatives = 1 : ratio. Adds ``draw``, unique within a class.

    pos = min(floor(n / (ratio + 1)), available), neg = floor(ratio * pos).
    Negatives are drawn with replacement when there are too few of them: each of
    ``neg`` rows of the frame stands for one draw (neg < n always).
    """
    sizes = class_counts(df, label)
    have_pos, have_neg = sizes.get(1, 0), sizes.get(0, 0)
    pos = min(math.floor(sum(sizes.values()) / (ratio + 1)), have_pos)
    neg = math.floor(ratio * pos)
    plain = {1: [pos], 0: [neg if neg <= have_neg else 0]}
    once = df.where(below_cut(key, seed, hash_cuts(df, key, seed, plain, label), 0, label)).withColumn("draw", draw_key(key))
    if neg <= have_neg or not have_neg:
        return once
    any_row = hash_cuts(df, key, seed, {None: [neg]})
    draws = df.where(below_cut(key, seed, any_row)).select(draw_key(key).alias("draw"))
    again = _draw(draws, df.where(F.col(label) == 0), key, seed, {None: have_neg})
    return once.unionByName(again.select(*(F.col(f"`{c}`") for c in once.columns)))


def generate_samples(
    df: DataFrame, key: Key, label: str, seed, ratio: float, test: float, validation: float
) -> DataFrame:
    """Split by exact counts, then ratio-sample the training part only.

    The rows are stored first: they are read for several counts and cuts, and
    what made them may be a long plan.
    """
    df = cut_lineage(df, "samples")
    split = split_exact(df, key, seed, test, validation)
    train = ratio_sample(split.where("split = 'train'"), key, label, seed, ratio)
    held = split.where("split != 'train'").withColumn("draw", draw_key(key))
    return train.unionByName(held.select(*(F.col(f"`{c}`") for c in train.columns)))


def oversample_minority(df: DataFrame, key: Key, label: str, seed) -> DataFrame:
    """Add copies of minority rows, drawn with replacement, up to the majority's size.

    Each majority row past the first n_minority (in hash order) stands for one
    draw, so draws are made where the data is. ``draw`` is null for originals.
    """
    originals = df.withColumn("draw", F.when(F.lit(False), draw_key(key)))
    sizes = class_counts(df, label)
    if len(set(sizes.values())) < 2:
        return originals
    few, many = min(sizes, key=sizes.get), max(sizes, key=sizes.get)
    cuts = hash_cuts(df, key, seed, {many: [sizes[few]]}, label)
    past = df.where((F.col(label) == many) & ~below_cut(key, seed, cuts, 0, label)).select(draw_key(key).alias("draw"))
    copies = _draw(past, df.where(F.col(label) == few), key, seed, {None: sizes[few]})
    return originals.unionByName(copies.select(*(F.col(f"`{c}`") for c in originals.columns)))


def draw_counts(splits: Sequence[tuple[str, object, int]], totals: dict, seed: int) -> list[tuple[str, object, int, int]]:
    """(split, class, rows, draws): each class's draws dealt to its splits by a multinomial, in proportion to their rows."""
    out = []
    for k, (c, total) in enumerate(sorted(totals.items(), key=str)):
        mine = sorted((s, n) for s, of, n in splits if of == c)
        rows = np.array([n for _, n in mine], float)
        if total and not len(mine):
            raise ValueError(f"class {c} has no rows to draw from")
        dealt = np.random.default_rng([seed, k]).multinomial(total, rows / rows.sum()) if len(mine) else []
        out += [(s, c, n, int(m)) for (s, n), m in zip(mine, dealt)]
    return out


def draw_rows(df: DataFrame, label: str, totals: dict, seed: int, name: str = "draw") -> DataFrame:
    """``totals[c]`` draws with replacement from the rows of each class c, every row of a class as likely as the other.

    Draws are first dealt to the splits of the stored rows (files, or blocks of
    large ones) by a multinomial, then made within each split: row after row, the
    number of its copies is a binomial of the draws that are left. So totals are
    exact, the copies of all rows together follow a multinomial, and no row moves:
    after the counts there is one narrow stage. The driver sees one number per
    split and class. A row drawn k times comes k times, with ``name`` 0 to k - 1.
    Labels are not null; classes without a total are not drawn.
    """
    rows = cut_lineage(df, "draw-from")
    # A file's number in its folder, and where the block begins; the rest of its name is random.
    file = F.col("_metadata.file_name")
    numbers = (F.regexp_extract(file, r"^part-(\d+)", 1), F.regexp_extract(file, r"(c\d+)\D*$", 1))
    split = F.concat_ws(":", *numbers, F.col("_metadata.file_block_start").cast("string"))
    placed = rows.select("*", split.alias("_split"))
    counted = placed.where(F.col(label).isin(*totals)).groupBy("_split", label).agg(F.count(F.lit(1)).alias("n")).collect()
    dealt = draw_counts([(r["_split"], r[label], r.n) for r in counted], totals, seed)
    kind = dict(df.dtypes)[label]
    plan = df.sparkSession.createDataFrame(dealt, f"_split string, `{label}` {kind}, _rows long, _draws long")

    @F.pandas_udf("long")
    def copies(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        left: dict[tuple, list] = {}  # rows and draws that are left, and the draws' own generator, by split and class
        for split, of, n_rows, n_draws in batches:
            out = np.zeros(len(split), np.int64)
            for i, key in enumerate(zip(split, of)):
                if key not in left:
                    word = hashlib.blake2b(repr((seed, str(key[0]), str(key[1]))).encode(), digest_size=8).digest()
                    left[key] = [int(n_rows.iloc[i]), int(n_draws.iloc[i]), np.random.default_rng(int.from_bytes(word, "big"))]
                state = left[key]
                if state[1]:
                    out[i] = state[2].binomial(state[1], 1.0 / state[0]) if state[0] > 1 else state[1]
                state[0] -= 1
                state[1] -= out[i]
            yield pd.Series(out)

    once = copies.asNondeterministic()  # it counts down: Spark must not run it a second time for the filter
    aimed = placed.join(plan, ["_split", label]).withColumn("_copies", once("_split", label, "_rows", "_draws"))
    drawn = aimed.where("_copies > 0").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return drawn.select(*(F.col(f"`{c}`") for c in df.columns if c != name), name)


def undersample_majority(df: DataFrame, key: Key, label: str, seed, share: float = 0.55) -> DataFrame:
    """Keep int(n_minority / share) rows of the majority class and all others."""
    sizes = class_counts(df, label)
    if not sizes:
        return df
    many = max(sizes, key=sizes.get)
    keep = min(int(min(sizes.values()) / share), sizes[many])
    cuts = hash_cuts(df, key, seed, {many: [keep]}, label)
    return df.where((F.col(label) != many) | below_cut(key, seed, cuts, 0, label))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse class frequency: 1 / count."""
    return class_sizes(df, label).withColumn("weight", 1.0 / F.col("n"))


def weighted_bootstrap(df: DataFrame, key: Key, label: str, seed) -> DataFrame:
    """n draws with replacement, weighted by inverse class frequency.

    Under these weights every class is equally likely: each row stands for one
    draw, its hash picks the class, and a second hash a row within it.
    """
    sizes = class_counts(df, label)
    classes = F.array(*(F.lit(c) for c in sizes))
    draws = df.select(draw_key(key).alias("draw"))
    pick = F.pmod(hash_int("draw", f"{seed}:class"), F.lit(len(sizes))).cast("int")
    draws = draws.select("draw", F.get(classes, pick).alias(label))
    return _draw(draws, df, key, seed, sizes, label)


def balance_table(label: str, **frames: DataFrame) -> DataFrame:
    """Class counts of several row sets, one row per (set, class)."""
    parts = [
        class_sizes(f, label, "count").select(F.lit(name).alias("training_set"), label, "count")
        for name, f in frames.items()
    ]
    return union_rows(*parts)
