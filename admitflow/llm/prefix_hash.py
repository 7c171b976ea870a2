"""Document fingerprints from prefix polynomial hashes.

One pass over a text gives arrays of prefix sums of c[k] * B^k modulo a prime,
for two bases. From them the hash of any span is one subtraction and one
multiplication, so spans of one or two texts are compared without reading them
again, and the longest common extension of two places is found by binary search.

A fingerprint holds the smallest hashes of all windows of a fixed width: a
sketch from which the share of common windows of two texts is estimated. Because
window hashes depend on the window only, the fingerprint of a spliced text is
made from the windows of its parts and the few that cross the seam.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import by_batch, text_of

# A Mersenne prime, so that remainders need no division; two bases make 62 bits.
BITS = 31
PRIME = (1 << BITS) - 1
BASES = (1_000_003, 823_117_489)
# Code points in a window, and hashes in a fingerprint, each of eight hexadecimal digits.
WIDTH, KEPT = 16, 64
DIGITS = 8
# Stands for a null id in the order: below every other, and its negative is a number too.
LOWEST = 1 - (1 << 63)

_M, _S = np.uint64(PRIME), np.uint64(BITS)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> _S)
    x = (x & _M) + (x >> _S)
    return np.where(x >= _M, x - _M, x)


class _Powers:
    """Powers of a base and of its inverse, extended on demand by doubling."""

    def __init__(self, base: int):
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.bases = (base, pow(base, PRIME - 2, PRIME))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, base in enumerate(self.bases):
            while len(self.tables[k]) < n:
                table = self.tables[k]
                step = np.uint64(pow(base, len(table), PRIME))
                self.tables[k] = np.concatenate([table, _mod(table * step)])
        return self.tables[0][:n], self.tables[1][:n]


_POWERS = tuple(_Powers(b) for b in BASES)


class PrefixHash:
    """The prefix arrays of one text, by code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(points * powers.upto(self.n)[0]), out=sums[1:])
            self.sums.append(_mod(sums))

    def span(self, start: int, end: int) -> int:
        """The hash of the code points from ``start`` to before ``end``, the same wherever they stand."""
        parts = []
        for sums, powers in zip(self.sums, _POWERS):
            inverse = int(powers.upto(start + 1)[1][start])
            parts.append((int(sums[end]) - int(sums[start])) % PRIME * inverse % PRIME)
        return parts[0] << BITS | parts[1]

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all spans of ``width`` code points, by start."""
        count = self.n - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(count, np.uint64)
        for sums, powers in zip(self.sums, _POWERS):
            part = _mod((sums[width:] + _M - sums[:count]) * powers.upto(count)[1])
            out = out << _S | part
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """How many code points the two texts share from these places on, by binary search over equal spans."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Polynomial hashes spread over 64 bits, so that the smallest are a fair draw."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - 4 * DIGITS)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The KEPT smallest different values, in order."""
    size = 4 * KEPT
    while True:
        part = np.unique(hashes if len(hashes) <= size else np.partition(hashes, size - 1)[:size])
        if len(part) >= KEPT or size >= len(hashes):
            return part[:KEPT]
        size *= 4


class Sketched:
    """A text with what its fingerprint, and those of texts spliced from it, are made of."""

    def __init__(self, text: str):
        self.text, self.prefix = text, PrefixHash(text)
        self.hashes = _mixed(self.prefix.windows(WIDTH))
        self.sketch = smallest(self.hashes if len(self.hashes) else whole(self.prefix))


def whole(prefix: PrefixHash) -> np.ndarray:
    """The one hash of a text shorter than a window; none of an empty text."""
    return _mixed(np.array([prefix.span(0, prefix.n)] if prefix.n else [], np.uint64))


def spliced(head: Sketched, keep: int, tail: Sketched, take: int) -> np.ndarray:
    """The sketch of the first ``keep`` code points of one text followed by the first ``take`` of another."""
    seam = PrefixHash(head.text[max(0, keep - WIDTH + 1) : keep] + tail.text[: min(take, WIDTH - 1)])
    if keep + take < WIDTH:
        return smallest(whole(seam))
    crossing = _mixed(seam.windows(WIDTH))
    return smallest(np.concatenate([head.hashes[: max(0, keep - WIDTH + 1)], crossing, tail.hashes[: max(0, take - WIDTH + 1)]]))


def fingerprint_of(sketch: np.ndarray) -> str:
    return "".join(f"{v:0{DIGITS}x}" for v in sketch.tolist())


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The estimated share of common windows, 2J / (1 + J) for a Jaccard similarity J. Two empty texts are alike."""
    union = np.union1d(one, other)[:KEPT]
    if not len(union):
        return 1.0
    both = np.isin(union, one, assume_unique=True) & np.isin(union, other, assume_unique=True)
    common = float(both.sum()) / len(union)
    return 2 * common / (1 + common)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint): of every whole text; null and empty texts have the empty fingerprint. One narrow pass."""
    source = docs.select(F.col(id_column), text_of(text_column).alias("_text"))

    def make():
        return lambda c: {id_column: c[id_column], "fingerprint": [fingerprint_of(Sketched(t).sketch) for t in c["_text"]]}

    return by_batch(source, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, fingerprint string", make)


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (key, text) in stretches by descending key; each stretch ends with a copy of the row that comes next.

    Stretches are cut at quantiles of the key. The driver gets two numbers per
    stretch. Every text is moved once, but for the one copy per stretch.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), "doc_id", text_of("text").alias("text"))
    asked = [i / buckets for i in range(1, buckets)]
    bounds = keyed.agg(F.percentile_approx("key", asked, 20 * buckets)).first()[0] if asked else []
    starts = np.array(sorted(set(bounds or []), reverse=True), dtype=np.int64)
    place = F.pandas_udf(lambda key: pd.Series(np.searchsorted(-starts, -key.to_numpy(), "left")), "long")
    firsts = sorted((r.b, r.k) for r in keyed.select("key").groupBy(place("key").alias("b")).agg(F.max("key").alias("k")).collect())
    # The first row of a stretch follows the last of the stretch before it; the very first follows the very last.
    copies = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}

    @F.pandas_udf("array<struct<bucket:long,copy:boolean>>")
    def goals(key: pd.Series) -> pd.Series:
        own = np.searchsorted(-starts, -key.to_numpy(), "left")
        return pd.Series(
            [
                [{"bucket": int(b), "copy": False}] + ([{"bucket": copies[k], "copy": True}] if k in copies else [])
                for k, b in zip(key.tolist(), own)
            ]
        )

    dealt = keyed.withColumn("_goal", F.explode(goals("key"))).select("key", "doc_id", "text", "_goal.bucket", "_goal.copy")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "copy", F.desc("key"), "text")


def edited_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The next document is the one with the next smaller doc_id, the first one's
    after the last; rows of equal id are ordered by text, null ids come last. In
    the edited text the last half of the code points, rounded down, is replaced
    by as many of the next document from its start, or by all of it.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, shared): ``shared`` is the length of the common
    beginning of the text and the next one.
    """
    spark = docs.sparkSession
    rows = in_order(docs, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared")

    class Pair:
        """Holds one document until the next of its stretch comes."""

        def __init__(self):
            self.bucket, self.waiting, self.done = None, None, False

        def __call__(self, c):
            out = {name: [] for name in names}
            for bucket, copy, key, text in zip(c["bucket"], c["copy"], c["doc_id"], c["text"]):
                if bucket != self.bucket:
                    self.bucket, self.waiting, self.done = bucket, None, False
                if self.done:
                    continue  # further copies of rows that share the id
                now = Sketched(text)
                if self.waiting is not None:
                    for name, value in zip(names, pair(*self.waiting, now)):
                        out[name].append(value)
                self.waiting, self.done = (key, now), copy
            return out

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared long"
    return by_batch(rows.select("bucket", "copy", "doc_id", "text"), schema, Pair)


def pair(key, own: Sketched, following: Sketched) -> tuple:
    n = own.prefix.n
    keep = n - n // 2
    take = min(n // 2, following.prefix.n)
    edited = own.text[:keep] + following.text[:take]
    sketch = spliced(own, keep, following, take)
    return (
        key, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint_of(own.sketch), fingerprint_of(sketch),
        likeness(own.sketch, sketch), likeness(own.sketch, following.sketch), own.prefix.extension(0, following.prefix, 0),
    )
