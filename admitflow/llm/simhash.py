"""SimHash fingerprints and their exact near-duplicate links, by tiled comparison.

Fingerprints that are equal are one. The others are laid out in tiles by the
population counts of their blocks: the bits of a fingerprint are cut into
``blocks`` equal parts, each part's count of ones is divided by ``width``, and
the resulting cell names the tile. Two fingerprints that differ in at most
``radius`` bits have counts that differ by at most ``radius`` in sum, so tiles of
cells farther apart than that are never brought together. All other pairs of
tiles are compared completely, by exclusive-or and bit counts over whole arrays.

With a radius of 2 and four blocks, about one pair in a hundred remains. The
number of compared pairs still grows with the square of the number of
different fingerprints: that is the method, see the README for figures.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import by_batch, text_of, with_column
from admitflow.llm.components import components
from admitflow.session import cut_lineage

# Fingerprints in one tile at most; two tiles and a strip of their distances fit a core's cache.
TILE = 2048
# Sizes of at most this many cells are broadcast; a row of them is some 50 bytes.
MOST_CELLS = 100_000
STRIP = 128


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; fewer words are one shingle, no words none.

    Words are what ASCII white space separates, with A-Z in lower case.
    """
    words = text.encode().lower().split()
    if len(words) < shingle:
        runs = [b" ".join(words)] if words else []
    else:
        runs = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, seed) for r in runs), dtype=np.uint64, count=len(runs))


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit numbers per hash, the first being the hash itself, the others mixed from it."""
    out = np.empty((len(hashes), words), dtype=np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def simhash(text: str, shingle: int = 3, seed: int = 42, bits: int = 64) -> bytes:
    """The fingerprint of all shingles of a text, repeats included."""
    return fingerprint(shingle_hashes(text, shingle, seed), bits)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """The fingerprint, most significant byte first; a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = widen(hashes[at : at + 8192], bits // 64).astype(">u8").view(np.uint8).reshape(-1, bits // 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, bits: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint binary) for every whole text; null and empty texts have the zero fingerprint."""
    source = df.select(F.col(id_column), text_of(text_column).alias("_text"))

    def make():
        return lambda c: {id_column: c[id_column], "fingerprint": [simhash(t, shingle, seed, bits) for t in c["_text"]]}

    return by_batch(source, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, fingerprint binary", make)


def radius_for(similarity: float, bits: int, margin: float = 0.5) -> int:
    """Bits that two fingerprints differ in, at most, if their shingle sets have that Jaccard similarity.

    A bit differs with the angle between the shingle counts, and sets of equal
    size and similarity s share 2s / (1 + s) of their elements. The number of
    such bits is binomial; ``margin`` standard deviations are added to its mean,
    so that most pairs just similar enough are within the radius.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def near_cells(blocks: int, width: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets between cells that may hold fingerprints within the radius, one of each pair of opposite offsets.

    Counts whose cells are d apart differ by at least (d - 1) * width + 1.
    """

    def least(d: int) -> int:
        return (abs(d) - 1) * width + 1 if d else 0

    reach = (radius - 1) // width + 1 if radius else 0
    found = (o for o in itertools.product(range(-reach, reach + 1), repeat=blocks) if sum(map(least, o)) <= radius)
    return [o for o in found if o >= (0,) * blocks]


def first_words(radius: int, words: int) -> int:
    """Words to compare of every pair, three at most: so many that chance leaves few pairs within the radius."""
    return next((k for k in range(min(2, words), min(3, words)) if 32 * k - 16 * math.sqrt(k) >= radius), min(3, words))


def join_parts(near_rows: np.ndarray, near_columns: np.ndarray, label: np.ndarray, at: int, base: int, found: list[tuple[int, int]]) -> None:
    """Add to ``found`` the pairs that join two parts not yet joined. ``label`` names each one's part and follows."""
    for row in np.unique(near_rows):
        columns = near_columns[near_rows == row]
        labels, first = np.unique(label[columns + base], return_index=True)
        for other, k in zip(labels, first):
            own = label[row + at]
            if other != own:
                label[label == other] = own
                found.append((row + at, columns[k]))


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles that connect whatever lies within the radius, fewer than they have rows.

    Every pair is compared. Of the pairs found, those are returned that join two
    parts not yet joined: the rest would say nothing new about what is connected.
    """
    label = np.arange(len(left) + (0 if same else len(right)))
    base, found = 0 if same else len(left), []
    first = first_words(radius, left.shape[1])
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        distance = np.bitwise_count(strip[:, None, 0] ^ right[None, :, 0])
        for k in range(1, first):
            distance = distance + np.bitwise_count(strip[:, None, k] ^ right[None, :, k])
        near_rows, near_columns = np.nonzero(distance <= radius)
        if left.shape[1] > first:
            # Later words only for pairs that the first ones leave within the radius.
            total = np.bitwise_count(strip[near_rows] ^ right[near_columns]).sum(axis=1, dtype=np.int32)
            near_rows, near_columns = near_rows[total <= radius], near_columns[total <= radius]
        if same:
            above = near_columns > near_rows + at
            near_rows, near_columns = near_rows[above], near_columns[above]
        join_parts(near_rows, near_columns, label, at, base, found)
    return found


def _words(blob: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(blob, ">u8").astype(np.uint64).reshape(-1, bits // 64)


def _cells(groups: DataFrame, bits: int, blocks: int, width: int) -> DataFrame:
    """Add ``cell``: the population counts of the blocks, divided by ``width``."""
    schema = with_column(groups, "cell", "array<int>")

    def make():
        def step(c):
            ones = np.unpackbits(np.frombuffer(b"".join(c["fingerprint"]), np.uint8)).reshape(-1, blocks, bits // blocks)
            return c | {"cell": (ones.sum(axis=2, dtype=np.int32) // width).tolist()}

        return step

    return by_batch(groups, schema, make)


def tile_links(groups: DataFrame, bits: int, radius: int, blocks: int, width: int = 1) -> DataFrame:
    """(a, b): links among different fingerprints (rep, fingerprint) that connect all within ``radius`` bits."""
    celled = cut_lineage(_cells(groups.select("rep", "fingerprint"), bits, blocks, width), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (TILE / 2)).alias("n"))
    # There are at most so many cells, whatever the corpus. Joined by broadcast, the
    # rows of a large cell are not brought together before they are dealt into tiles.
    if (bits // blocks // width + 1) ** blocks <= MOST_CELLS:
        sizes = F.broadcast(sizes)
    tile = F.pmod(F.xxhash64("fingerprint"), F.col("n")).alias("tile")
    tiles = celled.join(sizes, "cell").groupBy("cell", tile).agg(F.collect_list(F.struct("fingerprint", "rep")).alias("rows"))

    def pack():
        def step(c):
            return {
                "cell": c["cell"],
                "tile": c["tile"],
                "prints": [b"".join(r["fingerprint"] for r in rows) for rows in c["rows"]],
                "reps": [np.array([r["rep"] for r in rows], dtype=np.int64).tobytes() for rows in c["rows"]],
            }

        return step

    packed = cut_lineage(by_batch(tiles, "cell array<int>, tile long, prints binary, reps binary", pack), "tiles")

    # The tiles of a large cell are dealt into shares, and each share of one cell
    # meets each share of another in a place of its own.
    most = packed.agg(F.max("tile")).first()[0] or 0
    shares = math.ceil(math.sqrt(most + 1) / 2)
    each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    near = [F.struct(F.array(*map(F.lit, o)).alias("offset"), F.lit(not any(o)).alias("same")) for o in near_cells(blocks, width, radius)]
    left = packed.select("*", F.explode(F.array(*near)).alias("near")).select(
        F.zip_with("cell", "near.offset", lambda c, o: c + o).alias("cell"),
        (F.col("tile") % shares).alias("share_a"),
        each.alias("share"),
        F.col("near.same").alias("same"),
        *(F.col(c).alias(f"{c}_a") for c in ("tile", "prints", "reps")),
    )
    right = packed.select("cell", each.alias("share_a"), (F.col("tile") % shares).alias("share"), "tile", "prints", "reps")
    # Within one cell each pair of tiles meets once, and a tile meets itself.
    pairs = left.join(right, ["cell", "share_a", "share"]).where("not same or tile_a <= tile")
    pairs = pairs.select((F.col("same") & (F.col("tile_a") == F.col("tile"))).alias("own"), "prints_a", "reps_a", "prints", "reps")

    def make():
        def step(c):
            out = {"a": [], "b": []}
            for own, fa, ra, fb, rb in zip(c["own"], c["prints_a"], c["reps_a"], c["prints"], c["reps"]):
                links = _forest(_words(fa, bits), _words(fb, bits), own, radius)
                left_reps, right_reps = np.frombuffer(ra, np.int64), np.frombuffer(rb, np.int64)
                out["a"] += [int(left_reps[i]) for i, _ in links]
                out["b"] += [int(right_reps[j]) for _, j in links]
            return out

        return step

    return by_batch(pairs, "a long, b long", make)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, seed: int = 42, bits: int = 64, radius: int = 2, blocks: int = 4, width: int = 1,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, fingerprint binary, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own included. Texts without words are
    linked with each other and with what lies near zero. Rows with a null id keep
    their fingerprint, count as a link, and never name a component; a component
    of nothing else has a null id. Ids are whole numbers.
    """
    marked = cut_lineage(fingerprints(docs, shingle, seed, bits, id_column, text_column), "fingerprints")
    # Copies meet here, after partial aggregation; what follows sees each fingerprint once.
    groups = marked.groupBy("fingerprint").agg(F.min(id_column).alias("least")).withColumn("rep", F.monotonically_increasing_id())
    groups = cut_lineage(groups, "fingerprint-groups")
    # Links are between numbers of fingerprints, so those without an id link too; ids name the components afterwards.
    linked = components(tile_links(groups, bits, radius, blocks, width))
    parts = groups.join(linked, groups.rep == linked.node, "left").select("fingerprint", "least", F.coalesce("component", "rep").alias("part"))
    names = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    named = parts.join(names, "part").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(id_column, "fingerprint", "component_id")
