"""Nearest neighbours by a forest of random-projection trees.

A tree splits space by one random direction per level, each node at the median
of its part of a bounded sample. The sample gives thresholds only: every row is
indexed, in every tree. A query walks all trees through one priority queue, the
nearest cut first, and so opens the most promising leaves of the whole forest.
The rows of those leaves are compared with it exactly, in double precision.

Leaves are stored as packed blocks, and queries meet them in blocks: a task
compares matrices and hands back each query's best few, never a row per pair.
Equal vectors are indexed once, with as many of their smallest ids as an answer
can name, so a vector that a third of all rows hold is one entry.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.llm.common import by_batch
from admitflow.session import cut_lineage

# Vectors in one stored block, about, and queries compared with it at once.
BLOCK, QUERIES_AT_ONCE = 512, 64
# Answers a task holds before it hands them on.
ANSWERS_HELD = 200_000


@dataclass(frozen=True)
class Forest:
    """``directions``: (tree, level, dimension). ``cuts``: for each level (tree, node of that level)."""

    directions: np.ndarray
    cuts: tuple[np.ndarray, ...]

    @property
    def leaves(self) -> int:
        return 1 << len(self.cuts)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """(row, tree): the leaf each vector falls into."""
        node = np.zeros((len(vectors), len(self.directions)), dtype=np.int64)
        trees = np.arange(len(self.directions))
        for level, cuts in enumerate(self.cuts):
            node = 2 * node + (vectors @ self.directions[:, level].T > cuts[trees, node])
        return node

    def nearest_leaves(self, vector: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs a query opens, from one queue over all trees.

        A branch waits with the distance to the farthest cut that parts it from the query.
        """
        place = self.directions @ vector
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.directions))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < visits:
            away, tree, level, node = heapq.heappop(queue)
            for deeper in range(level, len(self.cuts)):
                gap = place[tree, deeper] - self.cuts[deeper][tree, node]
                right = int(gap > 0)
                heapq.heappush(queue, (max(away, abs(gap)), tree, deeper + 1, 2 * node + 1 - right))
                node = 2 * node + right
            found.append((tree, node))
        return found


def grow(sample: np.ndarray, rows: int, trees: int, leaf: int, seed: int) -> Forest:
    """A forest for ``rows`` vectors, of leaves of about ``leaf`` rows, but at least four sample rows each."""
    finest = math.log2(max(1.0, len(sample) / 4))
    depth = max(0, min(math.ceil(math.log2(max(1.0, rows / leaf))), math.floor(finest)))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(trees, depth, sample.shape[1] if sample.size else 1))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = [np.zeros((trees, 1 << level)) for level in range(depth)]
    for tree in range(trees):
        parts = [sample]
        for level in range(depth):
            halves = []
            for node, part in enumerate(parts):
                place = part @ directions[tree, level]
                middle = float(np.median(place)) if len(place) else 0.0
                cuts[level][tree, node] = middle
                halves += [part[place <= middle], part[place > middle]]
            parts = halves
    return Forest(directions, tuple(cuts))


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(blobs: list[bytes], dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dimension)


class _Best:
    """Each query's best answers within a task."""

    def __init__(self, k: int, dimension: int, most: int):
        self.k, self.dimension, self.most, self.best = k, dimension, most, {}

    def __call__(self, c):
        for ids, vectors, query_ids, queries in zip(c["ids"], c["vectors"], c["query_ids"], c["queries"]):
            ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
            vectors, queries = _matrix([vectors], self.dimension), _matrix([queries], self.dimension)
            own = (vectors * vectors).sum(axis=1)
            for at in range(0, len(queries), QUERIES_AT_ONCE):
                some = queries[at : at + QUERIES_AT_ONCE]
                rough = own[None, :] - 2 * some @ vectors.T
                self.compare(query_ids[at : at + QUERIES_AT_ONCE], some, rough, ids, vectors, float(own.max()))
        return self.finish() if len(self.best) * self.k > ANSWERS_HELD else self.empty()

    def compare(self, query_ids, queries, rough, ids, vectors, scale):
        """Exact distances of what the rough ones leave among the best, and a little more for rounding."""
        # One id more, since the query's own may be among them; an id may stand on several vectors.
        keep = min((self.k + 1) * self.most, rough.shape[1])
        last = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
        slack = 1e-9 * (scale + np.abs(last) + (queries * queries).sum(axis=1))
        for row, key in enumerate(query_ids.tolist()):
            near = np.nonzero(rough[row] <= last[row] + slack[row])[0]
            exact = np.sqrt(((vectors[near] - queries[row]) ** 2).sum(axis=1))
            least = {i: d for d, i in self.best.get(key, ())}
            for d, i in zip(exact.tolist(), ids[near].tolist()):
                if i != key and d < least.get(i, math.inf):
                    least[i] = d
            self.best[key] = heapq.nsmallest(self.k, ((d, i) for i, d in least.items()))

    def empty(self):
        return {"query_id": [], "vec_id": [], "score": []}

    def finish(self):
        out = self.empty()
        for key, found in self.best.items():
            for score, i in found:
                out["query_id"].append(key)
                out["vec_id"].append(i)
                out["score"].append(score)
        self.best = {}
        return out


def _blocks(rows: DataFrame, key: str, vector: str, names: tuple[str, str], dimension: int) -> DataFrame:
    """Rows (tree, leaf, key, vector) packed as blocks of about BLOCK rows (tree, leaf, two blobs)."""
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    part = F.pmod(F.xxhash64(key, vector), F.col("_n")).alias("_part")
    # There is a size per leaf of the forest, whatever the table. The rows are never the side that is broadcast: a
    # query's vector repeats in every leaf it opens, and their file is far smaller than what they are in memory.
    packed = rows.join(F.broadcast(sizes), ["tree", "leaf"]).groupBy("tree", "leaf", part).agg(F.collect_list(F.struct(key, vector)).alias("rows"))

    def make():
        def step(c):
            return {
                "tree": c["tree"],
                "leaf": c["leaf"],
                names[0]: [np.array([r[key] for r in rows], np.int64).tobytes() for rows in c["rows"]],
                names[1]: [b"".join(r[vector] for r in rows) for rows in c["rows"]],
            }

        return step

    return by_batch(packed.select("tree", "leaf", "rows"), f"tree int, leaf long, {names[0]} binary, {names[1]} binary", make)


def nearest(
    table: DataFrame, queries: Column, k: int = 10, trees: int = 8, leaf: int = 128, share: float = 1.2,
    max_sample: int = 20_000, seed: int = 17, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, nearest first, ties to the smaller id.

    ``queries`` says which rows are queries; every other row is a candidate. The
    distance is Euclidean, in double precision on the vectors as they are. Rows
    whose vector is not ``usable``, or shorter or longer than the most frequent
    length, or whose id is null take no part. Rows that repeat an id and a
    vector are one; an id with several vectors counts with its nearest, and as a
    query with the smallest of them.

    A query opens leaves that hold about ``share`` times as many entries as there are
    vectors, counted over all trees, and two leaves per tree. High-dimensional vectors without structure
    need that much for a recall of 0.9: the forest orders the work, and costs as
    much as ``share`` times a complete comparison.
    """
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), queries.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    widths = {r.w: r.n for r in rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    dimension = max(widths, key=lambda w: (widths[w], w), default=1)
    rows = rows.where(F.size("v") == dimension)

    # Of equal vectors, k and one for the query itself are all that can be named.
    order = Window.partitionBy("v").orderBy("vec_id")
    named = rows.select("vec_id", "v").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")
    named = cut_lineage(_packed_vectors(named), "vectors")
    asked = _packed_vectors(rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")))

    total = named.count()
    most = named.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    drawn = named.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, max_sample / max(total, 1)) * (1 << 20)))
    sample = _matrix([r.v for r in drawn.select("v").orderBy(F.xxhash64("v")).limit(max_sample).collect()], dimension)
    forest = grow(sample, total, trees, leaf, seed)
    visits = math.ceil(share * forest.leaves) + 2 * trees  # with few leaves, a share of them says little
    sent = table.sparkSession.sparkContext.broadcast(forest)

    def index():
        def step(c):
            if not c["v"]:
                return {"tree": [], "leaf": [], "vec_id": [], "v": []}
            found = sent.value.leaves_of(_matrix(c["v"], dimension)).tolist()
            each = [(t, n, i, v) for i, v, nodes in zip(c["vec_id"], c["v"], found) for t, n in enumerate(nodes)]
            return dict(zip(("tree", "leaf", "vec_id", "v"), map(list, zip(*each))))

        return step

    def search():
        def step(c):
            out = {"tree": [], "leaf": [], "vec_id": [], "v": []}
            for i, v in zip(c["vec_id"], c["v"]):
                for t, n in sent.value.nearest_leaves(_matrix([v], dimension)[0], visits):
                    for name, value in zip(out, (t, n, i, v)):
                        out[name].append(value)
            return out

        return step

    schema = "tree int, leaf long, vec_id long, v binary"
    stored = cut_lineage(_blocks(cut_lineage(by_batch(named, schema, index), "leaf-rows"), "vec_id", "v", ("ids", "vectors"), dimension), "leaves")
    opened = cut_lineage(by_batch(asked, schema, search), "opened-leaves")
    asking = _blocks(opened, "vec_id", "v", ("query_ids", "queries"), dimension)
    # Spark takes a block for a short value, so it may believe that all of them can be broadcast.
    pairs = stored.join(asking.hint("merge"), ["tree", "leaf"]).select("ids", "vectors", "query_ids", "queries")
    answers = by_batch(pairs, "query_id long, vec_id long, score double", lambda: _Best(k, dimension, most))
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v binary): the components as 64-bit floats, one blob per row."""

    def make():
        return lambda c: {"vec_id": c["vec_id"], "v": [np.array(v, np.float64).tobytes() for v in c["v"]]}

    return by_batch(rows.select("vec_id", "v"), "vec_id long, v binary", make)
