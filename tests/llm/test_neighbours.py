"""Nearest neighbours: recall against brute force, exact scores, ties, copies and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.llm import neighbours, queries


def exact(rows, asked, k=10):
    """(query, rank, id, distance) by brute force over (id, vector) pairs."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    vectors = np.stack([v for _, v in good])
    for q, own in good:
        if asked(q):
            away = np.sqrt(((vectors - own) ** 2).sum(axis=1))
            found = {}
            for (i, _), d in zip(good, away.tolist()):
                if i != q:
                    found[i] = min(d, found.get(i, math.inf))
            for rank, (d, i) in enumerate(sorted((d, i) for i, d in found.items())[:k], 1):
                yield q, rank, i, d


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {(q, i): d for q, _, i, d in exact(rows, lambda i: i % 100 == 0)}
    got = queries.QUERIES["op8_neighbours"](spark, folder).collect()
    assert len(got) == len(want) and sum((r.query_id, r.vec_id) in want for r in got) >= 0.93 * len(want)
    vectors = dict(rows)
    for r in got:
        assert r.score == pytest.approx(math.dist(vectors[r.query_id], vectors[r.vec_id]), abs=1e-12)


def test_all_leaves_give_the_exact_answer(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # one vector many times
    rows += [(2000, None), (2100, []), (2200, [0.0] * 4), (2300, [1.0, None, 0.0, 0.0]), (2400, [math.nan, 1.0, 0.0, 0.0]), (2500, [math.inf, 1.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(2600, [1.0] * 3), rows[5], rows[5]]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, leaf=16, share=100.0).collect()
    want = {(q, r): (i, d) for q, r, i, d in exact([x for x in rows if x[0] != 2600], lambda i: i % 20 == 0)}
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {k: i for k, (i, _) in want.items()} and len(got) == len(want)
    assert all(r.score == pytest.approx(want[r.query_id, r.rank][1], abs=1e-12) for r in got)


def test_an_id_on_many_vectors_counts_once(spark):
    """Id 700 lies on 59 vectors near the query, ids 1 to 39 lie farther: ten different ids are found."""
    rows = [(0, [1.0, 0.0])] + [(700, [1.0 + i / 1000, 0.0]) for i in range(1, 60)] + [(i, [2.0 + i / 10, 0.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") == 0, leaf=16, share=100.0).collect())
    assert got == [(1, 700)] + [(i + 1, i) for i in range(1, 10)]
    want = {(q, r): (i, d) for q, r, i, d in exact(rows, lambda i: i == 0)}
    assert [i for _, i in got] == [want[0, r][0] for r in range(1, 11)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_forest_is_bounded_and_balanced():
    sample = np.random.default_rng(0).normal(size=(4000, 16))
    forest = neighbours.grow(sample, 10**9, 4, 128, 1)
    assert forest.leaves <= 1024
    forest = neighbours.grow(sample, 4000, 4, 128, 1)
    for tree in forest.leaves_of(sample).T:
        counts = np.bincount(tree, minlength=forest.leaves)
        assert counts.min() >= 100 and counts.max() <= 150
    opened = forest.nearest_leaves(sample[0], 10**6)
    assert len(opened) == len(set(opened)) == 4 * forest.leaves
    assert {(t, int(n)) for t, n in enumerate(forest.leaves_of(sample[:1])[0])} <= set(opened[:4])


def test_only_the_sizes_of_leaves_are_broadcast(spark):
    """Blocks of vectors and opened leaves are far larger in memory than Spark takes them for; whatever it believes, they are not broadcast."""
    rows = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = neighbours.nearest(df, F.col("vec_id") % 40 == 0, leaf=16)
        assert got.count() == 90  # the vector of id 0 is zero
        text = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in text and text.count("BroadcastExchange") == 1
