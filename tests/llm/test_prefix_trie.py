"""The conversation trie: the query's SQL, a brute-force trie, odd rows, and conversations longer than a stretch."""

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from admitflow.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, name string, node long, depth string"


def test_query_matches_sql(spark, folder):
    name = "op12_prefix_trie"
    assert oracle.compare(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name]) is None


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def sequences(rows):
    """Rebuilt conversations from (conv_id, turn, role, text), one after another."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    told = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = told.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(seqs):
    nodes = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            below[p[:-1]] += 1
    for p, convs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in below
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (
            min(convs), len(p), min(nodes[p[:-1]]) if p else -1, len(convs), below.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, convs in nodes.items()
    )


def got_of(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(3)
    turns = prefix_trie.turns_in_order(df)
    rebuilt, convs = prefix_trie.with_shared_openings(turns)
    return got_of(prefix_trie.trie(rebuilt, convs))


ODD = [
    (0, None, "user", "a"), (0, 1, None, "b"), (0, 1, "user", None), (0, 1, "user", None), (1, 0, "user", "a"), (1, 5, "", "b"),
    (2, 0, "us", "era"), (2, 1, "user", "a"), (3, 0, "user", "é😀"), (None, 0, "user", "lost"), (14, 0, "user", ""), (13, 0, "user", ""),
    (10, 0, "user", "x" * 100_000), (11, 0, "user", "x" * 100_000), (11, 1, "a", "1:b"), (12, 0, "a1", ":b"), (7, 3, "q", "q"), (7, 2, "q", "q"),
]


def test_odd_rows(spark):
    assert run(spark, ODD) == brute(sequences(ODD))


def test_empty_table(spark):
    assert run(spark, ODD[:0]) == []


def test_long_and_many_in_short_stretches(spark, monkeypatch):
    """Three rounds of stretches, one conversation with a third of all turns, members in several digest stretches."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    draw = random.Random(5)
    rows = [(c, t, "user", draw.choice("ab")) for c in range(40) for t in range(draw.randrange(1, 14))]
    rows += [(c, t, "user", "ab"[t % 2]) for c in (50, 51, 52) for t in range(70)]
    rows += [(50, t, "user", draw.choice("ab")) for t in range(70, 190)]
    rows += [(c, t, "user", "same") for c in range(60, 90) for t in range(12)]
    assert run(spark, rows) == brute(sequences(rows))


@pytest.mark.parametrize("length", [0, 1, 2, 3, 7, 8, 9, 31])
def test_names_of_equal_prefixes_are_equal_and_of_others_are_not(length):
    names = [digest("r", str(i)) for i in range(40)]
    long, short = prefix_trie.halved(names), prefix_trie.halved(names[:length] + names[:1])
    assert long[:length] == short[:length]
    assert len(set(long + short)) == len(set(long)) + (1 if length else 0)


def test_hot_first_turn_spreads(spark):
    """All conversations share a turn; no range of the layout holds all members of a node."""
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(1, 4000, 5) for t in range(9, 12)]
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)
    turns = prefix_trie.turns_in_order(df)
    convs = turns.groupBy("conv_id").count().withColumnRenamed("count", "length")
    nodes, paths = prefix_trie.members(turns, convs)
    assert nodes.where("depth = 0").first().n_convs == 800
    assert paths.count() == 800 * 4
