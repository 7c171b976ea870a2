"""Phrase collocations: the query's SQL, a brute-force miner over several frontiers, exact scores, odd rows."""

import random
import re
from collections import Counter as Tally

import numpy as np
import oracle
import pytest

from admitflow.llm import collocations, queries

SCHEMA = "text string, lang string, w1 string, f long, cut long"
FOLD = {c: chr(c + 32) for c in range(65, 91)}


def test_query_matches_sql(spark, folder):
    name = "op11_collocations"
    assert oracle.compare(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name]) is None


def brute(rows, top, least=10):
    f, n = Tally(), Tally()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for g, a in f.items():
        if len(g) > 2 and a >= least:
            sides = [(f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
            score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(sides))
            out[g] = (score, a, left, right)
    lost = {(g[0], *part) for g in out if len(g) == 4 for part in (g[1:3], g[2:4]) if 100 * f[g] >= 50 * f[(g[0], *part)]}
    found = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(g[1:]).encode(), left, right) for g, (s, a, left, right) in out.items() if g[0] == lang and g not in lost)
        found += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(mine[:top])]
    return sorted(found)


def run(spark, rows, top=2000, parts=3, least=10):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    got = collocations.mine(df, top, least).collect()
    return sorted(tuple(r) for r in got)


def corpus(seed, texts=300):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "Ab", "aB", "x y", " "]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(texts):
        parts = draw.choices(words, weights, k=draw.randrange(0, 40))
        if draw.random() < 0.5:
            parts[5:5] = draw.choice([["alpha", "beta", "gamma"], ["beta", "gamma"], ["new", "york", "city"]])
        rows.append(("".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", " ! "]) for w in parts), draw.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("top", [1, 7, 2000])
def test_equals_brute_force(spark, monkeypatch, top):
    """With few phrases asked for, the first frontier is small and most prefixes stay closed."""
    monkeypatch.setattr(collocations, "FIRST", 1)
    rows = corpus(top)
    assert run(spark, rows, top) == brute(rows, top)


def test_frontier_grows_until_the_last_place_is_settled(spark, monkeypatch):
    """The best pairs all lie inside triples, so the first frontiers have too few survivors."""
    monkeypatch.setattr(collocations, "FIRST", 1)
    monkeypatch.setattr(collocations, "GROWTH", 2)
    seen = []
    plain = collocations.reach
    monkeypatch.setattr(collocations, "reach", lambda df, column, want, width=1: (seen.append(want), plain(df, column, want, width))[1])
    rows = [(" ".join(f"a{i} b{i} c{i}." + f" a{i}." * i for i in range(40)), "en")] * 11
    got = run(spark, rows, 30)
    assert got == brute(rows, 30) and len(seen) > 3


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), ("...", None), ("A b" * 4, None), ("One two. " * 12, "xx"), ("one TWO three " * 200_000, "long"),
            ("tie a. tie b. " * 10, "t"), ("\x00 \x00 " * 30, "zero"), ("é É " * 12, "É")]
    assert run(spark, rows + rows[4:5]) == brute(rows + rows[4:5], 2000)


def test_empty_table_and_no_phrases(spark):
    assert run(spark, []) == []
    assert run(spark, [("a b c", "en")]) == []


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 987_654_321_012_345, 987_654_321_987_654, 999_999_999_999_999
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score_of("a", "l", "r").alias("s")).first().s == 10**6 * a * a // (left * right)


@pytest.mark.parametrize("held", [10, 1 << 22])
def test_counts_in_parts_and_in_wide_keys(monkeypatch, held):
    """Handing counts on early, or numbering more words than fit into one key, changes nothing."""
    flags = np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
    texts = [t for t, _ in corpus(9, 80)]
    want = Tally()
    for text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update(zip(words, words[1:], words[2:]))
    for short in (1 << 21, 5):
        monkeypatch.setattr(collocations, "_SHORT", short)
        monkeypatch.setattr(collocations, "HELD_PHRASES", held)
        counter, got = collocations.Counter(3, [flags] * 3), Tally()
        for text in texts:
            counter.add("en", [text])
            if counter.full() or text is texts[-1]:
                for batch in counter.hand_on():
                    _, *words, n = (batch.column(i).to_pylist() for i in range(5))
                    for *key, count in zip(*words, n):
                        got[tuple(key)] += count
        assert got == want
