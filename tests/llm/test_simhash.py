"""SimHash: fingerprints and components against a plain double loop."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from admitflow.llm import queries, simhash
from admitflow.llm.components import components


def plain_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    names = dict.fromkeys(prints)
    parent = {k: k for k in names}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


TEXTS = {
    1: "the quick brown fox jumps over the lazy dog", 2: "The  QUICK brown\tfox jumps over the lazy dog", 3: "", 4: None, 5: " \n ",
    6: "two words", 7: "é É straße ÉÉ", 8: "é é straße ÉÉ", 9: "a b c", 10: "a b c a b c a b c a b c", 11: "word " * 5000,
}


def test_fingerprints_and_components(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    want = {k: plain_print(t) for k, t in TEXTS.items()}
    assert {r.doc_id: int.from_bytes(r.fingerprint, "big") for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == plain_components(want, 2)


def test_whole_table_against_double_loop(spark, small):
    got = queries.QUERIES["op9_simhash"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {k: plain_print(t) for k, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == plain_components(want, 2)


@pytest.mark.parametrize("blocks,width,radius", [(4, 1, 2), (1, 8, 9), (2, 4, 5)])
def test_tiles_lose_no_link(spark, monkeypatch, blocks, width, radius):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(3)
    prints = {}
    for k in range(0, 400, 8):
        base = rng.getrandbits(64)
        for j in range(8):
            for bit in rng.sample(range(64), rng.randrange(4)):
                base ^= 1 << bit
            prints[k + j] = base
    prints = {k: v for v, k in {v: k for k, v in prints.items()}.items()}
    df = spark.createDataFrame([(k, v.to_bytes(8, "big")) for k, v in prints.items()], "rep long, fingerprint binary")
    links = simhash.tile_links(df, 64, radius, blocks, width)
    found = {k: k for k in prints} | {r.node: r.component for r in components(links).collect()}
    assert found == plain_components(prints, radius)


def test_near_cells_hold_every_close_pair():
    rng = np.random.default_rng(1)
    for blocks, width, radius in ((4, 1, 2), (1, 8, 19), (2, 4, 6)):
        near = set(simhash.near_cells(blocks, width, radius))
        for _ in range(300):
            a = rng.integers(0, 2, 64)
            b = a.copy()
            b[rng.choice(64, rng.integers(0, radius + 1), replace=False)] ^= 1
            cell = lambda x: x.reshape(blocks, -1).sum(1) // width
            offset = tuple(int(v) for v in cell(a) - cell(b))
            assert offset in near or tuple(-v for v in offset) in near


def test_wide_fingerprint_starts_with_the_hash():
    hashes = np.array([1, 2**63, 12345], dtype=np.uint64)
    wide = simhash.widen(hashes, 2)
    assert (wide[:, 0] == hashes).all() and len(set(wide[:, 1].tolist())) == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three four"), (3, "one two three four"), (3, "one two three four"), (None, "quite another text here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_null_ids_link_near_copies(spark, monkeypatch):
    """Fingerprints two bits apart: 9 and 4 are connected only through a row without an id, two null rows with each other."""
    prints = {"a": 0b11111, "b": 0b111, "c": 0b1, "d": 0xFF << 40, "e": 0x7F << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *a: df.select("doc_id", F.col("fingerprint")))
    rows = [(9, "a"), (None, "b"), (4, "c"), (None, "d"), (None, "e")]
    df = spark.createDataFrame([(i, prints[k].to_bytes(8, "big")) for i, k in rows], "doc_id long, fingerprint binary")
    got = {int.from_bytes(r.fingerprint, "big"): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {prints["a"]: 4, prints["b"]: 4, prints["c"]: 4, prints["d"]: None, prints["e"]: None}


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.component for r in components(links).collect()} == {0}
