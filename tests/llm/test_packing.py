"""Packing against one-by-one best-fit decreasing, and whole token runs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from admitflow.llm import packing, queries
from admitflow.session import cut_lineage

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 8, 16, 33, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    histogram = Counter(lengths)
    plan = packing.plan_windows(histogram, capacity)
    windows = defaultdict(list)
    for n, number, first, each, offset in plan:
        end = min([s[1] for s in plan if s[0] == n and s[1] > number], default=histogram[n])
        for k in range(end - number):
            turn, place = divmod(k, each)
            windows[first + turn].append((offset + place * n, n))
    room = []
    for runs in windows.values():
        at = 0
        for offset, n in sorted(runs):
            assert offset == at
            at += n
        assert at <= capacity
        room.append(capacity - at)
    assert sorted(room) == one_by_one(lengths, capacity)


def test_plan_size_does_not_follow_the_corpus():
    rng = random.Random(1)
    sizes = [len(packing.plan_windows({n: rng.randint(1, most) for n in range(1, 1025)}, 1024)) for most in (10**3, 10**6, 10**9)]
    assert max(sizes) < 5000


def whole(rows, texts, capacity=1024):
    """Check runs against the library's ids, and windows for gaps; return the padding share."""
    library = Tokenizer.from_file(PATH)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    runs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        runs[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert runs.keys() == ids.keys()
    for k, own in runs.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[k]))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    used = []
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        used.append(at)
    assert max(used) <= capacity
    return 1 - sum(used) / sum(packing.pad_length(u, capacity) for u in used)


def test_whole_table(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert whole(queries.QUERIES["op10_packing"](spark, folder).collect(), texts) < 0.01


def test_sequences_hold_the_ids(spark):
    texts = {1: "one two three " * 40, 2: None, 3: "", 4: "x", 5: "four five " * 30}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, length int")
    placed = packing.place_runs(cut_lineage(packing.token_runs(df, PATH, capacity=64, end_id=7)), 64)
    stored = {r.sequence_id: r for r in packing.sequences(placed, 64, pad_id=9).collect()}
    for r in placed.collect():
        assert stored[r.sequence_id].ids[r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    for r in stored.values():
        assert len(r.ids) == (64 if r.used & (r.used - 1) else r.used) and set(r.ids[r.used :]) <= {9}


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same")] * 3 + [(None, "other")], "doc_id long, text string")
    assert packing.place_runs(cut_lineage(packing.token_runs(df, PATH))).count() == 4
    assert packing.place_runs(cut_lineage(packing.token_runs(df.limit(0), PATH))).count() == 0
