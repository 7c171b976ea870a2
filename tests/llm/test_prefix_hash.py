"""Prefix hashes: spans and extensions against plain comparison, spliced sketches, the order of documents."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from admitflow.llm import prefix_hash, queries

TEXT = st.text(alphabet=st.sampled_from("abé😀"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.integers(0, 40), st.integers(0, 40))
def test_extension_is_the_common_beginning(one, other, i, j):
    i, j = min(i, len(one)), min(j, len(other))
    want = 0
    while i + want < len(one) and j + want < len(other) and one[i + want] == other[j + want]:
        want += 1
    a, b = prefix_hash.PrefixHash(one), prefix_hash.PrefixHash(other)
    assert a.extension(i, b, j) == want
    assert a.equal(i, b, j, want)


def plain(text):
    prime, out = prefix_hash.PRIME, 0
    for base in prefix_hash.BASES:
        out = out << prefix_hash.BITS | sum((ord(c) + 1) * pow(base, k, prime) for k, c in enumerate(text)) % prime
    return out


def test_windows_are_the_spans_hashes():
    text = "".join(random.Random(1).choice("abcdé😀 ") for _ in range(300))
    p = prefix_hash.PrefixHash(text)
    for width in (1, 7, 16, 300):
        assert p.windows(width).tolist() == [plain(text[k : k + width]) for k in range(301 - width)]
    assert p.span(250, 290) == plain(text[250:290]) and p.windows(301).size == 0


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.integers(0, 40), st.integers(0, 40))
def test_spliced_sketch_is_that_of_the_spliced_text(head, tail, keep, take):
    keep, take = min(keep, len(head)), min(take, len(tail))
    a, b = prefix_hash.Sketched(head), prefix_hash.Sketched(tail)
    want = prefix_hash.Sketched(head[:keep] + tail[:take]).sketch
    assert prefix_hash.spliced(a, keep, b, take).tolist() == want.tolist()


def test_smallest_with_many_repeats():
    values = np.array([5] * 10000 + list(range(100, 300)) + [1], np.uint64)
    assert prefix_hash.smallest(values).tolist() == [1, 5, *range(100, 162)]


def expected(rows):
    """(id, text) rows in order, each with the next."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else prefix_hash.LOWEST), r[1] or ""))
    for own, following in zip(order, order[1:] + order[:1]):
        text, more = own[1] or "", following[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + more[:half]
        a, b, c = (prefix_hash.Sketched(t) for t in (text, edited, more))
        yield (own[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), prefix_hash.fingerprint_of(a.sketch),
               prefix_hash.fingerprint_of(b.sketch), prefix_hash.likeness(a.sketch, b.sketch), prefix_hash.likeness(a.sketch, c.sketch))


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op5_prefix_hash"](spark, small).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(expected(rows))


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_nulls_repeats_and_stretches(spark, buckets):
    rng = random.Random(4)
    rows = [(rng.randrange(40), "".join(rng.choice("ab c") for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [(None, "null id"), (None, None), (7, None), (7, None), (3, "x" * 200000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, bucket string")
    got = prefix_hash.edited_pairs(df, buckets).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(expected(rows), key=key)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "only one text here, compared with itself")], "doc_id long, text string")
    assert prefix_hash.edited_pairs(df).first().near_next == 1.0
    assert prefix_hash.edited_pairs(df.limit(0)).count() == 0


def test_likeness_orders_edits(spark, folder):
    rows = queries.QUERIES["op5_prefix_hash"](spark, folder).toPandas()
    long = rows[rows.n_chars > 200]
    assert (long.near_edited > long.near_next).mean() > 0.97 and long.near_edited.mean() > 0.35 and long.near_next.mean() < 0.1
