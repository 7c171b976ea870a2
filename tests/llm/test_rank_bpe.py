"""Byte-level BPE by ranks against the tiktoken library, on whole texts, and against a plain merge loop."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from admitflow.llm import queries, rank_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPEC = rank_bpe.read_spec(PATH)
CODER = rank_bpe.RankCoder(SPEC, PATTERN)
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n", "x<|endoftext|> y", "'s 'll don't we'VE", "é à 日本 語😀 😀", "\U00010940x ՘", "\x00 \x00",
       "12 345,6.7", "\x1c \x1f a\x85b", "a" * 3000, "ab" * 1500, "the" * 700, "日本" * 400, "xyzzyqwrt" * 130, " " * 5000, "=-" * 900]


def plain(match: bytes, ranks=RANKS) -> list[int]:
    """The leftmost pair of the lowest rank, one merge after another."""
    if match in ranks:
        return [ranks[match]]
    parts = [match[i : i + 1] for i in range(len(match))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def same(texts):
    for text, ids in zip(texts, CODER.encode(texts)):
        assert ids.tolist() == LIBRARY.encode_ordinary(text), text[:80]
        assert CODER.decode(ids) == text.encode()


def test_odd_texts():
    same(ODD)
    same(ODD[::-1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'slethandi")), max_size=60), max_size=5))
def test_any_texts(texts):
    same(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=12), st.integers(0, 2**32))
def test_any_ranks(words, seed):
    """Ranks in any order, so that a merge may make a pair of a lower rank; rows and long matches agree with the plain loop."""
    draw = np.random.default_rng(seed)
    tokens = sorted({w[i:j].encode() for w in words for i in range(len(w)) for j in range(i + 2, min(i + 5, len(w) + 1))})
    order = [bytes([b]) for b in range(256)] + [tokens[i] for i in draw.permutation(len(tokens))]
    ranks = {t: i for i, t in enumerate(order)}
    coder = rank_bpe.RankCoder("\n".join(f"{base64.b64encode(t).decode()} {i}" for t, i in ranks.items()), r"[\s\S]+")
    many = words + ["".join(words) * 2]
    packed = coder.encode_matches([w.encode() for w in many])
    for word, got in zip(many, packed):
        want = plain(word.encode(), ranks)
        assert np.frombuffer(got, "<u4").tolist() == want
        first = coder.firsts[np.frombuffer(word.encode(), np.uint8)]
        if word.encode() not in ranks:
            assert coder._one_long(first).tolist() == want


def test_pair_table_holds_all_pairs_and_no_other():
    draw = np.random.default_rng(3)
    pairs = {tuple(p) for p in draw.integers(0, 300, (5000, 2)).tolist()}
    left, right = map(list, zip(*sorted(pairs)))
    find = rank_bpe.PairTable(left, right, range(len(left)))
    assert find(np.array(left), np.array(right)).tolist() == list(range(len(left)))
    grid = np.array(np.meshgrid(np.arange(-1, 300), np.arange(300))).reshape(2, -1)
    hits = (find(grid[0], grid[1]) != rank_bpe.NONE).sum()
    assert hits == len(pairs)
    assert rank_bpe.PairTable([], [], [])(np.array([1]), np.array([2]))[0] == rank_bpe.NONE


def test_a_file_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        rank_bpe.RankCoder("YQ== 0", PATTERN)


def test_forgotten_matches_come_back_the_same(monkeypatch):
    monkeypatch.setattr(rank_bpe, "MATCHES_KEPT", 20)
    coder = rank_bpe.RankCoder(SPEC, PATTERN)
    texts = [f"word{i} other{i % 3}, zyx{i % 7}" for i in range(60)]
    for text in texts + texts:
        assert coder.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_query_equals_the_library_on_every_document(spark, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op13_rank_bpe"](spark, folder).collect()}
    docs = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    assert len(got) == len(docs["doc_id"])
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        ids = LIBRARY.encode_ordinary(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, 0), (1, "", 1), (None, "a text", 2), (None, "a text", 3), (2, "a text", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnsRenamed({"ids": "n_tokens"})
    coded = rank_bpe.encode_texts(df, PATH, PATTERN)
    got = sorted(coded.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = np.array(LIBRARY.encode_ordinary("a text"), "<u4").tobytes()
    assert [(r.doc_id, bytes(r.ids)) for r in got] == [(1, b""), (1, b""), (2, want), (None, want), (None, want)]
    back = rank_bpe.decode_ids(coded.withColumn("decoded", coded.n_tokens), PATH)
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"a text", b"a text", b"a text"]
    none = rank_bpe.decode_ids(coded.limit(1).selectExpr("doc_id", "cast(null as binary) as ids"), PATH)
    assert none.collect()[0].decoded is None
    assert rank_bpe.encode_texts(df.limit(0), PATH, PATTERN, decoded="decoded").collect() == []
