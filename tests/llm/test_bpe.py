"""Byte-pair coding against the tokenizers library, on whole texts."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from admitflow.llm import bpe, queries
from admitflow.llm.common import LATIN, LATIN_WORDS, pieces
from admitflow.llm.packing import library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
QUICK = library_encoder(bpe.read_spec(PATH))
CODER = bpe.BytePairCoder(bpe.read_spec(PATH))
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n", "x<|endoftext|> y", "a <|endoftext|><|endoftext|>", "  lead", "trail  ", "'s 'll don't we'VE",
       "ab" * 5000, "\x1c \x1f a\x85b", "é à 日本 語😀 😀", "a  b  c", "\U00010940x ՘", "\x00 \x00", "12 345,6.7"]


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODER.encode(text).tolist() == want
    assert CODER.decode_text(want) == LIBRARY.decode(want, skip_special_tokens=False)
    assert "".join(pieces(text)) == text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sle<|endoftx>")), max_size=60))
def test_any_text(text):
    same(text)


def test_latin_words_are_the_library_s_pre_tokens():
    latin = [chr(c) for c in range(256) if LATIN.fullmatch(chr(c))]
    assert len(latin) == 191
    split = LIBRARY.pre_tokenizer.pre_tokenize_str
    for a in latin:
        for b in latin:
            text = f"x{a}{b} 1{b}{a}{a}'s"
            assert [text[i:j] for _, (i, j) in split(text)] == LATIN_WORDS.findall(text), repr(text)


@pytest.mark.parametrize("text", ODD)
def test_quick_encoder_gives_the_library_s_ids(text):
    encode = library_encoder(bpe.read_spec(PATH))
    assert encode(text).tolist() == encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(" \n\t'sle<|endoftx>")), max_size=60))
def test_latin_text(text):
    same(text)
    assert QUICK(text).tolist() == CODER.encode(text).tolist()


def test_invalid_bytes_are_replaced_alike():
    for ids in ([CODER.symbol["é"]], [50256, 0, 198], [CODER.symbol["Ā"]]):
        assert CODER.decode_text(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, folder):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op6_bpe"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), digest, hashlib.sha256(r.text.encode()).hexdigest())


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "same", "c"), (3, "same", "d"), (None, "x" * 300000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in back) == sorted((k or -1, t or "") for k, t, _ in rows)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0
