"""Byte-pair encoding by a queue of merge ranks over a linked symbol list, and decoding by concatenation.

The vocabulary is read from a tokenizer file whose path is a parameter. The
driver reads the file (about 1.5 MB, whatever the corpus) and sends its content
along, so executors need no copy of it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from admitflow.llm.common import ID_TYPE, LATIN, LATIN_WORDS, PieceCache, by_batch, held, text_of, with_column


# Bits for a token id, in numbers that hold two of them, or one beside a rank.
IDS = 20
LAST_ID = (1 << IDS) - 1
# Pre-tokens, and pieces of text, whose ids are kept, in two generations each. Changes no result.
WORDS_KEPT = 1_000_000
PIECES_KEPT = 1_600_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class BytePairCoder:
    """Encoder and decoder of one byte-level vocabulary, from the content of its tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        byte_of = byte_alphabet()
        self.symbol = {c: vocab[c] for c in byte_of}
        self.first_ids = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        # left id and right id -> rank and merged id, each pair in one number
        self.merges = {vocab[a] << IDS | vocab[b]: rank << IDS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.strings.update((i, s.encode()) for s, i in added.items())
        self.added = added
        self.split_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pre_tokenize = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.cached = PieceCache(lambda new: [self._piece(p) for p in new], PIECES_KEPT)
        # All vocabulary strings on end, and where each begins and ends.
        longest = max(self.strings) + 1
        lengths = np.array([len(self.strings.get(i, b"")) for i in range(longest)], np.int64)
        self.ends = np.cumsum(lengths)
        self.lengths = lengths
        self.letters = np.frombuffer(b"".join(self.strings.get(i, b"") for i in range(longest)), np.uint8)

    def merge(self, ids: Sequence[int]) -> list[int]:
        """Merge one pre-token's symbols, the lowest rank first, the leftmost first among equal ranks.

        Symbols form a doubly linked list by index. A merge puts the new pairs on
        the queue and leaves the old ones there; an entry whose pair has changed
        since is stale and is skipped. So n symbols take n log n steps.
        """
        symbols, merge_of = list(ids), self.merges.get
        size = len(symbols)
        found = map(merge_of, [a << IDS | b for a, b in zip(symbols, symbols[1:])])
        # An entry is a pair's rank, what it becomes, and the place of its left symbol.
        places = size.bit_length()
        queue = [pair << places | i for i, pair in enumerate(found) if pair is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push, last = heapq.heappop, heapq.heappush, (1 << places) - 1
        following, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while queue:
            entry = pop(queue)
            left = entry & last
            right = following[left]
            if right >= size or symbols[left] < 0 or merge_of(symbols[left] << IDS | symbols[right]) != entry >> places:
                continue
            merged = symbols[left] = entry >> places & LAST_ID
            symbols[right] = -1
            after = following[left] = following[right]
            if after < size:
                before[after] = left
                pair = merge_of(merged << IDS | symbols[after])
                if pair is not None:
                    push(queue, pair << places | left)
            prior = before[left]
            if prior >= 0:
                pair = merge_of(symbols[prior] << IDS | merged)
                if pair is not None:
                    push(queue, pair << places | prior)
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        if 2 * len(self.words) > WORDS_KEPT:
            self.words, self.old_words = {}, self.words
        words, old, firsts = self.words, self.old_words, self.first_ids
        if LATIN.fullmatch(text):
            for word in LATIN_WORDS.findall(text):
                ids = words.get(word)
                if ids is None:
                    ids = words[word] = old.get(word) or tuple(self.merge([firsts[b] for b in word.encode()]))
                out += ids
        else:
            for word, _ in self.pre_tokenize(text):
                out += self.merge([self.symbol[c] for c in word])
        return out

    def _piece(self, piece: str) -> list[int]:
        """One piece, in which the strings of added tokens are those tokens."""
        if self.split_added is None:
            return self._plain(piece)
        out, at = [], 0
        for found in self.split_added.finditer(piece):
            out += [*self._plain(piece[at : found.start()]), self.added[found.group()]]
            at = found.end()
        return out + self._plain(piece[at:])

    def encode(self, text: str) -> np.ndarray:
        if any(" " in s for s in self.added):
            return np.array(self._piece(text), dtype=ID_TYPE)
        return self.cached(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary strings of the ids, concatenated."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.letters[np.repeat(self.ends[ids] - ends, lengths) + np.arange(total)].tobytes()

    def decode_text(self, ids: Sequence[int]) -> str:
        """As UTF-8, with what is not valid replaced."""
        return self.decode(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", decoded: str | None = None) -> DataFrame:
    """``id_column``, ``ids array<int>``: every whole text as token ids. Null and empty texts have no ids.

    ``decoded`` names a further column: the text that the ids decode to, made in the
    same pass. One narrow pass: no shuffle, and a task holds one batch of texts and
    a bounded cache. Rows that repeat are encoded as often as they occur. Other
    columns of ``df`` are not read.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    source = df.select(F.col(id_column), text_of(text_column).alias("_text"))

    def make():
        coder = held(BytePairCoder, spec.value)

        def step(c):
            ids = [coder.encode(t) for t in c["_text"]]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, ID_TYPE), *ids]).astype(np.int32)
            out = {id_column: c[id_column], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
            return out | ({decoded: list(map(coder.decode_text, ids))} if decoded else {})

        return step

    return by_batch(source, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, ids array<int>" + (f", `{decoded}` string" if decoded else ""), make)


def decode_ids(df: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Add ``text_column``: the vocabulary strings of the ids, concatenated and read as UTF-8. Null ids give null."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    schema = with_column(df, text_column, "string")

    def make():
        coder = held(BytePairCoder, spec.value)

        def step(c):
            rows, out = c[ids_column], []
            flat, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            for i in range(len(rows)):
                out.append(coder.decode_text(flat[ends[i] : ends[i + 1]]) if rows[i].is_valid else None)
            return c | {text_column: out}

        return step

    return by_batch(df, schema, make, raw=(ids_column,))
