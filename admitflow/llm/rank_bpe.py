"""Byte-level BPE by ranks, on length-bucketed matrices of symbols, and decoding.

A text is cut into the matches of a pattern and each match is encoded on its
own. Matches that are new to a worker are encoded together: those of like length
are the rows of one padded matrix, and in each round every row merges its
leftmost pair of the lowest rank. Ranks of pairs come from a hash table in two
numpy arrays; after a merge a row closes its gap, and only the two pairs beside
the merge are looked up again. Rows without a pair to merge leave the matrix.

The rank file's path is a parameter. The driver reads it (about 1 MB, whatever
the corpus) and sends its content along, so executors need no copy of it.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.bpe import read_spec
from admitflow.llm.common import ID_TYPE, by_batch, held, text_of, with_column

# No pair: higher than any rank.
NONE = np.int32(2**31 - 1)
# A symbol that pairs with nothing, right of a row's end.
PAD = -1
# Cells of one matrix, and the longest match that becomes a row of one.
CELLS, WIDEST = 1 << 18, 512
# Matches whose ids a worker keeps, in two generations. Changes no result.
MATCHES_KEPT = 600_000
# An odd number that spreads keys over the table (the golden ratio in 64 bits).
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank, by open addressing with linear probing."""

    def __init__(self, left: Sequence[int], right: Sequence[int], ranks: Sequence[int]):
        keys = self._key(np.asarray(left, np.int64), np.asarray(right, np.int64))
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
        values, at = np.asarray(ranks, np.int32), self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[at[waiting]] == 0]
            self.keys[at[free]] = keys[free]  # of those that meet in a slot, one gets it
            got = free[self.keys[at[free]] == keys[free]]
            self.ranks[at[got]] = values[got]
            waiting = waiting[self.keys[at[waiting]] != keys[waiting]]
            at[waiting] = (at[waiting] + 1) & self.last

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Never zero, which marks a free slot."""
        return ((left.astype(np.int64) + 1) << 32 | (right.astype(np.int64) + 1)).view(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where the two do not merge."""
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.last
            found = self.keys[at[open_]]
            hit = open_[found == keys[open_]]
            out[hit] = self.ranks[at[hit]]
            open_ = open_[(found != keys[open_]) & (found != 0)]
        return out.reshape(left.shape)


class RankCoder:
    """Encoder and decoder of one rank file: lines of a token's bytes in base64 and its rank, which is its id."""

    def __init__(self, spec: str, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, filter(str.strip, spec.splitlines()))}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file has no token for the bytes {missing[:5]}")
        self.ranks, self.strings = ranks, {i: token for token, i in ranks.items()}
        self.firsts = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = (
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        )
        self.pair = PairTable(*(list(zip(*splits)) or ([], [], [])))
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_matches(self, matches: Sequence[bytes]) -> list[bytes]:
        """Ids of each match, packed, in the order given."""
        out: list[bytes] = [b""] * len(matches)
        rows = []
        for i, match in enumerate(matches):
            whole = self.ranks.get(match)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(match) > WIDEST:
                out[i] = self._one_long(self.firsts[np.frombuffer(match, np.uint8)]).astype(ID_TYPE).tobytes()
            elif match:
                rows.append(i)
        rows.sort(key=lambda i: len(matches[i]))
        at = 0
        while at < len(rows):
            # A bucket: matches at most a quarter longer than its shortest one.
            widest = max(len(matches[rows[at]]) * 5 // 4, 4)
            many, end = max(1, CELLS // widest), at
            while end < len(rows) and end - at < many and len(matches[rows[end]]) <= widest:
                end += 1
            self._bucket([matches[i] for i in rows[at:end]], rows[at:end], out)
            at = end
        return out

    def _bucket(self, matches: list[bytes], places: list[int], out: list[bytes]) -> None:
        """All matches of a bucket at once; ``out[places[k]]`` gets the ids of match k."""
        lengths = np.array([len(m) for m in matches])
        width = int(lengths.max()) + 1  # the last column stays padding
        columns = np.arange(width)
        symbols = np.full((len(matches), width), PAD, np.int32)
        symbols[columns < lengths[:, None]] = self.firsts[np.frombuffer(b"".join(matches), np.uint8)]
        ranks = np.full((len(matches), width), NONE, np.int32)
        ranks[:, :-1] = self.pair(symbols[:, :-1], symbols[:, 1:])
        places = np.array(places)
        while True:
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            lowest = ranks[np.arange(len(ranks)), at]
            done = lowest == NONE
            if done.any():
                packed, row = symbols[done].astype(ID_TYPE).tobytes(), 4 * width
                for k, (place, length) in enumerate(zip(places[done].tolist(), lengths[done].tolist())):
                    out[place] = packed[k * row : k * row + 4 * length]
                left = ~done
                if not left.any():
                    return
                places, lengths, at, lowest = places[left], lengths[left], at[left], lowest[left]
                # Rows that are through go, and so do columns that no row uses any more.
                width = int(lengths.max()) + 1
                symbols, ranks, columns = symbols[left, :width], ranks[left, :width], columns[:width]
            each, lengths = np.arange(len(places)), lengths - 1
            symbols[:, :-1] = np.where(columns[:-1] > at[:, None], symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(columns[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            symbols[each, at] = lowest
            ranks[each, at] = self.pair(lowest, symbols[each, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pair(symbols[before, at[before] - 1], lowest[before])

    def _one_long(self, symbols: np.ndarray) -> np.ndarray:
        """A match too long for a matrix, as a row of its own whose rounds make several merges.

        A round makes the merges of the lowest rank from the left, which is what
        as many single rounds would do, up to the first one that makes a pair of a
        still lower rank. So rounds are about as many as ranks met, not as merges.
        """
        while len(symbols) > 1:
            ranks = self.pair(symbols[:-1], symbols[1:])
            lowest = ranks.min()
            if lowest == NONE:
                break
            at = np.flatnonzero(ranks == lowest)
            # Of pairs that overlap in a chain, every second one is merged.
            chain = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            turn = np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))
            at = at[turn % 2 == 0]
            merged = np.full(len(at), lowest, np.int32)
            prior = np.where(at > 0, symbols[np.maximum(at - 1, 0)], PAD)
            prior[1:][np.diff(at) == 2] = lowest  # the merge just before ends here
            after = np.where(at + 2 < len(symbols), symbols[np.minimum(at + 2, len(symbols) - 1)], PAD)
            lower = np.flatnonzero((self.pair(prior, merged) < lowest) | (self.pair(merged, after) < lowest))
            if len(lower):
                at = at[: lower[0] + 1]
            symbols[at] = lowest
            symbols = np.delete(symbols, at + 1)
        return symbols

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text; all matches that are new are encoded together first."""
        if 2 * len(self.known) > MATCHES_KEPT:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        cut = [self.matches(t) for t in texts]
        new = set().union(*(set(parts).difference(known) for parts in cut))
        kept = {p: old[p] for p in new if p in old}
        known.update(kept)
        fresh = list(new.difference(kept))
        known.update(zip(fresh, self.encode_matches([p.encode() for p in fresh])))
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), ID_TYPE) for parts in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The strings of the ids, concatenated. Bytes that are no valid UTF-8 stay as they are."""
        return b"".join(map(self.strings.__getitem__, ids.tolist()))


def encode_texts(
    df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: str | None = None
) -> DataFrame:
    """``id_column``, ``n_tokens long``, ``ids binary``: every whole text as token ids, little-endian unsigned 32-bit numbers.

    ``decoded`` names a further binary column: what the ids decode to, made in the
    same pass. Null and empty texts have no ids; repeated rows and null ids are
    rows like any other; other columns of ``df`` are not read. One narrow pass: no
    shuffle, and a task holds one batch of texts and a bounded cache.
    """
    spec = df.sparkSession.sparkContext.broadcast((read_spec(path), pattern))
    source = df.select(F.col(id_column), text_of(text_column).alias("_text"))

    def make():
        coder = held(_coder, spec.value)

        def step(c):
            ids = coder.encode(c["_text"])
            out = {id_column: c[id_column], "n_tokens": list(map(len, ids)), "ids": [i.tobytes() for i in ids]}
            return out | ({decoded: list(map(coder.decode, ids))} if decoded else {})

        return step

    key = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}"
    return by_batch(source, f"{key}, n_tokens long, ids binary" + (f", `{decoded}` binary" if decoded else ""), make)


def _coder(spec: tuple[str, str]) -> RankCoder:
    return RankCoder(*spec)


def decode_ids(df: DataFrame, path: str, ids_column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded binary``: the bytes of the vocabulary strings. Null ids give null; a column of that name is replaced."""
    spec = df.sparkSession.sparkContext.broadcast((read_spec(path), ""))
    kept = df.drop(decoded)
    schema = with_column(kept, decoded, "binary")

    def make():
        coder = held(_coder, spec.value)

        def step(c):
            return c | {decoded: [None if ids is None else coder.decode(np.frombuffer(ids, ID_TYPE)) for ids in c[ids_column]]}

        return step

    return by_batch(kept, schema, make)
