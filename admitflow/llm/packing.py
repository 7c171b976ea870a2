"""Best-fit decreasing packing of token runs into windows of a fixed capacity.

Best-fit decreasing looks at the runs from the longest to the shortest and puts
each into the tightest open window that still has room. Which window that is
depends on lengths only, and there are at most ``capacity`` different lengths.
So the packing is planned once over the *histogram* of lengths, with windows of
equal room handled as one group, and gives exactly what the one-by-one algorithm
gives for all runs of the corpus. The plan is a list of stretches "runs number a
to b among those of length n go to windows w, w+1, ..., k in each". Its size
depends on the capacity, not on the corpus. Runs are numbered within their
length where they lie, so no task ever sees more than its own runs.
"""

from __future__ import annotations


import json
import os

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from admitflow.llm.bpe import byte_alphabet, read_spec
from admitflow.llm.common import ID_TYPE, LATIN, PieceCache, by_batch, held, text_of
from admitflow.session import cut_lineage


# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TightestRoom:
    """A segment tree over remaining capacities: the smallest one of at least ``need`` that has an open window."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)

    def set(self, room: int, filled: bool) -> None:
        node = room + self.leaves
        self.tree[node] = filled
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        node = need + self.leaves
        if self.tree[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (length, first number, first window, runs per window, first offset) of best-fit decreasing.

    ``histogram``: how many runs there are of each length from 1 to ``capacity``.
    A stretch ends where the next one of its length begins.
    """
    room = TightestRoom(capacity)
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first window, windows)
    stretches: list[tuple[int, int, int, int, int]] = []
    windows = 0

    def put(first: int, count: int, left: int) -> None:
        if count and left:
            groups[left].append((first, count))
            room.set(left, True)

    for length in sorted(histogram, reverse=True):
        number, total = 0, histogram[length]
        while number < total:
            tight = room.tightest(length)
            if tight is None:
                tight, first, count = capacity, windows, -(-(total - number) // (capacity // length))
                windows += count
            else:
                first, count = groups[tight].pop()
                if not groups[tight]:
                    room.set(tight, False)
            # The window just used stays the tightest until it is full.
            each = tight // length
            full, rest = divmod(min(total - number, count * each), each)
            stretches.append((length, number, first, each, capacity - tight))
            put(first, full, tight - each * length)
            if rest:
                put(first + full, 1, tight - rest * length)
            used = full + (rest > 0)
            put(first + used, count - used, tight)
            number += full * each + rest
    return stretches


# Pieces of text whose ids a worker keeps. Changes no result.
PIECES_KEPT = 1_600_000


def library_encoder(spec: str, kept: int = PIECES_KEPT) -> PieceCache:
    """Ids as the tokenizers library gives them, without truncation, padding or special tokens; ``kept`` pieces are remembered.

    Pieces seen before are looked up. New pieces of Latin text go through
    tiktoken with the same vocabulary, which gives the same ids several times
    faster; all others through the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = [t["content"] for t in json.loads(spec)["added_tokens"]]
    quick = _same_by_rank(spec)

    def encode(new: list[str]) -> list[list[int]]:
        if quick is None:
            return [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        ids = [quick(p) if LATIN.fullmatch(p) and not any(a in p for a in added) else None for p in new]
        rest = [p for p, found in zip(new, ids) if found is None]
        others = iter(tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(others).ids if found is None else found for found in ids]

    return PieceCache(encode, kept)


def _encoder(spec: tuple[str, int]) -> PieceCache:
    return library_encoder(*spec)


def _same_by_rank(spec: str):
    """tiktoken's encoder for the vocabulary, if its ids are in the order of its merges; None if not."""
    data, byte_of = json.loads(spec), byte_alphabet()
    vocab, added = data["model"]["vocab"], {t["content"] for t in data["added_tokens"]}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
    merged = [vocab[a + b] for a, b in pairs]
    if merged != sorted(merged) or (merged and merged[0] < len(byte_of)):
        return None
    ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in added}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_runs(
    df: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", kept: int = PIECES_KEPT
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into full windows and one rest: (id, start, length, ids, doc_tokens).

    ``ids`` are little-endian unsigned 32-bit numbers. ``_task`` and ``_number``
    number the runs of one length within a task; store the frame before using
    them, since another run of the plan may deal the rows out differently. Null
    and empty texts are one run of ``end_id``; repeated rows are repeated runs.
    """
    spec = df.sparkSession.sparkContext.broadcast((read_spec(path), kept))
    source = df.select(F.col(id_column), text_of(text_column).alias("_text"))

    def make():
        encode, task, seen = held(_encoder, spec.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def step(columns):
            out = {name: [] for name in (id_column, "start", "length", "ids", "doc_tokens", "_task", "_number")}
            for key, text in zip(columns[id_column], columns["_text"]):
                ids = np.append(encode(text), np.array([end_id], ID_TYPE))
                for start in range(0, len(ids), capacity):
                    run = ids[start : start + capacity]
                    row = (key, start, len(run), run.tobytes(), len(ids), task, int(seen[len(run)]))
                    seen[len(run)] += 1
                    for name, value in zip(out, row):
                        out[name].append(value)
            return out

        return step

    key = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}"
    return by_batch(source, f"{key}, start long, length long, ids binary, doc_tokens long, _task int, _number long", make)


def place_runs(runs: DataFrame, capacity: int = 1024) -> DataFrame:
    """Replace ``_task`` and ``_number`` of stored runs by ``sequence_id`` and ``offset``.

    Other columns are kept. A run's number within its length is its number in
    its task plus the runs of that length in earlier tasks; those totals have one
    row per (task, length). The driver sees the histogram: at most ``capacity`` rows.
    """
    totals = runs.groupBy("_task", "length").agg((F.max("_number") + 1).alias("_n"))
    totals = cut_lineage(totals, "run-totals")
    histogram = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    stretches = plan_windows(histogram, capacity)
    bits = 48  # runs of one length are fewer than 2^48
    plan = runs.sparkSession.sparkContext.broadcast(
        tuple(
            np.array(column, dtype=np.int64)
            for column in zip(*sorted(((length << bits) + number, first, each, offset) for length, number, first, each, offset in stretches))
        )
        or (np.zeros(0, np.int64),) * 4
    )

    @F.pandas_udf("sequence_id long, offset long")
    def window_of(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        starts, first, each, offset = plan.value
        at = (length.to_numpy() << bits) + number.to_numpy()
        k = np.searchsorted(starts, at, "right") - 1
        turn, place = np.divmod(at - starts[k], each[k])
        return pd.DataFrame({"sequence_id": first[k] + turn, "offset": offset[k] + place * length.to_numpy()})

    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = runs.join(before, ["_task", "length"]).withColumn("_at", window_of("length", F.col("_number") + F.col("_before")))
    kept = [c for c in runs.columns if c not in ("_task", "_number")]
    return placed.select(*kept, "_at.sequence_id", "_at.offset")


def pad_length(used: int, capacity: int) -> int:
    """The length a sequence of ``used`` ids is stored with: a power of two as it is, anything else padded to the capacity."""
    return used if used & (used - 1) == 0 else capacity


def sequences(placed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<long>, used): the padded sequences of placed runs that still carry ``ids``.

    A sequence has at most ``capacity`` ids, so a group is small whatever the corpus.
    """
    runs = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("runs"))

    def make():
        def step(columns):
            out = {"sequence_id": columns["sequence_id"], "ids": [], "used": []}
            for group in columns["runs"]:
                ids = np.frombuffer(b"".join(r["ids"] for r in group), ID_TYPE).tolist()
                out["used"].append(len(ids))
                out["ids"].append(ids + [pad_id] * (pad_length(len(ids), capacity) - len(ids)))
            return out

        return step

    return by_batch(runs, "sequence_id long, ids array<long>, used long", make)


