"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from admitflow.session import tune

# Rows that a Python task hands back at once. Texts are long, so few.
ROWS_OUT = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one value, so that helper columns beside it can have any name."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def give_back() -> None:
    """Return what a task has freed, so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_batch(
    df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], raw: tuple[str, ...] = ()
) -> DataFrame:
    """Map Arrow batches of ``df``: ``make()`` is called once a task and gives a function from columns to columns.

    Nothing is kept between batches but what that function itself holds. If it
    has a ``finish``, that gives the last columns once the task's rows are through.
    Columns named in ``raw`` come as Arrow arrays instead of lists, and any column
    may be handed back as one.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()

        def pack(out: dict[str, list]) -> pa.RecordBatch:
            arrays = [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                columns = {name: part.column(i) if name in raw else part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
                yield pack(step(columns))
        if hasattr(step, "finish"):
            yield pack(step.finish())
        del step
        give_back()

    return df.mapInArrow(run, kinds)


def with_column(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column, which replaces one of that name."""
    added = T.StructType.fromDDL(f"`{name}` {kind}").fields
    return T.StructType([f for f in df.schema.fields if f.name != name] + added)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept out of all fitting: crc32 of its id as text leaves no remainder by 5. Null ids are not."""
    return F.coalesce(fold(id_column) == 0, F.lit(False))


def fold(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5))


# A space before a character that is not white space. The pre-tokenizer always
# cuts there, so what lies between two such places is encoded on its own.
PIECE_START = re.compile(r"(?= \S)")
UNEVEN_SPACE = re.compile(r" (?:\s|\Z)")


def pieces(text: str) -> list[str]:
    """Cut a text where the byte-level pre-tokenizer cuts it whatever surrounds the place."""
    if UNEVEN_SPACE.search(text):
        return [p for p in PIECE_START.split(text) if p]
    first, *rest = text.split(" ")
    found = [" " + p for p in rest]
    return [first, *found] if first else found


# Latin text, in which letters, numbers and white space are the same characters
# for every version of the Unicode tables. The byte-level
# pre-tokenizer's pattern, with those characters spelled out.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\n\\t"
LATIN = re.compile(r"[\n\t -~¡-¬®-ÿ]*")
LATIN_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_SPACE}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
    f"|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+"
)


# How token ids are held: unsigned, 32 bits, the lowest byte first.
ID_TYPE = "<u4"


class PieceCache:
    """Token ids by piece, for one Python worker, in two generations.

    When the young one holds half of ``limit`` pieces it becomes the old one, and
    what was in the old one and has not been asked for since goes. What is held
    changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], limit: int = 200_000):
        self.encode, self.limit, self.known, self.old = encode, limit, {}, {}

    def __call__(self, text: str) -> np.ndarray:
        parts = pieces(text)
        if 2 * len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = list(map(known.get, parts))
        if None in found:
            new = []
            for p in {p for p, ids in zip(parts, found) if ids is None}:
                if p in old:
                    known[p] = old[p]
                else:
                    new.append(p)
            known.update((p, struct.pack(f"<{len(ids)}I", *ids)) for p, ids in zip(new, self.encode(new)))
            found = list(map(known.__getitem__, parts))
        return np.frombuffer(b"".join(found), ID_TYPE)


_HELD: dict[tuple, object] = {}


def held(kind: Callable[[str], object], spec: str):
    """``kind(spec)``, made once in each Python worker and kept for its later tasks; the last few are held."""
    key = (kind.__name__, hash(spec))
    if key not in _HELD:
        if len(_HELD) >= 4:
            _HELD.clear()
        _HELD[key] = kind(spec)
    return _HELD[key]
