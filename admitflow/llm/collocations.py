"""Phrase collocations by best-first growth with bounds on scores.

Phrases grow word by word. A prefix bounds what grows from it: a phrase is at
most as frequent as its prefix p, and cut after p's first word it scores at most
f(p) / f(first word). So prefixes are expanded in the order of that bound, a
frontier of the best ones at a time, and of three-word phrases only those are
counted that begin with an expanded prefix (or that decide whether a two-word
phrase in reach survives). A language is settled when as many survivors as asked
for score at least as high as all bounds that are still closed; then nothing
unseen can enter, ties included. Otherwise its frontier grows fourfold.

Counting is exact. A task counts the words of its texts in local numbers, so
what it hands to Spark is summed already and a hot phrase is one row per task.
Which words and prefixes are worth counting reaches the tasks as a bitmap of
hashes of a fixed size; what it lets through by accident is dropped by joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.llm.common import give_back, text_of
from admitflow.session import cut_lineage

# What ends a piece of text, and what separates words within one.
STOPS, BLANKS = ".,;:!?\n\v\f\r", " \t"
# The scale of scores, and the share of a phrase's occurrences (in hundredths)
# that lie inside one longer phrase from which on it is dropped.
SCALE, INSIDE = 1_000_000, 50
# Bits of a filter: 4 MB, whatever the corpus. Changes no result.
FILTER_BITS = 1 << 25
# Bytes of text that a task counts at once, and words and phrases that it holds before it hands them on.
CHUNK, HELD_WORDS, HELD_PHRASES = 1 << 21, 1 << 19, 3 << 20
# Frontier of the first round, in times the number of phrases asked for.
FIRST, GROWTH = 2, 4

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in STOPS else 32 if chr(b) in BLANKS else b for b in range(256))
_BREAK, _BLANK = 0, 1  # numbers of the end of a piece and of the nothing between two blanks


# Words whose numbers fit three to a 64-bit key.
_SHORT = 1 << 21


class _Numbers(dict):
    """Numbers for words, given out as words come."""

    def __init__(self):
        self.words = [b"\n", b""]
        super().__init__({b"\n": _BREAK, b"": _BLANK})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.words.append(word)
        return number


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once (rows, if there are two dimensions), with its occurrences or the sum of its counts."""
    axis = 0 if keys.ndim > 1 else None
    if counts is None:
        return np.unique(keys, return_counts=True, axis=axis)
    found, back = np.unique(keys, return_inverse=True, axis=axis)
    return found, np.bincount(back.ravel(), counts, len(found)).astype(np.int64)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several, in their order."""
    out = np.uint64(0)
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def _hashed(words: Sequence[bytes | str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FILTER_BITS)).astype(np.int64)


def filter_of(rows: DataFrame, words: Sequence[str]) -> Broadcast:
    """A bitmap, packed, of the hashes of (lang, *words). The driver sees ``FILTER_BITS`` bits at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_hashed(batch.column(c).to_pylist()) for c in ("lang", *words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(_mixed(*columns))))], ["bit"])

    block = FILTER_BITS >> 9

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for numbers in batch.column("bits"):
                flags = np.zeros(block, np.uint8)
                flags[numbers.values.to_numpy() % block] = 1
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "bits"])

    found = rows.select("lang", *words).mapInArrow(bits, "bit long").distinct()
    blocks = found.groupBy((F.col("bit") / block).cast("long").alias("block")).agg(F.collect_list("bit").alias("bits"))
    flags = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in blocks.mapInArrow(packed, "block long, bits binary").collect():
        at = row.block * block // 8
        flags[at : at + block // 8] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(flags)


def _has(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class Counter:
    """Counts words, pairs or triples of a task's texts, per language; what it holds is bounded but for one chunk."""

    def __init__(self, size: int, filters: Sequence[np.ndarray] = ()):
        self.size, self.filters = size, filters
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.hashes = np.zeros(0, np.uint64)
        self.counts: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, lang: str, texts: list[str]) -> None:
        # Every stop becomes a word of its own, so no phrase reaches over it.
        raw = "\n".join(texts).encode().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.number.__getitem__, raw), np.int64, len(raw))
        ids = ids[ids != _BLANK]
        if self.filters:
            self.hashes = np.concatenate([self.hashes, _hashed(self.number.words[len(self.hashes) :])])
        keys = (self._words, self._pairs, self._triples)[self.size - 1](lang, ids)
        if self.size == 3:
            # Numbers of a very long chunk need a row each, others fit into one key.
            short = len(self.number) <= _SHORT
            keys, kind = (keys[0] << 42 | keys[1] << 21 | keys[2], "packed") if short else (np.stack(keys, axis=1), "rows")
        else:
            kind = "packed"
        found = _summed(keys)
        self.counts.setdefault((lang, kind), []).append(found)
        self.held += len(found[1])

    def _words(self, lang: str, ids: np.ndarray) -> np.ndarray:
        return ids[ids > _BLANK]

    def _pairs(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Pairs of words that are both in the filter, in one number."""
        (words,) = self.filters
        seed = _hashed([lang])
        fine = np.zeros(len(self.hashes), bool)
        used = np.unique(ids)
        fine[used] = _has(words, _mixed(seed, self.hashes[used])) & (used > _BLANK)
        fine = fine[ids]
        at = np.flatnonzero(fine[:-1] & fine[1:])
        return ids[at] << 32 | ids[at + 1]

    def _triples(self, lang: str, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Triples of two frequent pairs of which the first is open, or the last one's survival is at stake."""
        frequent, opened, at_stake = self.filters
        seed, hashes = _hashed([lang]), self.hashes[ids]
        word = ids > _BLANK
        pair = _mixed(seed, hashes[:-1], hashes[1:])
        fine = word[:-1] & word[1:]
        fine[fine] = _has(frequent, pair[fine])
        at = np.flatnonzero(fine[:-1] & fine[1:])
        at = at[_has(opened, pair[at]) | _has(at_stake, pair[at + 1])]
        return ids[at], ids[at + 1], ids[at + 2]

    def full(self) -> bool:
        return len(self.number) > HELD_WORDS or self.held > HELD_PHRASES

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(self.number.words, pa.binary()).cast(pa.string())
        for (lang, kind), parts in self.counts.items():
            keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            if self.size == 1:
                columns = [keys]
            elif self.size == 2:
                columns = [keys >> 32, keys & 0xFFFFFFFF]
            else:
                columns = list(keys.T) if kind == "rows" else [keys >> 42, keys >> 21 & _SHORT - 1, keys & _SHORT - 1]
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                langs = pa.repeat(pa.scalar(lang, pa.string()), len(counts[part]))
                arrays = [langs, *(words.take(pa.array(c[part])) for c in columns), pa.array(counts[part])]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", *word_columns(self.size), "n"])
        self._forget()


def word_columns(size: int) -> list[str]:
    return [f"w{i + 1}" for i in range(size)]


def counted(texts: DataFrame, size: int, filters: Sequence[Broadcast] = (), least: int = 1) -> DataFrame:
    """(lang, w1, ..., f long): how often each sequence of ``size`` words occurs within pieces, overlaps included, if ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, waiting, size_of = Counter(size, [f.value for f in filters]), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size_of += len(text)
                if size_of >= CHUNK:
                    for key, group in waiting.items():
                        counter.add(key, group)
                    waiting, size_of = {}, 0
                    if counter.full():
                        yield from counter.hand_on()
        for key, group in waiting.items():
            counter.add(key, group)
        yield from counter.hand_on()
        give_back()

    names = word_columns(size)
    schema = ", ".join(["lang string", *(f"{w} string" for w in names), "n long"])
    found = texts.mapInArrow(run, schema).groupBy("lang", *names).agg(F.sum("n").alias("f"))
    return found if least <= 1 else found.where(F.col("f") >= least)


def score_of(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly: counts below 10^15 give products of at most 37 digits."""
    a, left, right = (f"cast({c} as decimal(15,0))" for c in (a, left, right))
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * {a} * {a}) div ({left} * {right})")


def reach(df: DataFrame, column: str, want: int, width: int = 1) -> DataFrame:
    """(lang, cut): the highest multiple of ``width`` that at least ``want`` values of ``column`` reach, 0 if there are fewer.

    Values are at most SCALE, so a language has at most SCALE / ``width`` + 1 rows in the window.
    """
    steps = df.groupBy("lang", F.floor(F.col(column) / width).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    run = steps.withColumn("_run", F.sum("_n").over(Window.partitionBy("lang").orderBy(F.desc("_step"))))
    return run.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("_run") >= want, F.col("_step"))) * width, F.lit(0)).alias("cut"))


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Add the words' own counts, the score, and ``bound``, which no phrase that begins with the pair exceeds."""
    first = words.select("lang", "w1", F.col("f").alias("f1"))
    second = words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2"))
    known = pairs.join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
    return known.withColumns({"score": score_of("f", "f1", "f2"), "bound": score_of_prefix("f", "f1")})


def score_of_prefix(prefix: str, first: str) -> Column:
    """floor(SCALE * prefix / first): a is at most the prefix's count, and so is a over what is right of the first word."""
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * cast({prefix} as decimal(15,0))) div cast({first} as decimal(15,0))")


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the counts of all parts, the score of the lowest cut and that cut's sides, and what its pairs are."""
    head = pairs.select("lang", "w1", "w2", F.col("f").alias("f12"), "f1", F.col("bound").alias("bound12"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"), F.col("f2").alias("f3"), F.col("score").alias("score23"))
    known = triples.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    known = known.withColumns({"_one": score_of("f", "f1", "f23"), "_two": score_of("f", "f12", "f3")})
    early = F.col("_one") <= F.col("_two")
    sides = {"score": F.least("_one", "_two"), "l": F.when(early, F.col("f1")).otherwise(F.col("f12")), "r": F.when(early, F.col("f23")).otherwise(F.col("f3"))}
    return known.withColumns(sides).drop("_one", "_two")


def surviving(pairs: DataFrame, triples: DataFrame, cuts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases that score their language's cut or more and do not mostly lie inside a longer one."""
    inside = [
        triples.where(F.col("f") * 100 >= F.col(whole) * INSIDE).select("lang", *(F.col(c).alias(w) for c, w in zip(words, ("w1", "w2"))))
        for whole, words in (("f12", ("w1", "w2")), ("f23", ("w2", "w3")))
    ]
    two = pairs.join(inside[0].unionByName(inside[1]).distinct(), ["lang", "w1", "w2"], "left_anti")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    three = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    return two.unionByName(three).join(cuts.select("lang", "cut"), "lang").where("score >= cut").drop("cut")


def mine(documents: DataFrame, top: int = 2000, least: int = 10, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    a, l and r count the phrase and the two sides of its lowest-scoring cut (the
    earliest of equal ones), n all words of the language; score is floor(SCALE *
    a^2 / (l * r)). Phrases that occur fewer than ``least`` times do not count, nor
    do those of which at least ``INSIDE`` in a hundred occurrences lie inside one
    longer phrase. A-Z are lower-cased. Null texts are empty, null languages
    ``und``; repeated rows count as often as they occur; ties go by count, then by
    the phrase's bytes. A language without phrases gives no row. Other columns
    are not read.
    """
    texts = documents.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_of(text_column).alias("text"))
    all_words = cut_lineage(counted(texts, 1), "words")
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = all_words.where(F.col("f") >= least)
    pairs = counted(texts, 2, [filter_of(words, ["w1"])], least)
    pairs = cut_lineage(scored_pairs(pairs, words), "pairs")
    frequent = filter_of(pairs, ["w1", "w2"])

    cuts = totals.select("lang", F.lit(SCALE + 1).cast("long").alias("cut"))
    triples, want = None, FIRST * top
    while True:
        lower = reach(pairs, "bound", want, 16).withColumnRenamed("cut", "_low")
        opening = cuts.withColumnRenamed("cut", "closed").join(lower, "lang")
        if triples is not None:  # settled languages stay as they are
            opening = opening.join(settled, "lang", "left").withColumn("_low", F.when(F.col("_done"), F.col("closed")).otherwise(F.col("_low"))).drop("_done")
        opening = cut_lineage(opening.withColumn("cut", F.least("_low", "closed")).drop("_low"), "opening")
        new = lambda column: (F.col(column) >= F.col("cut")) & (F.col(column) < F.col("closed"))
        at_hand = pairs.join(opening, "lang")
        filters = [frequent, filter_of(at_hand.where(new("bound")), ["w1", "w2"]), filter_of(at_hand.where(new("score")), ["w1", "w2"])]
        found = scored_triples(counted(texts, 3, filters, least), pairs).join(opening, "lang")
        opened = F.greatest("bound12", "score23")
        found = found.where((opened >= F.col("cut")) & (opened < F.col("closed"))).drop("cut", "closed")
        found = cut_lineage(found, "triples")
        triples = found if triples is None else triples.unionByName(found)
        cuts = opening.select("lang", "cut")
        there = surviving(pairs, triples, cuts).groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
        settled = cuts.join(there, "lang", "left").select("lang", ((F.col("cut") == 0) | (F.coalesce("_n", F.lit(0)) >= top)).alias("_done"))
        settled = cut_lineage(settled, "settled")
        if settled.where(~F.col("_done")).isEmpty():
            break
        want *= GROWTH

    survivors = cut_lineage(surviving(pairs, triples, cuts), "survivors")
    best = survivors.join(reach(survivors, "score", top), "lang").where("score >= cut").drop("cut")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
