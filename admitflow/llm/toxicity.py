"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting uses labelled rows only, at most ``max_labelled`` of them (drawn by a
hash of the id), and never those that are held out. Three parts of them count
tokens by class, one part calibrates. Tokens are words and, for words too rare
to judge, their beginnings. Their log-odds between the classes have a Dirichlet
prior made of the words' overall frequencies; those that are certain enough are
positive scores, any other token costs a fixed penalty.

Scoring is one narrow pass over all texts: one linear scan finds every maximal
scoring segment, and extreme-value statistics of random sequences say which of
them are too high to be chance. What is sent to the executors is the model,
whose size is bounded by the labelled sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import by_batch, fold, give_back, text_of, whole_row
from admitflow.session import cut_lineage

WORD = re.compile(r"\w+")
# Lengths of word beginnings that stand in for a word.
BEGINNINGS = (6, 5, 4, 3)
# A unit seen less often in the sample is not judged.
LEAST_COUNT = 5
# Words whose score a task keeps before it starts afresh. Changes no result.
WORDS_KEPT = 100_000
# Words a counting task holds before it hands their units on.
COUNTS_KEPT = 60_000
# A segment is significant if no more than this many as high are expected by chance.
SIGNIFICANT = 0.05


def units_of(word: str) -> list[str]:
    """The word and its beginnings, the most specific first. A beginning is marked by a hyphen, which no word has."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """What scoring needs. ``scores``: log-odds by unit, None where a unit was judged and found harmless."""

    scores: dict[str, float | None] = field(default_factory=dict)
    penalty: float = 0.5
    decay: float = 1.0
    scale: float = 0.1
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    centre: tuple[float, ...] = (0.0, 0.0)
    spread: tuple[float, ...] = (1.0, 1.0)

    def word_score(self, word: str) -> float:
        """The score of the most specific judged unit, zero if it is harmless or none is judged."""
        for unit in units_of(word):
            if unit in self.scores:
                return self.scores[unit] or 0.0
        return 0.0

    def expected(self, score: float, tokens: int) -> float:
        """How many segments at least this high a clean text of that length has by chance."""
        return math.exp(min(700.0, -self.excess(score, tokens)))

    def excess(self, score: float, tokens: int) -> float:
        """Minus the logarithm of that number."""
        return self.decay * score - math.log(self.scale * tokens)

    def probability(self, features: Sequence[float]) -> float:
        x = self.weights[0] + sum(
            w * (f - c) / s for w, f, c, s in zip(self.weights[1:], features, self.centre, self.spread)
        )
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Each candidate keeps the running totals before its start and at its end, and a
    link to the nearest earlier candidate that starts lower. A new positive score
    joins the nearest earlier candidate that starts lower than itself, if that one
    ends lower than the new one, and the check is repeated. Candidates that a link
    passes over start no lower, so the search jumps along the links.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total at end, link
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, low, k = at, before, len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                found.append((start, at + 1, low, total, k))
                break
            start, _, low, _, link = found[k]
            del found[k:]
            k = link
    return [(s, e, high - low) for s, e, low, high, _ in found]


class Scanner:
    """Finds segments in texts, remembering words for the length of a task."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def hits(self, words: Sequence[str]) -> list[tuple[int, float]]:
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        known, judge = self.known, self.model.word_score
        scores = list(map(known.get, words))
        if None in scores:
            known.update((w, judge(w)) for w in {w for w, s in zip(words, scores) if s is None})
            scores = list(map(known.__getitem__, words))
        return [(i, s) for i, s in enumerate(scores) if s > 0] if any(scores) else []

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and the segments (first token, token after the last, score)."""
        words = WORD.findall(text.lower())
        hits = self.hits(words)
        if not hits:
            return len(words), []
        # Tokens between hits are one negative step, which changes no segment.
        steps, places, last = [], [], 0
        for i, score in hits:
            if i > last:
                steps.append(-self.model.penalty * (i - last))
                places.append((last, i))
            steps.append(score)
            places.append((i, i + 1))
            last = i + 1
        return len(words), [(places[s][0], places[e - 1][1], v) for s, e, v in maximal_segments(steps)]

    def spans(self, text: str, scanned: tuple | None = None) -> list[tuple[int, int, float, float]]:
        """Significant passages as code points: (start, end, score, number expected by chance). ``scanned``: the text's segments, if known."""
        count, found = scanned or self.segments(text)
        kept = [(s, e, v, x) for s, e, v in found if (x := self.model.expected(v, count)) <= SIGNIFICANT]
        if not kept:
            return []
        words = [m.span() for m in WORD.finditer(text)]
        if len(words) != count:  # lower-casing changed how the text falls into words
            return [(0, len(text), v, x) for _, _, v, x in kept]
        return [(words[s][0], words[e - 1][1], v, x) for s, e, v, x in kept]

    def features(self, text: str, scanned: tuple | None = None) -> tuple[float, float]:
        """The best segment's excess over chance, and that of all significant segments, by logarithm. Both allow for the length."""
        count, found = scanned or self.segments(text)
        excess = [self.model.excess(v, count) for _, _, v in found]
        certain = sum(x for x in excess if x >= -math.log(SIGNIFICANT))
        return min(max(excess, default=-10.0), 60.0), math.log1p(certain)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, label: str) -> DataFrame:
    """(text, y, part): at most about ``max_labelled`` labelled rows; part 0, the held-out rows, is never among them."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("part", fold("doc_id")).where("part != 0")
    rows = known.count()
    if rows > max_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 20)) < int(max_labelled / rows * (1 << 20)))
    # The broadcast has at most about max_labelled rows of three numbers.
    return docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(known), "doc_id").select("text", "y", "part")


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): texts by class that have the unit, so that one text's repetitions count once.

    A beginning counts each of a text's words that start with it. What a task
    finds is added up before it is shuffled. Texts that repeat count once, as toxic
    if any of their labels says so.
    """

    class Count:
        def __init__(self):
            self.counts = (Counter(), Counter())

        def __call__(self, c):
            for text, y in zip(c["text"], c["y"]):
                self.counts[1 if y else 0].update(set(WORD.findall(text.lower())))
            return self.finish() if sum(map(len, self.counts)) > COUNTS_KEPT else {"unit": [], "toxic": [], "clean": []}

        def finish(self):
            units = [Counter(), Counter()]
            for words, into in zip(self.counts, units):
                for word, n in words.items():
                    for unit in units_of(word):
                        into[unit] += n
            names = list(units[0].keys() | units[1].keys())
            self.counts = (Counter(), Counter())
            return {"unit": names, "toxic": [units[1][u] for u in names], "clean": [units[0][u] for u in names]}

    counted = by_batch(sample.groupBy("text").agg(F.max("y").alias("y")), "unit string, toxic long, clean long", Count)
    return counted.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, prior: float) -> DataFrame:
    """Add ``delta`` and ``z``: log-odds of a unit between the classes, and in standard deviations.

    The prior counts a unit ``prior`` times its occurrences in both classes.
    """
    words = counts.where(~F.col("unit").endswith("-")).agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = (float(n or 0) for n in words)
    extra = prior * (F.col("toxic") + F.col("clean"))
    mass = prior * (toxic + clean)

    def odds(own: str, total: float) -> Column:
        return F.log((F.col(own) + extra) / F.greatest(F.lit(total + mass) - F.col(own) - extra, F.lit(1e-9)))

    spread = F.sqrt(1 / (F.col("toxic") + extra) + 1 / (F.col("clean") + extra))
    delta = odds("toxic", toxic) - odds("clean", clean)
    return counts.withColumn("delta", delta).withColumn("z", F.col("delta") / spread)


def judged_units(counts: DataFrame, prior: float, certain: float) -> dict[str, float | None]:
    """Log-odds of the certainly toxic units; None for other judged units that a toxic beginning would cover."""
    rated = cut_lineage(log_odds(counts.where(F.col("toxic") + F.col("clean") >= LEAST_COUNT), prior), "unit-odds")
    scores = {r.unit: r.delta for r in rated.where((F.col("z") >= certain) & (F.col("delta") > 0)).select("unit", "delta").collect()}
    starts = {u[:-1] for u in scores if u.endswith("-")}
    shortest = tuple(s for s in starts if not any(s[:n] in starts for n in range(1, len(s))))
    if shortest:
        covered = F.substring("unit", 1, min(BEGINNINGS)).isin(sorted({s[: min(BEGINNINGS)] for s in shortest}))
        for r in rated.where(covered).select("unit").collect():
            if r.unit not in scores and r.unit.startswith(shortest):
                scores[r.unit] = None
    return scores


def chance_decay(histogram: dict[float, int], penalty: float) -> float:
    """The positive root of "mean of exp(decay * score) is 1" over the tokens of clean texts.

    One token more than was seen is given the highest score, so that a model
    whose units never occur in clean texts has a finite decay.
    """
    highest = max([s for s in histogram if s > 0], default=1.0)
    counts = Counter(histogram)
    counts[highest] += 1
    counts[-penalty] += 1
    total = sum(counts.values())

    def excess(x: float) -> float:
        return sum(n * math.exp(min(x * s, 700.0)) for s, n in counts.items()) / total - 1

    if sum(n * s for s, n in counts.items()) >= 0:
        return 0.1
    low, high = 0.0, 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def clean_scores(sample: DataFrame, model: Model) -> dict[float, int]:
    """How often clean tokens have which score, to one decimal: a few hundred rows at most."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    class Tally:
        def __init__(self):
            self.scanner, self.counts = Scanner(sent.value), Counter()

        def __call__(self, c):
            for text in c["text"]:
                words = WORD.findall(text.lower())
                hits = self.scanner.hits(words)
                self.counts.update(round(s, 1) for _, s in hits)
                self.counts[-sent.value.penalty] += len(words) - len(hits)
            return {"score": [], "n": []}

        def finish(self):
            return {"score": list(self.counts), "n": list(self.counts.values())}

    rows = by_batch(sample.where("y = 0").select("text"), "score double, n long", Tally).groupBy("score").agg(F.sum("n").alias("n"))
    return {r.score: r.n for r in rows.collect()}


def logistic(features: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[tuple, tuple, tuple]:
    """Ridge logistic regression by Newton steps: (weights, centre, spread)."""
    centre, spread = features.mean(axis=0), features.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    x = np.column_stack([np.ones(len(y)), (features - centre) / spread])
    w = np.zeros(x.shape[1])
    pull = np.diag([0.0] + [ridge * len(y) ** 0.5] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist()), tuple(centre.tolist()), tuple(spread.tolist())


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 50_000, prior: float = 0.05,
    certain: float = 3.0, penalty: float = 0.5,
) -> Model:
    """Fit on labelled rows that are not held out, at most about ``max_labelled`` of them.

    Rows whose id's crc32 leaves 1 by 5 calibrate, the others count. Without
    rows of both classes to calibrate on, a text scores high if it has a
    significant segment.
    """
    sample = cut_lineage(labelled_sample(docs, labels, max_labelled, label), "labelled")
    counting, calibrating = sample.where("part != 1"), sample.where("part = 1")
    model = Model(judged_units(unit_counts(counting), prior, certain), penalty)
    model.decay = chance_decay(clean_scores(counting, model), penalty)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def make():
        scanner = Scanner(sent.value)
        return lambda c: {"y": c["y"], "f": [list(scanner.features(t)) for t in c["text"]]}

    rows = by_batch(calibrating.select("text", "y"), "y int, f array<double>", make).collect()
    y = np.array([r.y for r in rows], dtype=float)
    if len(set(y.tolist())) == 2:
        model.weights, model.centre, model.spread = logistic(np.array([r.f for r in rows]), y)
    else:
        model.weights, model.centre, model.spread = (-3.0, 1.0, 0.0), (0.0,) * 2, (1.0,) * 2
    return model


def score_column(model: Model, text: Column, docs: DataFrame, passages: bool = True) -> Column:
    """struct<score, passages>: the probability of the label, and the significant passages as code points (null unless ``passages``).

    A text is split and scanned once, for both.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start:long,end:long,score:double,expected:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(sent.value)
        for batch in batches:
            scores, marked = [], []
            for text in batch.tolist():
                scanned = scanner.segments(text)
                scores.append(sent.value.probability(scanner.features(text, scanned)))
                marked.append([dict(zip(("start", "end", "score", "expected"), p)) for p in scanner.spans(text, scanned)] if passages else None)
            yield pd.DataFrame({"score": scores, "passages": marked})
        del scanner
        give_back()

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def score_texts(docs: DataFrame, model: Model, text_column: str = "text", score: str = "score", passages: str = "passages") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text and its significant toxic passages.

    Null and empty texts are scored as texts without words. Rows that repeat
    have equal scores. Columns named ``score`` or ``passages`` are replaced.
    """
    kept = [f"doc.`{c}`" for c in docs.columns if c not in (score, passages)]
    marked = docs.select(whole_row(docs).alias("doc"), score_column(model, F.col(text_column), docs).alias("found"))
    return marked.select(*kept, F.col("found.score").alias(score), F.col("found.passages").alias(passages))
