"""Secrets in texts: fixed patterns, and strings that only chance could have written.

Besides the patterns, every run of at least 20 characters of the usual encodings
is examined. Three tests ask whether it could be random in its inferred
encoding: chi-squared uniformity over the alphabet, the number of runs above and
below its middle, and the correlation of neighbours; Fisher's method combines
them. What passes as random still has to be unlike ordinary text: its
probability under the letter frequencies of the whole corpus goes through
Benjamini-Hochberg, separately for each class of length, since short strings
prove less than long ones and would otherwise use up the long ones' share.

The corpus is passed over three times, narrowly: letters, candidates, result.
Between them only counts reach the driver, of a size fixed by the classes.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import by_batch, text_of

# The base patterns, and the shortest group or match that counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
# Maximal runs of at least HEX_LEAST, which are the runs of such digits that are long enough.
HEX_RUN = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}")
# What any text with an assignment has in it, in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

# Whole runs, wherever they stand; '=' is padding only if nothing of the encoding follows.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
LENGTH_CLASSES = (20, 24, 32, 48, 96)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets from narrow to wide; a string is taken to be in the first that has all its characters.
ALPHABETS = tuple(
    (set(a), {c: i for i, c in enumerate(a)})
    for a in (
        DIGITS, DIGITS + LOWER[:6], DIGITS + UPPER[:6], UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER,
        UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
    )
)
COUNTED = DIGITS + LOWER + UPPER + "+/-_"
# A string with a combined probability below this is not random.
NOT_RANDOM = 0.001
# The share of false ones among the strings added to the base matches.
RATE = 0.01
# Evidence is minus the decimal logarithm of a probability, kept in steps of 1 / STEPS up to a largest.
STEPS, MOST_EVIDENCE = 20, 300.0


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """By the cube-root normal approximation."""
    return normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def uniformity(places: np.ndarray, size: int) -> float:
    """Chi-squared over equal stretches of the alphabet, as many as leave five characters expected in each."""
    cells = max(2, min(size, len(places) // 5))
    cell = places * cells // size
    share = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    expected = share * len(places)
    seen = np.bincount(cell, minlength=cells)
    return chi_squared_tail(float(((seen - expected) ** 2 / expected).sum()), cells - 1)


def runs_test(places: np.ndarray, size: int) -> float:
    """Two-sided, for the stretches in the upper and lower half of the alphabet."""
    high = places >= size / 2
    ones, n = int(high.sum()), len(high)
    zeros = n - ones
    if not ones or not zeros:
        return 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * ones * zeros / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * normal_tail(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_correlation(places: np.ndarray) -> float:
    """Two-sided, for neighbours."""
    x = places - places.mean()
    total = float((x * x).sum())
    if total == 0:
        return 0.0
    n = len(x)
    return 2 * normal_tail(abs(float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n))


def combined(probabilities: list[float]) -> float:
    """Fisher's method; the tail of chi-squared with an even number of degrees of freedom is a finite sum."""
    half = -sum(math.log(max(p, 1e-300)) for p in probabilities)
    term = total = 1.0
    for k in range(1, len(probabilities)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def randomness(string: str) -> tuple[float, int]:
    """The combined probability that the string is random in its encoding, and the size of that alphabet (0: none)."""
    core = string.rstrip("=")
    letters = set(core)
    for members, place in ALPHABETS:
        if letters <= members:
            places = np.array([place[c] for c in core])
            return combined([uniformity(places, len(place)), runs_test(places, len(place)), serial_correlation(places)]), len(place)
    return 0.0, 0


@dataclass(frozen=True)
class Letters:
    """Logarithms of the characters' frequencies in the corpus; of all characters for which an alphabet is inferred."""

    log_share: dict[str, float]

    @staticmethod
    def of(counts: dict[str, int]) -> Letters:
        total = sum(counts.values()) + len(COUNTED)
        return Letters({c: math.log((counts.get(c, 0) + 1) / total) for c in COUNTED})

    def evidence(self, string: str, size: int) -> float:
        """Minus the decimal logarithm of how likely ordinary text is at least this much better explained as random."""
        core, log_size = string.rstrip("="), math.log(size)
        gain = [(math.exp(v), -log_size - v) for v in self.log_share.values()]
        mean = sum(p * g for p, g in gain)
        variance = sum(p * (g - mean) ** 2 for p, g in gain)
        score = sum(-log_size - self.log_share[c] for c in core)
        z = (score - mean * len(core)) / math.sqrt(variance * len(core))
        if z > 30:  # the tail is smaller than the smallest number
            return min(MOST_EVIDENCE, (z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10))
        return min(MOST_EVIDENCE, -math.log10(max(normal_tail(z), 1e-300)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' matches, leftmost and non-overlapping for each kind, by start and then kind."""
    found = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, letters: Letters, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, end, length class, evidence) of encoded strings apart from the base matches; no evidence if not random."""
    found = []
    for m in ENCODED.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for _, s, e in base):
            continue
        chance, size = randomness(m.group())
        evidence = letters.evidence(m.group(), size) if chance >= NOT_RANDOM else 0.0
        found.append((start, end, bisect.bisect_right(LENGTH_CLASSES, end - start) - 1, math.floor(evidence * STEPS) / STEPS))
    return found


def letter_counts(docs: DataFrame, text_column: str = "text") -> dict[str, int]:
    """Occurrences of each character that encodings use, over all whole texts. The driver gets 66 numbers."""

    class Count:
        def __init__(self):
            self.counts = np.zeros(256, dtype=np.int64)

        def __call__(self, c):
            self.counts += np.bincount(np.frombuffer("".join(c["text"]).encode(), np.uint8), minlength=256)
            return {"code": [], "n": []}

        def finish(self):
            return {"code": list(range(256)), "n": self.counts.tolist()}

    rows = by_batch(docs.select(text_of(text_column).alias("text")), "code int, n long", Count).groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r.code): r.n for r in rows.collect() if r.code < 128 and chr(r.code) in COUNTED}


SPAN = "struct<kind:string,start:long,end:long>"
CANDIDATE = "struct<start:long,end:long,class:int,evidence:double>"


def scan_column(letters: Letters, text: Column) -> Column:
    """struct<base, found>: base matches, and candidates with their evidence."""

    @F.pandas_udf(f"base array<{SPAN}>, found array<{CANDIDATE}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"base": [], "found": []}
            for t in batch.tolist():
                base = base_spans(t)
                out["base"].append([dict(zip(("kind", "start", "end"), s)) for s in base])
                out["found"].append([dict(zip(("start", "end", "class", "evidence"), s)) for s in candidates(t, letters, base)])
            yield pd.DataFrame(out)

    return scan(F.coalesce(text.cast("string"), F.lit("")))


def discovery_cuts(counts: dict[tuple[int, float], int], rate: float) -> dict[int, float]:
    """Least evidence per length class at which no more than ``rate`` of the discoveries are expected to be false."""
    cuts = {}
    for k in {c for c, _ in counts}:
        own = sorted(((e, n) for (c, e), n in counts.items() if c == k), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for evidence, n in own:
            seen += n
            if evidence > 0 and 10**-evidence <= rate * seen / total:
                cuts[k] = evidence
    return cuts


def fit_cuts(scanned: DataFrame, rate: float) -> dict[int, float]:
    """The cuts for stored candidates (column ``found``). The driver gets a count per class and step of evidence."""
    each = scanned.select(F.explode("found").alias("f")).groupBy("f.class", "f.evidence").count()
    return discovery_cuts({(r["class"], r.evidence): r["count"] for r in each.collect()}, rate)


def all_spans(cuts: dict[int, float]) -> Column:
    """array<kind, start, end> of the columns ``base`` and ``found``, by start and then kind."""
    passes = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)) if cuts else None

    def kept(f: Column) -> Column:
        return F.lit(False) if passes is None else F.coalesce(f["evidence"] >= passes[f["class"]], F.lit(False))

    added = F.transform(
        F.filter("found", kept),
        lambda f: F.struct(F.lit("random").alias("kind"), f["start"].alias("start"), f["end"].alias("end")),
    )
    order = F.create_map(*(F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair))
    keyed = F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def span_text(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, letters: Letters, cuts: dict[int, float], text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``. A null text stays null; overlapping spans get one mark."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else redacted(t, letters, cuts, mark) for t in batch.tolist()], dtype=object)

    return docs.withColumn(text_column, cleaned(F.col(text_column)))


def redacted(text: str, letters: Letters, cuts: dict[int, float], mark: str) -> str:
    base = base_spans(text)
    spans = [s[1:] for s in base]
    spans += [(s, e) for s, e, k, v in candidates(text, letters, base) if k in cuts and v >= cuts[k]]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


