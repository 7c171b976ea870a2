"""Toxicity: the segment scan against all segments, held-out accuracy, odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from admitflow.llm import queries, toxicity


def by_definition(scores):
    """Maximal segments by recursion: the highest segment (the shortest, leftmost one), then both sides of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, total = best
    right = [(s + j, e + j, v) for s, e, v in by_definition(scores[j:])]
    return by_definition(scores[:i]) + [best] + right


@pytest.mark.parametrize("seed", range(200))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    # Thousandths keep sums from tying, for which the definition is not unique.
    scores = [rng.randint(-4, 4) + rng.random() / 1000 for _ in range(rng.randint(0, 25))]
    got, want = toxicity.maximal_segments(scores), by_definition(scores)
    assert [s[:2] for s in got] == [s[:2] for s in want]
    assert [s[2] for s in got] == pytest.approx([s[2] for s in want])


def test_segments_take_time_in_proportion():
    took = []
    for n in (16_000, 160_000):
        begin = time.process_time()
        assert len(toxicity.maximal_segments([1.0, -2.0] * n)) == n
        took.append(time.process_time() - begin)
    assert took[1] < 25 * took[0] + 0.1


def test_decay_solves_its_equation():
    counts = {-0.5: 990, 2.0: 9, 4.0: 1}
    x = toxicity.chance_decay(counts, 0.5)
    total = sum(counts.values()) + 2
    mean = ((991 * math.exp(-0.5 * x)) + 9 * math.exp(2 * x) + 2 * math.exp(4 * x)) / total
    assert mean == pytest.approx(1, abs=1e-6)


def test_word_score_falls_back_to_beginnings():
    model = toxicity.Model({"vile": 5.0, "vil-": 3.0, "villa": None, "vill-": None})
    assert [model.word_score(w) for w in ("vile", "vilified", "villa", "village", "other", "vi")] == [5, 3, 0, 0, 0, 0]


def test_held_out_accuracy(spark, folder):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert {y for _, y in held} == {0, 1}


ROWS = [(i, f"fine day number {i} by the sea and the hills", 1) for i in range(60)]
ROWS += [(i, f"you rotten scoundrel go away number {i}", 2) for i in range(60, 90)]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(k == 2), 0) for i, _, k in ROWS], "doc_id long, toxic int, quality int")
    return docs, labels, toxicity.fit(docs, labels)


def test_passages_are_marked(spark, fitted):
    text = "a calm text about hills " * 30 + "you rotten scoundrel go away " + "and the sea again " * 30
    docs = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "rotten", 9)], "doc_id long, text string, score int")
    got = toxicity.score_texts(docs, fitted[2]).collect()
    assert got[0].score > 0.5 and "rotten scoundrel" in text[got[0].passages[0].start : got[0].passages[0].end]
    assert got[1].score == got[2].score == got[3].score < 0.5 and got[1].passages == []
    assert len(got) == 5


def test_held_out_rows_are_not_learned(spark, fitted):
    docs, labels, model = fitted
    changed = labels.withColumn("toxic", labels.toxic + 0).where("crc32(cast(doc_id as string)) % 5 != 0")
    assert toxicity.fit(docs, changed) == model


def test_without_labels(spark, fitted):
    docs, labels, _ = fitted
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        scored = toxicity.score_texts(docs, toxicity.fit(docs, few)).collect()
        assert len(scored) == len(ROWS) and all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.score_texts(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def plain_model(texts, labels, prior=0.05, certain=3.0, penalty=0.5, least=5):
    """Fitting by its definitions: dictionaries, a search for the root, and steps uphill. ``texts``, ``labels``: by id."""
    part = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    counting = {i for i in labels if part[i] not in (0, 1)}
    seen, toxic, clean = set(), Counter(), Counter()
    for i in sorted(counting):
        if (texts[i], labels[i]) not in seen:
            seen.add((texts[i], labels[i]))
            words = set(re.findall(r"\w+", texts[i].lower()))
            for w in words:
                for unit in [w, *(w[:n] + "-" for n in (6, 5, 4, 3) if len(w) >= n)]:
                    (toxic if labels[i] else clean)[unit] += 1
    units = {u for u in toxic | clean if toxic[u] + clean[u] >= least}
    total = [sum(c[u] for u in units if not u.endswith("-")) for c in (toxic, clean)]
    mass = prior * sum(total)
    delta, z = {}, {}
    for u in units:
        extra = prior * (toxic[u] + clean[u])
        odds = [math.log((c[u] + extra) / (t + mass - c[u] - extra)) for c, t in zip((toxic, clean), total)]
        delta[u] = odds[0] - odds[1]
        z[u] = delta[u] / math.sqrt(1 / (toxic[u] + extra) + 1 / (clean[u] + extra))
    good = {u: delta[u] for u in units if z[u] >= certain and delta[u] > 0}

    def word_score(w):
        for u in [w, *(w[:n] + "-" for n in (6, 5, 4, 3) if len(w) >= n)]:
            if u in good:
                return good[u]
            if u in units:
                return 0.0
        return 0.0

    histogram = Counter()
    for i in sorted(counting):
        if not labels[i]:
            histogram.update(round(s, 1) if (s := word_score(w)) > 0 else -penalty for w in re.findall(r"\w+", texts[i].lower()))
    histogram[max((s for s in histogram if s > 0), default=1.0)] += 1
    histogram[-penalty] += 1
    n = sum(histogram.values())
    low, high = 1e-6, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(k * math.exp(min(700, middle * s)) for s, k in histogram.items()) < n else (low, middle)

    def features(text):
        scores = [s if (s := word_score(w)) > 0 else -penalty for w in re.findall(r"\w+", text.lower())]
        excess = [high * v - math.log(0.1 * len(scores)) for _, _, v in by_definition(scores)]
        return min(max(excess, default=-10.0), 60.0), math.log1p(sum(x for x in excess if x >= -math.log(0.05)))

    rows = [(features(texts[i]), labels[i]) for i in sorted(labels) if part[i] == 1]
    columns = list(zip(*(f for f, _ in rows)))
    centre = [sum(c) / len(c) for c in columns]
    spread = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) or 1.0 for c, m in zip(columns, centre)]
    x = [[1.0, *((v - m) / s for v, m, s in zip(f, centre, spread))] for f, _ in rows]
    w, pull = [0.0] * 3, 0.01 * math.sqrt(len(rows))
    for _ in range(60_000):
        slope = [-pull * v if k else 0.0 for k, v in enumerate(w)]
        for r, (_, y) in zip(x, rows):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, r))))
            slope = [g + (y - p) * v for g, v in zip(slope, r)]
        w = [v + 0.02 * g for v, g in zip(w, slope)]
        if max(map(abs, slope)) < 1e-9:
            break

    def probability(text):
        f = features(text)
        return 1 / (1 + math.exp(-(w[0] + sum(a * (v - m) / s for a, v, m, s in zip(w[1:], f, centre, spread)))))

    return probability


def test_the_whole_score_by_its_definition(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    bad = ["vilest", "vilely", "grimly", "foulness"]
    texts, labels = {}, {}
    for i in range(400):
        said = rng.choices(words, k=rng.randint(5, 40))
        labels[i] = int(rng.random() < 0.4)
        if labels[i] or rng.random() < 0.05:
            at = rng.randrange(len(said))
            said[at:at] = rng.choices(bad, k=rng.randint(1, 4) if labels[i] else 1)
        texts[i] = " ".join(said)
    docs = spark.createDataFrame([*texts.items(), (1000, None), (1001, "")], "doc_id long, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, table)).collect()}
    plain = plain_model(texts, labels)
    assert {i for i in texts if abs(got[i] - plain(texts[i])) > 1e-4} == set()
    assert got[1000] == got[1001] == pytest.approx(plain(""), abs=1e-4)
    assert len({round(v, 6) for v in got.values()}) > 20
