"""Exact evaluation tables from scored rows (label 0/1, prediction, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.operators.totals import range_bucket, running_totals


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str, predicted: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp. With ``weight``, a row stands for that many rows."""
    y, p = F.col(label), F.col(predicted)
    n = F.col(weight) if weight else F.lit(1).cast("bigint")
    times = lambda of, hit: F.coalesce(F.sum(F.when((y == of) & (p == hit), n)), F.lit(0).cast("bigint"))
    return df.groupBy(*by).agg(times(0, 0).alias("tn"), times(0, 1).alias("fp"), times(1, 0).alias("fn"), times(1, 1).alias("tp"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support per class, then accuracy, macro and weighted rows.

    In single-label data the accuracy is also the micro F1.
    """
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # From here on there is one row per pair of classes.
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("chosen"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("chosen"),
                 F.lit(0).cast("bigint").alias("hit")),
    ))).select("col.*")
    per_class = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("chosen").alias("chosen"), F.sum("support").alias("support")
    )
    precision, recall = ratio(F.col("hit"), F.col("chosen")), ratio(F.col("hit"), F.col("support"))
    scored = per_class.select(
        "class", "hit", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "support",
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = scored.agg(F.lit("macro avg").alias("class"), *(F.avg(m).alias(m) for m in measures), total.alias("support"))
    weighted = scored.agg(
        F.lit("weighted avg").alias("class"),
        *(ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in measures),
        total.alias("support"),
    )
    share = ratio(F.sum("hit"), total)
    accuracy = scored.agg(F.lit("accuracy").alias("class"), *(share.alias(m) for m in measures), total.alias("support"))
    rows = scored.drop("hit")
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives at and above each distinct score, with class totals.

    The scored rows are read once, into counts per distinct score.
    """
    by = list(by)
    y = F.col(label)
    # + 0.0 makes -0.0 and 0.0 one score
    at = df.groupBy(*by, (F.col(score) + 0.0).alias("score")).agg(
        F.sum((y == 1).cast("bigint")).alias("pos"), F.sum((y == 0).cast("bigint")).alias("neg")
    )
    run = running_totals(range_bucket(at, "score", by), by, ["score"], ["pos", "neg"], bucket="_range", descending=True)
    return run.withColumnsRenamed({"pos_run": "tp", "neg_run": "fp", "pos_all": "n_pos", "neg_all": "n_neg"})


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One (threshold, fpr, tpr) per distinct score, highest first; ties share a point.

    The starting point (0, 0) has an infinite threshold.
    """
    by = list(by)
    at = _score_counts(df, label, score, by)
    points = at.select(
        *by, F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr")
    )
    groups = df.select(*by).distinct() if by else df.limit(1)
    start = groups.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), name: str = "roc_auc") -> DataFrame:
    """Area under the ROC curve: each score adds a trapezoid between its point and
    the one before. Null when a class is absent."""
    at = _score_counts(df, label, score, by)
    rise = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("tp")) / 2.0
    area = F.try_divide(F.sum(rise), F.max("n_pos").cast("double") * F.max("n_neg"))
    return at.groupBy(*by).agg(area.alias(name))


def pr_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (1, 0) with a null threshold."""
    by = list(by)
    at = _score_counts(df, label, score, by)
    points = at.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )
    groups = df.select(*by).distinct() if by else df.limit(1)
    end = groups.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def pr_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), name: str = "pr_auc") -> DataFrame:
    """Area under the precision-recall curve by trapezoids (not average precision).

    The point before a score's own is rebuilt from the running counts less the
    score's own counts, so no neighbour is looked up.
    """
    at = _score_counts(df, label, score, by)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    here = ratio(tp, tp + fp)
    ahead = tp - pos + fp - neg
    before = F.when(ahead == 0, 1.0).otherwise(ratio(tp - pos, ahead))
    area = F.sum(ratio(pos, F.col("n_pos")) * (here + before) / 2.0)
    return at.groupBy(*by).agg(area.alias(name))


def binary_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1, and the positive share (no-skill precision)."""
    m = confusion_matrix(df, label, predicted, by, weight)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return m.select(
        *by,
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fn, n).alias("no_skill"),
    )


def explode_labels(df: DataFrame, labels: str, predictions: str, key: str) -> DataFrame:
    """One row (key, label_id, y, p) per entry of the label and prediction arrays."""
    pairs = F.posexplode(F.arrays_zip(F.col(labels).alias("y"), F.col(predictions).alias("p")))
    return df.select(key, pairs.alias("label_id", "_z")).select(key, "label_id", "_z.y", "_z.p")


def multilabel_report(df: DataFrame, labels: str, predictions: str, key: str) -> DataFrame:
    """Metrics and support of each label. The rows, whose predictions may be a model's work, are read once."""
    cells = explode_labels(df, labels, predictions, key)
    pairs = cells.groupBy("label_id", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    # From here on there are a few rows per label.
    support = pairs.groupBy("label_id").agg(F.sum(F.col("y").cast("bigint") * F.col("n")).alias("support"))
    return binary_metrics(pairs, "y", "p", ["label_id"], "n").drop("no_skill").join(support, "label_id")


def rank_table(df: DataFrame, label: str, score: str, top: int | None = None) -> DataFrame:
    """Rank 1..n by falling score, ties by label; null scores last.

    With ``top``, only those rows meet. Without, rows are laid out by range of
    score and numbered from the totals of the ranges before.
    """
    if top is not None:
        order = Window.partitionBy(F.lit(1)).orderBy(F.desc(score), F.asc(label))
        return df.orderBy(F.desc(score), F.asc(label)).limit(top).withColumn("rank", F.row_number().over(order))
    down = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    placed = range_bucket(df.withColumns({"_down": down, "_one": F.lit(1)}), "_down")
    run = running_totals(placed, [], ["_down", label], ["_one"], bucket="_range")
    return run.select(*df.columns, F.col("_one_run").cast("int").alias("rank"))
