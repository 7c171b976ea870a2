"""Evaluation tables of scored rows."""

from pyspark.sql import functions as F

from admitflow.operators import evaluate
from workload.registry import query


def _rounded(df, *columns, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in columns else c for c in df.columns))


@query(
    "confusion_matrix",
    """
    select count(*) filter (label = 0 and predicted = 0) as tn, count(*) filter (label = 0 and predicted = 1) as fp,
           count(*) filter (label = 1 and predicted = 0) as fn, count(*) filter (label = 1 and predicted = 1) as tp from scored""",
)
def confusion_matrix(t):
    return evaluate.confusion_matrix(t.scored, "label", "predicted")


@query(
    "classification_report",
    """
    with c as (
      select c::varchar as "class", count(*) filter (label = c) as support, count(*) filter (predicted = c) as chosen,
             count(*) filter (label = c and predicted = c) as hit from scored, (select unnest([0, 1]) as c) group by 1),
    r as (select "class", hit, case when chosen = 0 then 0 else hit / chosen end as p, case when support = 0 then 0 else hit / support end as r, support from c),
    f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1 from r)
    select "class", round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, support from f
    union all select 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::bigint from f
    union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support)::bigint from f
    union all select 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from f""",
)
def classification_report(t):
    return _rounded(evaluate.classification_report(t.scored, "label", "predicted"), "precision", "recall", "f1")



_CURVE = """
    with tally as (select score, sum(label)::bigint as pos, count(*) - sum(label)::bigint as neg from scored group by 1),
    run as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
                   sum(pos) over () as n_pos, sum(neg) over () as n_neg from tally)"""


@query(
    "roc_points",
    f"""
    {_CURVE}
    select round(score, 6) as threshold, round(fp / n_neg, 6) as fpr, round(tp / n_pos, 6) as tpr from run
    union all select 'infinity'::double, 0.0::double, 0.0::double""",
)
def roc_points(t):
    return _rounded(evaluate.roc_points(t.scored, "label", "score"), "threshold", "fpr", "tpr")


@query(
    "roc_auc",
    f"""
    {_CURVE}
    select round(sum((fpr - lag_fpr) * (tpr + lag_tpr) / 2), 6) as roc_auc, 0.5::double as no_skill from (
      select fpr, tpr, lag(fpr, 1, 0) over (order by score desc) as lag_fpr, lag(tpr, 1, 0) over (order by score desc) as lag_tpr
      from (select score, fp / n_neg as fpr, tp / n_pos as tpr from run))""",
)
def roc_auc(t):
    model = evaluate.roc_auc(t.scored, "label", "score").select(F.round("roc_auc", 6).alias("roc_auc"))
    flat = evaluate.roc_auc(t.scored.withColumn("score", F.lit(0.0)), "label", "score", name="no_skill")
    return model.withColumn("no_skill", flat.scalar())


@query(
    "pr_points",
    f"""
    {_CURVE}
    select round(score, 6) as threshold, round(tp / (tp + fp), 6) as precision, round(tp / n_pos, 6) as recall from run
    union all select null, 1.0::double, 0.0::double""",
)
def pr_points(t):
    return _rounded(evaluate.pr_points(t.scored, "label", "score"), "threshold", "precision", "recall")


@query(
    "pr_auc",
    f"""
    {_CURVE}
    select round(sum((recall - lag_r) * (p + lag_p) / 2), 6) as pr_auc from (
      select p, recall, lag(p, 1, 1) over (order by score desc) as lag_p, lag(recall, 1, 0) over (order by score desc) as lag_r
      from (select score, tp / (tp + fp) as p, tp / n_pos as recall from run))""",
)
def pr_auc(t):
    return _rounded(evaluate.pr_auc(t.scored, "label", "score"), "pr_auc")


@query(
    "roc_auc_by_group",
    """
    with tally as (select l_linenumber as line, l_extendedprice as score, sum((l_returnflag = 'R')::int) as pos, sum((l_returnflag <> 'R')::int) as neg
      from lineitem group by 1, 2),
    run as (select line, pos, neg, sum(pos) over w as tp, sum(pos) over (partition by line) as n_pos, sum(neg) over (partition by line) as n_neg
      from tally window w as (partition by line order by score desc))
    select line, round(sum(neg * (tp - pos + tp) / 2.0) / (max(n_pos)::double * max(n_neg)), 6) as roc_auc from run group by 1""",
)
def roc_auc_by_group(t):
    rows = t("lineitem").select(
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    return _rounded(evaluate.roc_auc(rows, "label", "score", ["line"]), "roc_auc")


@query(
    "binary_metrics",
    """
    select round((tp + tn) / n, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
           round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + fn) / n, 6) as no_skill from (
      select count(*) as n, count(*) filter (label = 0 and predicted = 0) as tn, count(*) filter (label = 0 and predicted = 1) as fp,
             count(*) filter (label = 1 and predicted = 0) as fn, count(*) filter (label = 1 and predicted = 1) as tp from scored)""",
)
def binary_metrics(t):
    out = evaluate.binary_metrics(t.scored, "label", "predicted")
    return _rounded(out, *out.columns)


@query(
    "multilabel_report",
    """
    select label_id, round((tp + tn) / n, 6) as accuracy, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
           round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall,
           round(case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1, tp + fn as support from (
      select label_id, count(*) as n, count(*) filter (y = 0 and p = 0) as tn, count(*) filter (y = 0 and p = 1) as fp,
             count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 1 and p = 1) as tp from (
        select 0 as label_id, (quality = 1)::int as y, (n_chars > 900)::int as p from labels join documents using (doc_id)
        union all select 1, (toxic = 1)::int, (n_chars % 2 = 0)::int from labels join documents using (doc_id)
        union all select 2, (quality = 1 and toxic = 0)::int, (lang = 'en')::int from labels join documents using (doc_id))
      group by 1)""",
)
def multilabel_report(t):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars", "lang"), "doc_id")
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    p = [F.col("n_chars") > 900, F.col("n_chars") % 2 == 0, F.col("lang") == "en"]
    arrays = rows.select(
        "doc_id",
        F.array(*(c.cast("int") for c in (q, x, q & ~x))).alias("y"),
        F.array(*(c.cast("int") for c in p)).alias("p"),
    )
    return _rounded(evaluate.multilabel_report(arrays, "y", "p", "doc_id"), "accuracy", "precision", "recall", "f1")
