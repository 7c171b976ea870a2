"""Training, scoring and encoding.

Fitted values depend on the trainer, so a query returns what SQL can state of
its result: the keys, labels and split of every scored row, the sizes of folds
and curves, and whether scores, metrics and codes are what they must be.
"""

from functools import partial

from pyspark.sql import functions as F

from admitflow.functions import vectors
from admitflow.operators import encode, evaluate, learn, neural, sampling
from admitflow.plans import baseline
from admitflow.presets import clinical
from admitflow.session import cut_lineage
from admitflow.sources import models
from admitflow.sources.tables import new_path
from workload.registry import query

SEED = 42
KEY = "o_orderkey"


def training_rows(t):
    """One row per order: line statistics, and whether a line was returned."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias(KEY)).agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_extendedprice").alias("price"),
        F.max("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.count_distinct("l_suppkey").cast("double").alias("suppliers"),
        F.max((F.col("l_linestatus") == "O").cast("double")).alias("open"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
    )
    return lines.join(t("orders").select(KEY, F.col("o_totalprice").alias("total")), KEY)


FEATURES = ["lines", "quantity", "price", "discount", "tax", "suppliers", "open", "total"]
# The study's forest; its 40 features a split are all of this frame's.
study_forest = partial(learn.forest, features="all", seed=SEED)
# Curves fit a forest for every point.
curve_forest = partial(learn.forest, trees=20, depth=8, features=3, seed=SEED)
EPOCHS = 170  # of the encoder


def _split(t):
    rows = sampling.split_stratified(cut_lineage(training_rows(t)), KEY, "y", SEED, 0.1)
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


_ROWS = "select l_orderkey as o_orderkey, max((l_returnflag = 'R')::int) as y, any_value(o_totalprice) as total from lineitem join orders on o_orderkey = l_orderkey group by 1"
_RANKED = f"select *, row_number() over (partition by y order by md5(o_orderkey::varchar || ':42')) - 1 as r, count(*) over (partition by y) as n from ({_ROWS})"
# Of the two classes, the quota of each in a test part of a tenth, by largest remainder.
_TEST = f"""
    with ranked as ({_RANKED}),
    exact as (select y, ceil(sum(n) over () * 0.1::double) as want, ceil(sum(n) over () * 0.1::double) * n / sum(n) over () as q from (select y, count(*) as n from ranked group by 1)),
    quota as (select y, floor(q) + (case when row_number() over (order by q - floor(q) desc, y) <= want - sum(floor(q)) over () then 1 else 0 end) as q from exact),
    test as (select o_orderkey, y from ranked join quota using (y) where r < q)"""
_SCORED = f"{_TEST} select o_orderkey, y::int as y, true as valid from test"


def checked(scored, *keys: str):
    """Keys and label of scored rows, and whether score and prediction are a probability and its class."""
    score, predicted = F.col("score"), F.col("prediction")
    fits = F.when(score > 0.5, predicted == 1).when(score < 0.5, predicted == 0).otherwise(predicted.isin(0, 1))
    return scored.select(*(keys or (KEY,)), "y", F.coalesce(score.between(0, 1) & fits, F.lit(False)).alias("valid"))


def _unit(*names: str):
    """Every one of the columns lies in [0, 1]."""
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce(F.col(name).between(0, 1), F.lit(False))
    return out


@query("model_roundtrip", f"select count(*) as n, 0::bigint as n_different from ({_ROWS})")
def model_roundtrip(t):
    """Scores of a reloaded model are those of the model."""
    rows = cut_lineage(training_rows(t))
    model = learn.fit(rows, FEATURES, study_forest())
    path = models.save_model(model, new_path(t.spark, f"{t.tag}_model"))
    one = learn.score(model, rows, KEY).select(KEY, F.col("score").alias("before"))
    two = learn.score(models.load_model(path), rows, KEY)
    return one.join(two, KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("score")).alias("n_different"))


@query("rf_train_score", _SCORED)
def rf_train_score(t):
    return checked(baseline.run(training_rows(t), KEY, "y", FEATURES, study_forest, SEED, folds=0).scored)


@query("gbt_train_score", _SCORED)
def gbt_train_score(t):
    train, test = _split(t)
    return checked(learn.score(learn.fit(train, FEATURES, learn.boosted(seed=SEED)), test, KEY))


@query("mlp_train_score", _SCORED)
def mlp_train_score(t):
    train, test = _split(t)
    return checked(learn.score(learn.fit(train, FEATURES, learn.perceptron(len(FEATURES), [128, 64], 10)), test, KEY))


@query(
    "multilabel_train_score",
    f"""
    select * from (
      select 0 as label_id, sum(y)::bigint as support, true as valid from ({_ROWS})
      union all select 1, sum((total > 250000)::int)::bigint, true from ({_ROWS}))""",
)
def multilabel_train_score(t):
    """Two labels, scored, thresholded and reported."""
    rows = cut_lineage(training_rows(t).withColumn("y2", (F.col("total") > 250000).cast("int")))
    features = [f for f in FEATURES if f != "total"]
    found = learn.fit_multilabel(rows, features, ["y", "y2"], lambda name: learn.perceptron(len(features), [128, 64], 10, label=name))
    scored = learn.score_multilabel(found, rows, KEY)
    cut = scored.withColumn("predictions", F.transform("scores", lambda s: vectors.at_least(s)))
    report = evaluate.multilabel_report(cut, "labels", "predictions", KEY)
    return report.select("label_id", "support", _unit("accuracy", "precision", "recall", "f1").alias("valid"))


_LAYOUTS = ", ".join(f"({i}, '{'-'.join(map(str, nodes))}')" for i, nodes in enumerate(clinical.LAYER_GRID))


@query("grid_sweep", f"select layout, count(*) as n, true as valid from (values {_LAYOUTS}) v(i, layout) group by 1")
def grid_sweep(t):
    """All fifteen layouts at full width."""
    train, test = _split(t)
    swept = learn.grid_sweep(train, test, FEATURES, KEY, clinical.LAYER_GRID, epochs=30)
    return swept.groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.bool_and(_unit(*learn.METRICS)).alias("valid"))


@query("cross_validate", "select unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) as metric, true as valid")
def cross_validate(t):
    rows = sampling.kfold_assign(training_rows(t), KEY, "y", SEED, 5)
    over = partial(sampling.oversample_minority, key=KEY, label="y", seed=SEED)
    folds = learn.cross_validate(rows, FEATURES, KEY, study_forest, 5, resample=over, parallelism=3)
    table = learn.summarize_folds(folds)
    return table.select("metric", (_unit("mean", "std") & (F.col("spread") == 2 * F.col("std"))).alias("valid"))


_FOLDS = f"select o_orderkey, (select count(*) from range(1, 3) k where r >= floor(n * k.range / 3))::int as fold from ({_RANKED})"


@query(
    "learning_curve",
    f"""
    with folds as ({_FOLDS})
    select f.fold, floor(share * n)::int as size, true as valid
    from (select k.range::int as fold, (select count(*) from folds where fold <> k.range) as n from range(0, 3) k) f,
         (select unnest([0.1::double, 0.325::double, 0.55::double, 0.775::double, 1.0::double]) as share)""",
)
def learning_curve(t):
    curve = learn.learning_curve(training_rows(t), FEATURES, KEY, curve_forest, SEED)
    return curve.select("fold", "size", _unit("train_score", "test_score").alias("valid"))


@query("validation_curve", "select v.range::varchar as value, f.range::int as fold, true as valid from range(2, 5, 2) v, range(0, 3) f")
def validation_curve(t):
    curve = learn.validation_curve(training_rows(t), FEATURES, KEY, lambda n: curve_forest(features=n), [2, 4], SEED)
    return curve.select("value", "fold", _unit("train_score", "test_score").alias("valid"))


@query("feature_importance", f"select unnest({FEATURES}) as label, true as shares_add_up")
def feature_importance(t):
    rows = cut_lineage(training_rows(t))
    table = cut_lineage(learn.feature_importance(learn.fit(rows, FEATURES, study_forest()), rows))
    total = table.agg(F.abs(F.sum("importance") - 1) < 1e-9).first()[0]
    return table.select("label", (F.lit(total) & F.col("rank").between(1, len(FEATURES))).alias("shares_add_up"))


@query("topk_retrain", _SCORED)
def topk_retrain(t):
    train, test = _split(t)
    model, _ = learn.topk_retrain(train, FEATURES, study_forest)
    return checked(learn.score(model, test, KEY))


def _unit_rows(t):
    """Embeddings moved into [0, 1]."""
    moved = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") + 0.5)))
    return t("embeddings").select("vec_id", "label", moved.alias("x"))


def _coded(df, width: int):
    """Whether a code has its width and finite entries."""
    finite = F.forall("encoded", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (finite & (F.size("encoded") == width)).alias("valid")


def loss_rows(t, losses, epochs: int, stop: float, good):
    """(epoch, valid): each epoch's loss is a loss, or training had ended below ``stop`` before; ``good`` is what must hold of them all."""
    history = t.spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses, 1)], "epoch int, loss double")
    ended = bool(losses) and losses[-1] < stop
    fits = F.when(F.col("loss").isNull(), F.lit(ended)).otherwise(F.col("loss").between(0, 10)) & F.lit(bool(good))
    return t.spark.range(1, epochs + 1).select(F.col("id").cast("int").alias("epoch")).join(history, "epoch", "left").select("epoch", fits.alias("valid"))


@query("fit_encoder", f"select range::int as epoch, true as valid from range(1, {EPOCHS} + 1)")
def fit_encoder(t):
    """The study's encoder (d, d/2, 256, 128) in 170 epochs of 512-row steps; its loss ends below that of the mean row."""
    rows = cut_lineage(_unit_rows(t), "unit-rows")
    model = encode.fit_autoencoder(rows, "vec_id", "x", encode.new_autoencoder(64), epochs=EPOCHS)
    mean = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    alone = mean.agg(F.avg(-F.col("m") * F.log("m") - (1 - F.col("m")) * F.log(1 - F.col("m")))).first()[0]
    return loss_rows(t, model.losses, EPOCHS, 0.005, model.losses[-1] < min(model.losses[0], alone + 0.01))


@query("encode_rows", "select vec_id, label, true as valid from embeddings")
def encode_rows(t):
    """Codes by an encoder that was fitted, stored and loaded."""
    rows = _unit_rows(t)
    model = encode.fit_autoencoder(rows, "vec_id", "x", encode.new_autoencoder(64), epochs=EPOCHS)
    model = models.load_encoder(t.spark, models.save_encoder(t.spark, model, new_path(t.spark, f"{t.tag}_encoder")))
    coded = encode.encode_rows(rows, "x", model, ["vec_id", "label"])
    return coded.select("vec_id", "label", _coded(coded, 128))


def _planted(t):
    """Embeddings whose label says on which side of a plane they lie, so a classifier's skill has a known bound."""
    e = F.col("embedding")
    side = (e[0] + e[1] - e[2]).cast("double") > 0
    return t("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 8).alias("x"), side.cast("int").alias("y"))


_PLANTED = "(select vec_id, (embedding[1] + embedding[2] - embedding[3] > 0)::int as y from embeddings)"
NET = neural.Training(epochs=30, batch=32, balance=True, replicas=4, seed=SEED)


@query("net_train_score", f"select vec_id, y, true as valid from {_PLANTED}")
def net_train_score(t):
    """The study's classifier (dropout, ELU, batch norm) with layers 128 and 64: every row's score."""
    rows = learn.net_frame(_planted(t), "x", "vec_id", ["y"])
    done = neural.train(rows, "vec_id", "x", "y", [learn.net_shape(64, [128, 64])], NET)
    return checked(learn.score_nets(done, rows, "vec_id").drop("net"), "vec_id")


@query("net_skill", "select true as loss_falls, true as beats_columns, true as separates")
def net_skill(t):
    """Held-out skill on a planted plane: a better AUC than any single column, and one near 1."""
    split = sampling.split_stratified(cut_lineage(_planted(t), "planted"), "vec_id", "y", SEED, 0.3)
    train, test = split.where("split = 'train'"), cut_lineage(split.where("split = 'test'"), "planted-test")
    shape = learn.net_shape(64, [128, 64], 0.25)
    done = neural.train(learn.net_frame(train, "x", "vec_id", ["y"]), "vec_id", "x", "y", [shape], NET)
    scored = learn.score_nets(done, learn.net_frame(test, "x", "vec_id", ["y"]), "vec_id")
    columns = test.select("y", F.posexplode("x").alias("column", "v"))
    single = evaluate.roc_auc(columns, "y", "v", ["column"]).agg(F.max(F.greatest("roc_auc", 1 - F.col("roc_auc")))).first()[0]
    auc = evaluate.roc_auc(scored, "y", "score").first()[0]
    found = (done.losses[0][-1] < done.losses[0][0], auc > single, auc > 0.85)
    return t.spark.createDataFrame([tuple(map(bool, found))], "loss_falls boolean, beats_columns boolean, separates boolean")


DROPOUTS = [0.0, 0.1, 0.25, 0.4, 0.5]
_GRID = ", ".join(f"('{'-'.join(map(str, nodes))}', {p}::double)" for nodes in clinical.LAYER_GRID for p in DROPOUTS)


@query("dropout_grid", f"select layout, dropout, true as valid from (values {_GRID}) v(layout, dropout)")
def dropout_grid(t):
    """All fifteen layouts at full width with each of five dropouts, side by side."""
    split = sampling.split_stratified(cut_lineage(_planted(t), "planted"), "vec_id", "y", SEED, 0.3)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    how = neural.Training(epochs=10, batch=128, balance=True, replicas=1, epochs_a_round=10, seed=SEED)
    swept = learn.net_sweep(train, test, "x", 64, "vec_id", clinical.LAYER_GRID, DROPOUTS, how, lanes=24)
    return swept.select("layout", "dropout", (_unit(*learn.METRICS) & F.col("loss").between(0, 10)).alias("valid"))


def label_skills(long):
    """(label_id, support, skilled) from (label_id, y, score): a loss below the share's entropy, and for label 0, the planted one, an AUC above 0.75."""
    p, share = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score"))), F.avg("y")
    loss, alone = -F.avg(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))), -(share * F.log(share) + (1 - share) * F.log(1 - share))
    found = long.groupBy("label_id").agg(F.sum("y").alias("support"), (loss < alone).alias("knows"))
    skill = evaluate.roc_auc(long, "y", "score", ["label_id"])
    skilled = F.col("knows") & ((F.col("label_id") != 0) | (F.col("roc_auc") > 0.75))
    return found.join(skill, "label_id").select("label_id", "support", skilled.alias("skilled"))


@query(
    "multilabel_net",
    f"""
    select 0 as label_id, sum(y)::bigint as support, true as skilled from {_PLANTED}
    union all select 1, sum((label < 5)::int)::bigint, true from embeddings
    union all select 2, sum(((label < 5) and y = 1)::int)::bigint, true from {_PLANTED} join embeddings using (vec_id)""",
)
def multilabel_net(t):
    """One net with three sigmoid outputs, as the study's multi-label classifier; on its own rows it knows more than each label's share.

    The second label has nothing to do with the vectors, so of many rows little of it can be known: what is asked of
    every label is a loss below its share's entropy, and of the planted one a high AUC too.
    """
    rows = _planted(t).join(t("embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("low")), "vec_id")
    rows = cut_lineage(rows.withColumn("both", F.col("low") * F.col("y")), "three-labels")
    frame = learn.net_frame(rows, "x", "vec_id", ["y", "low", "both"])
    done = neural.train(frame, "vec_id", "x", "y", [learn.net_shape(64, [128, 64], 0.1, 3)], neural.Training(epochs=30, batch=32, replicas=4, seed=SEED))
    scored = neural.score(done, frame, ["vec_id", "y"], "x")
    long = scored.select(F.posexplode(F.arrays_zip("y", "scores")).alias("label_id", "z")).select("label_id", F.col("z.y").cast("int").alias("y"), F.col("z.scores").alias("score"))
    long = cut_lineage(long, "three-scores")
    return label_skills(long)


@query(
    "label_chain",
    f"""
    select 0 as label_id, sum(y)::bigint as support, true as no_worse from ({_ROWS})
    union all select 1, sum((y = 1 and total > 150000)::int)::bigint, true from ({_ROWS})""",
)
def label_chain(t):
    """The second label holds only where the first does: the chain's model of it is no worse than one that does not see the first's score."""
    rows = training_rows(t).withColumn("y2", (F.col("y") * (F.col("total") > 150000).cast("int")))
    rows = cut_lineage(rows.drop("total"), "chain-rows")
    features, make = [f for f in FEATURES if f != "total"], lambda name: learn.forest(30, 6, "all", seed=SEED, label=name)
    chain = learn.fit_label_chain(rows, features, ["y", "y2"], KEY, make, SEED)
    alone = learn.fit_multilabel(rows, features, ["y", "y2"], make, parallelism=2)
    frames = {"chain": learn.score_label_chain(chain, rows, KEY), "alone": learn.score_multilabel(alone, rows, KEY)}
    parts = [f.select(F.lit(n).alias("how"), F.posexplode(F.arrays_zip("labels", "scores")).alias("label_id", "z")) for n, f in frames.items()]
    long = cut_lineage(sampling.union_rows(*parts).select("how", "label_id", F.col("z.labels").alias("y"), F.col("z.scores").alias("score")), "chain-scores")
    skill = evaluate.roc_auc(long, "y", "score", ["how", "label_id"])
    best = skill.groupBy("label_id").agg(F.max(F.when(F.col("how") == "chain", F.col("roc_auc"))).alias("c"), F.max(F.when(F.col("how") == "alone", F.col("roc_auc"))).alias("a"))
    counts = long.where("how = 'chain'").groupBy("label_id").agg(F.sum("y").cast("bigint").alias("support"))
    return counts.join(best, "label_id").select("label_id", "support", (F.col("c") > F.col("a") - 0.02).alias("no_worse"))


@query(
    "encode_pca",
    """
    select a.range::int as i, b.range::int as j, true as uncorrelated, a.range = b.range as own from range(0, 8) a, range(0, 8) b where a.range <= b.range""",
)
def encode_pca(t):
    """Principal components are uncorrelated, and ordered by variance: the covariance of every two of them."""
    rows = _unit_rows(t)
    coded = encode.encode_pca(encode.fit_pca(rows, "x", 8), rows, "x").select("encoded")
    pairs = [(i, j) for i in range(8) for j in range(i, 8)]
    found = coded.agg(*(F.covar_samp(F.col("encoded")[i], F.col("encoded")[j]).alias(f"c{i}_{j}") for i, j in pairs))
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("c"), F.col(f"c{max(i - 1, 0)}_{max(i - 1, 0)}").alias("before")) for i, j in pairs]
    own = F.col("i") == F.col("j")
    fits = F.when(own, (F.col("c") > 0) & (F.col("c") <= F.col("before"))).otherwise(F.abs("c") < 1e-9)
    return found.select(F.explode(F.array(*cells)).alias("x")).select("x.*").select("i", "j", fits.alias("uncorrelated"), own.alias("own"))


@query("roc_of_model", "select true as begins, true as ends, true as rises")
def roc_of_model(t):
    """The curve goes from (0, 0) to (1, 1) and never falls, and its area beats chance."""
    train, test = _split(t)
    scored = cut_lineage(learn.score(learn.fit(train, FEATURES, study_forest()), test, KEY))
    points = evaluate.roc_points(scored, "y", "score")
    ends = points.agg(
        F.bool_or((F.col("fpr") == 0) & (F.col("tpr") == 0)).alias("begins"), F.bool_or((F.col("fpr") == 1) & (F.col("tpr") == 1)).alias("ends")
    )
    return ends.crossJoin(evaluate.roc_auc(scored, "y", "score").select((F.col("roc_auc") > 0.5).alias("rises")))
