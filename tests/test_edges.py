"""Hand-made edge rows with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from admitflow.functions import recode, text, times, vectors
from admitflow.operators import encode, evaluate, events, joins, population, profile, reshape, sampling, scale
from admitflow.plans.features import recode_labs
from admitflow.presets import clinical
from admitflow.sources import matrix, models, tables

NTZ = "timestamp_ntz"
DAY0 = dt.datetime(2100, 1, 10)


def at(**delta):
    return DAY0 + dt.timedelta(**delta)


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def values(df, column=None):
    return [r[column or df.columns[0]] for r in df.collect()]


def test_elapsed_hours(spark):
    rows = [(DAY0, at(hours=24)), (DAY0, at(hours=24, minutes=59)), (DAY0, at(hours=25)), (DAY0, None)]
    df = spark.createDataFrame(rows, f"admittime {NTZ}, charttime {NTZ}")
    assert values(population.after_window(df, 24), "time_to_rslt") == [25]


def test_population_window(spark):
    ends = [None, at(hours=24), at(hours=24, seconds=1)]
    df = spark.createDataFrame([(1, i, DAY0, None, e) for i, e in enumerate(ends)], f"subject_id long, hadm_id long, admittime {NTZ}, dischtime {NTZ}, deathtime {NTZ}")
    assert values(population.still_admitted(df, 24), "hadm_id") == [0, 2]
    assert values(population.still_admitted(df, 24, closed=False), "hadm_id") == [0, 1, 2]


@pytest.mark.parametrize("join", [joins.lookback_events, joins.events_in_lookback])
def test_lookback(spark, join):
    moments = {0: at(days=-7, hours=-23), 1: at(days=-8), 2: at(hours=24), 3: at(hours=24, seconds=1), 4: at(days=-3)}
    labs = spark.createDataFrame([(9, i, m) for i, m in moments.items()], f"subject_id long, id long, charttime {NTZ}")
    pop = spark.createDataFrame([(9, at(hours=24), DAY0), (8, at(hours=24), DAY0)], f"subject_id long, index_date {NTZ}, admittime {NTZ}")
    assert sorted(values(join(labs, pop), "id")) == [0, 2, 4]


def test_first_event_hours_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1, DAY0, at(minutes=-30)), (2, DAY0, at(minutes=-90)), (3, DAY0, at(minutes=90))], f"k long, a {NTZ}, t {NTZ}")
    assert {r.k: r.hours for r in events.first_event_hours(df, ["k"], "a", "t").collect()} == {1: 0, 2: -1, 3: 1}


def test_previous_admissions(spark):
    moments = {1: DAY0, 2: at(days=-360), 3: at(days=-361), 4: DAY0, 5: at(days=-1)}
    df = spark.createDataFrame([(9, i, m) for i, m in moments.items()], f"subject_id long, hadm_id long, admittime {NTZ}")
    pop = df.where("hadm_id = 1").select("hadm_id")
    assert sorted(values(joins.previous_admissions(df, pop), "prev_hadm_id")) == [2, 5]
    counts = {r.hadm_id: r.n_admits for r in events.count_before(df).collect()}
    assert counts == {1: 2, 4: 2, 5: 2, 2: 1}


def test_keep_last_and_first_break_ties(spark):
    df = spark.createDataFrame([(1, 5, DAY0, "a"), (1, 5, DAY0, "b"), (1, 5, at(days=-1), "c"), (1, 6, DAY0, "d")], f"k long, item long, charttime {NTZ}, v string")
    assert sorted(values(events.keep_last(df, ["k", "item"], tiebreak=["v"]), "v")) == ["b", "d"]
    assert sorted(values(events.keep_first(df, ["k", "item"], tiebreak=["v"]), "v")) == ["c", "d"]


def test_recodes(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert values(df.select(recode.recode_closed("v", {"a": "x"}))) == ["x", None, None]
    assert values(df.select(recode.recode_open("v", {"x": ["a"]}))) == ["x", "b", None]
    assert values(df.select(recode.recode_open("v", {None: ["a"]}))) == [None, "b", None]
    languages = spark.createDataFrame([("ENGL",), ("XX",), (None,)], "v string")
    assert values(languages.select(recode.keep_listed("v", clinical.LANGUAGES))) == ["ENGL", "OTHER", "OTHER"]


LAB_CASES = [
    ("51508", "YELLOW", None), ("51508", "PINK", "Pink"), ("51508", "None", "NONE"), ("51501", "<1", "0-2"),
    ("51501", "4", "3-5"), ("51463", "0", None), ("51463", " ", "NONE"), ("51463", "2.0", "FEW"), ("51492", " ", None),
    ("51492", ">300", "500.0"), ("51492", "15", None), ("51003", "<0.01", "0.001"), ("51003", "ERROR", None),
    ("51003", ">500", "600.0"), ("51003", "7.5", "7.5"), ("51514", ">8", ">8.0"), ("51476", "<1 /HPF", "0.5"),
    ("51493", ">50", "80.0"), ("51493", "TNTC", None), ("50922", "NEG", "-1.0"), ("50924", "> 2000", "5900.0"),
    ("50868", "12", "12"),
]


def test_lab_recodes(spark):
    df = spark.createDataFrame([(c, v) for c, v, _ in LAB_CASES], "code string, value string").coalesce(1)
    got = values(df.select(recode_labs("code", "value", clinical.LAB_RECODES)))
    assert got == [want for _, _, want in LAB_CASES]


def test_flags(spark):
    df = spark.createDataFrame([("abnormal",), ("delta",), (None,), ("zzz",)], "f string").coalesce(1)
    assert values(df.select(recode.flag_code("f"))) == [1, 1, -1, 0]
    labs = spark.createDataFrame([(1, 7, "delta"), (1, 8, None), (2, 7, "zzz")], "k long, code long, flag string")
    wide = reshape.pivot_flags(labs, "k", "code", recode.flag_code("flag"), [7, 8]).orderBy("k")
    assert [tuple(r) for r in wide.collect()] == [(1, 1, -1), (2, 0, 0)]


@pytest.mark.parametrize(
    "raw, want",
    [("1", 1.0), (" 1 ", 1.0), ("1e3", 1000.0), ("1.0d", None), ("1f", None), ("<1", None), ("", None), ("nan", None),
     ("-.5", -0.5), ("5.", 5.0), ("inf", math.inf), (None, None)],
)
def test_to_number(spark, raw, want):
    assert values(one(spark, raw).select(recode.to_number("v"))) == [want]


def test_strip_charset(spark):
    steps = [("left", "LESS THAN ")]
    df = spark.createDataFrame([("LESS THAN 0.1",), ("ALBUMIN",)], "v string").coalesce(1)
    assert values(df.select(text.strip_charsets("v", steps))) == ["0.1", "BUMIN"]
    df = one(spark, ">GREATER THAN 1,5 NG/ML")
    assert values(df.select(text.measurement_text("v", clinical.MEASUREMENT_STRIPS))) == ["1.5"]


@pytest.mark.parametrize(
    "raw",
    ["RT @Joe2 hi!", "a\nb", "see https://x.y/z now", "http", "httpsx", "x1y22", "@@abc d", "caf\u00e9 \U0001f600 5",
     "rt http@abc", "a_b://c d", "1@2 3", "http\nx", "rtrt", "rt @", "x\u00e9y://z q", "tab\tnew\r\nline", "[a]{b}`~^\\"],
)
def test_clean_text(spark, raw):
    import re

    want = re.sub(r"\d+", "", re.sub(text.NOISE_PATTERN, "", raw.lower()))
    assert values(one(spark, raw).select(text.clean_text("v"))) == [want]


def test_clean_text_by_hand(spark):
    assert values(one(spark, "RT @Joe2 hi! 24 https://x.y/z ok").select(text.clean_text("v"))) == ["  hi   ok"]


def test_bins(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 8)] + [("a", None)] + [("b", 3.0)] * 3, "code string, x double")
    got = scale.bin_equal_width(df, "x", ["code"]).collect()
    assert sorted(r.x for r in got if r.code == "a") == ["0", "0", "0", "1", "2", "3", "4", "5"]
    assert {r.x for r in got if r.code == "b"} == {"0"}


def test_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 4.0), ("b", 4.0)], "code string, x double")
    spread = {r.code: (r.low, r.median, r.high) for r in scale.fit_spread(df, "x", ["code"], 0.01, 0.99).collect()}
    assert spread["a"] == pytest.approx((1.03, 2.5, 9.79))
    got = {(r.code, r.x) for r in scale.scale_p1_p99(df, "x", ["code"]).collect()}
    assert ("b", None) in got
    assert max(x for c, x in got if c == "a") == pytest.approx((1 - 2.5) / (1.03 - 9.79))


def test_impute(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 5.0)], "code string, x double")
    assert sorted(values(scale.impute_median(df, "x", ["code"]), "x")) == [1.0, 3.0, 5.0]


def test_dummies(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, a string")
    wide = reshape.get_dummies(df, reshape.fit_levels(df, ["a"])).orderBy("k")
    assert wide.columns == ["k", "a_y", "a_nan"]
    assert [tuple(r) for r in wide.collect()] == [(1, 0, 0), (2, 1, 0), (3, 0, 1)]


def test_code_kinds(spark):
    rows = [("a", 100, 4, 10), ("b", 100, 5, 10), ("c", 100, 6, 99), ("d", 100, 6, 100), ("e", 0, 0, 0)]
    df = spark.createDataFrame(rows, "code string, n_present long, n_bad long, n_unique long")
    assert {r.code: r.kind for r in profile.code_kinds(df).collect()} == {
        "a": "numeric", "b": "weird", "c": "categorical", "d": "weird", "e": "weird",
    }


def test_sparse(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4)], "code string, n_present long")
    assert values(profile.dense_codes(df, 100, 0.95), "code") == ["a"]


def test_ratio_sample(spark):
    def sizes(positives):
        df = spark.range(100).select(F.col("id"), (F.col("id") < positives).cast("int").alias("y"))
        out = sampling.ratio_sample(df, "id", "y", 1, 3.0)
        assert out.select("y", "draw").distinct().count() == out.count()
        return {r.y: r["count"] for r in out.groupBy("y").count().collect()}

    assert sizes(10) == {1: 10, 0: 30}
    assert sizes(90) == {1: 25, 0: 75}


def test_roc_ties_and_constant(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.875)
    points = {(r.threshold, r.fpr, r.tpr) for r in evaluate.roc_points(df, "y", "s").collect()}
    assert points == {(math.inf, 0, 0), (0.9, 0, 0.5), (0.5, 0.5, 1), (0.1, 1, 1)}
    assert evaluate.roc_auc(df.withColumn("s", F.lit(0.0)), "y", "s").first()[0] == 0.5
    assert evaluate.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_report_without_predictions_of_a_class(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    rows = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rows["1"].precision == 0 and rows["1"].recall == 0 and rows["1"].f1 == 0 and rows["1"].support == 1
    assert rows["0"].recall == 1 and rows["accuracy"].f1 == 0.5 and rows["macro avg"].support == 2


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 5.0, 3.0, 2.0],)], "a array<double>")
    row = df.select(vectors.argmax("a").alias("i"), vectors.tail_max("a", 2).alias("t"), vectors.upper_half_max("a").alias("u")).first()
    assert tuple(row) == (1, 3.0, 3.0)
    flipped = df.select(vectors.flip_noise(F.transform("a", lambda x: x / 10), F.lit(1), 0.0, 3).alias("f")).first().f
    assert flipped == pytest.approx([0.9, 0.5, 0.7, 0.8])


def test_matrix(spark):
    df = spark.createDataFrame([(7, 1, 2.0, 3.0)], "k long, y int, a double, b double")
    rows = matrix.to_matrix(df, "k", "y")
    assert matrix.num_features(rows) == 2
    got = matrix.split_xy(rows).first()
    assert (got.x, got.y) == ([2.0, 3.0], 1.0)
    assert matrix.to_matrix(df.drop("y"), "k").first().row == [2.0, 3.0, 0.0]


def test_autoencoder_learns(spark):
    rows = spark.range(60).select("id", F.array(*((F.col("id") % (i + 2) == 0).cast("double") for i in range(6))).alias("x"))
    model = encode.fit_autoencoder(rows, "id", "x", encode.new_autoencoder(6, (5,), 3), epochs=40, rate=0.05, keep=None)
    assert model.losses[-1] < 0.7 * model.losses[0]
    coded = encode.encode_rows(rows, "x", model, ["id"])
    assert coded.count() == 60 and len(coded.first().encoded) == 3


def test_whole_years_before_birthday(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 6, 1), dt.datetime(2020, 5, 31))], f"b {NTZ}, t {NTZ}")
    assert values(df.select(times.whole_years("b", "t"))) == [19]


def test_whole_years_of_a_leap_day(spark):
    """As DuckDB's date_sub: the year is full on February 28 of a common year, at the hour of birth, in either direction."""
    at = dt.datetime
    rows = [
        (at(1948, 2, 29), at(1995, 2, 28), 47), (at(1948, 2, 29), at(1995, 2, 27), 46), (at(1948, 2, 29), at(1996, 2, 28), 47), (at(1948, 2, 29), at(1996, 2, 29), 48),
        (at(1948, 2, 29, 12), at(1995, 2, 28, 10), 46), (at(1995, 2, 28), at(1992, 2, 29), -3), (at(1995, 2, 28), at(1996, 2, 28), 1), (None, at(1996, 2, 28), None),
    ]
    df = spark.createDataFrame(rows, f"b {NTZ}, t {NTZ}, n bigint")
    assert [tuple(r) for r in df.select(times.whole_years("b", "t"), "n").collect()] == [(n, n) for *_, n in rows]


def unit_rows(spark, n=40):
    cells = F.array(*(F.pmod(F.hash("id", F.lit(i)), F.lit(100)) / 100 for i in range(6)))
    return spark.range(n).select("id", cells.alias("x"))


def test_encoder_does_not_depend_on_partitions(spark):
    start = encode.new_autoencoder(6, (5,), 3)
    losses = [encode.fit_autoencoder(unit_rows(spark).repartition(n), "id", "x", start, epochs=3).losses for n in (1, 4)]
    assert losses[0] == pytest.approx(losses[1], abs=1e-12)


def test_encoder_without_rows(spark):
    start = encode.new_autoencoder(6, (5,), 3)
    model = encode.fit_autoencoder(unit_rows(spark, 0), "id", "x", start, epochs=3)
    assert model.losses == [] and all((a[0] == b[0]).all() for a, b in zip(model.weights, start.weights))


def test_encoder_is_stored(spark):
    model = encode.fit_autoencoder(unit_rows(spark), "id", "x", encode.new_autoencoder(6, (5,), 3), epochs=2)
    back = models.load_encoder(spark, models.save_encoder(spark, model, tables.new_path(spark, "encoder")))
    assert back.widths == model.widths and back.losses == model.losses
    codes = [{r.id: r.encoded for r in encode.encode_rows(unit_rows(spark), "x", m, ["id"]).collect()} for m in (model, back)]
    assert codes[0] == codes[1]


def test_narrow_pivot_is_a_pivot(spark, monkeypatch):
    rows = [(1, "a", 1.0), (1, "b.c", None), (2, "a", float("nan")), (2, None, 5.0), (None, "a", 7.0), (3, "other", 8.0), (3, "b.c", -1.0)]
    long, codes = spark.createDataFrame(rows, "k int, code string, v double"), ["a", "b.c", "absent"]
    narrow = reshape.pivot_values(long, "k", "code", "v", codes)
    monkeypatch.setattr(reshape, "NARROW", 0)
    wide = reshape.pivot_values(long, "k", "code", "v", codes)
    assert narrow.schema == wide.schema and "pivotfirst" in wide._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))


def test_sampling_keeps_dotted_names(spark):
    df = spark.range(40).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), F.col("id").alias("4_19.0"))
    for out in (sampling.oversample_minority(df, "id", "y", 1), sampling.undersample_majority(df, "id", "y", 1)):
        assert set(out.columns) >= {"id", "y", "4_19.0"} and out.where("id != `4_19.0`").count() == 0
    assert sampling.oversample_minority(df, "id", "y", 1).count() == 60
