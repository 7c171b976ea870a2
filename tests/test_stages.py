"""Stages across applications, and sessions whose configuration names no shared folder."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from admitflow.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

APPLICATION = """
import json, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
SparkSession.builder.config("spark.checkpoint.dir", {shared!r}).master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from admitflow.session import local_session
from admitflow.sources import tables
spark = local_session()
def build():
    rows = spark.read.parquet({source!r})
    return rows.where(F.col("k").isin(*range(40))).groupBy("k").agg(F.sum("v").alias({column!r}))
stage = tables.stage(spark, "sums", build, reuse=True)
print("GOT " + json.dumps([sorted(stage.inputFiles()), sorted(map(list, stage.collect()))]))
"""


def application(shared, source, column="total"):
    code = APPLICATION.format(root=ROOT, shared=str(shared), source=str(source), column=column)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180)
    line = next((x for x in out.stdout.splitlines() if x.startswith("GOT ")), None)
    assert line, out.stderr[-2000:]
    return json.loads(line[4:])


def test_a_second_application_reads_the_stage_until_a_file_changes(spark, tmp_path):
    source, shared = tmp_path / "rows", tmp_path / "shared"
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id", (F.col("id") * 2).alias("v"))
    rows.coalesce(1).write.parquet(str(source))
    first = application(shared, source)
    second = application(shared, source)
    assert first == second and len(first[1]) == 40
    assert application(shared, source, "other")[0] != first[0]
    rows.where("id < 5").coalesce(1).write.mode("append").parquet(str(source))
    changed = application(shared, source)
    assert changed[0] != first[0] and changed[1][1] == [1, first[1][1][1] + 2]
    manifests = list((shared / "admitflow" / "stages" / "sums").glob("*/*/sources"))
    assert sorted(spark.read.parquet(str(m)).count() for m in manifests) == [1, 1, 2]


def test_what_does_not_tell_its_rows_has_no_lasting_name(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3).write.parquet(path)
    read = spark.read.parquet(path)
    python = read.mapInArrow(lambda batches: batches, "id long")
    assert tables.lasting_fingerprint(spark.createDataFrame([(1,)], "id long")) is None
    assert tables.lasting_fingerprint(python) is None
    assert tables.lasting_fingerprint(python, "1") != tables.lasting_fingerprint(python, "2")
    one, two = read.where("id = 1"), read.where("id = 2")
    assert tables.lasting_fingerprint(one) == tables.lasting_fingerprint(read.where("id = 1")) != tables.lasting_fingerprint(two)
    assert [size > 0 for _, size, _ in tables.source_files(read)] == [True] * len(read.inputFiles())
    wide = [F.col("id").isin(*range(900, 900 + n)) for n in (150, 151)]
    assert tables.lasting_fingerprint(read.where(wide[0])) != tables.lasting_fingerprint(read.where(wide[1]))


def test_only_the_newest_stages_are_kept(spark):
    for n in (2, 3, 4):
        tables.stage(spark, "kept", lambda: spark.range(n), reuse=True)
    assert tables.forget_stages(spark, "kept", keep=1) == 2
    assert tables.forget_stages(spark, "kept") == 1
    assert tables.forget_stages(spark, "kept") == 0 == tables.forget_stages(spark, "never")


EMPTY_SETTINGS = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from admitflow.session import clear_run, cut_lineage, local_session, shared_dir
spark = local_session()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut_lineage(spark.range(3)).count() == 3 and shared_dir(spark) == shared_dir(spark)
print("GOT", __spark_entry__.entry(spark).count())
clear_run(spark)
"""


def test_an_empty_configuration_runs_the_feature_table(tmp_path):
    """A configuration folder of its own, so that no default names a shared folder."""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    out = subprocess.run([sys.executable, "-c", EMPTY_SETTINGS.format(root=ROOT)], capture_output=True, text=True, timeout=300, env=env)
    assert "GOT " in out.stdout and int(out.stdout.split("GOT ")[1].split()[0]) > 0, out.stderr[-2000:]


WITHOUT_LIBRARY = """
import sys
sys.path.insert(0, {root!r})
sys.modules["tiktoken"] = None
import __spark_entry__
print("GOT", len(__spark_entry__.queries()), sum(n.startswith("op") for n in __spark_entry__.queries()))
"""


def test_the_entry_survives_the_lack_of_an_optional_library():
    out = subprocess.run([sys.executable, "-c", WITHOUT_LIBRARY.format(root=ROOT)], capture_output=True, text=True, timeout=120)
    total, optional = map(int, out.stdout.split("GOT ")[1].split())
    assert total > 100 and optional == 0
