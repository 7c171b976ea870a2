"""Tables in, stages out: parquet, CSV, views and reusable stages."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from admitflow.session import children, exists, run_dir, shared_dir, store


def read_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet path (with a slash) or a catalog table, read with a column projection."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The schema is given, so the file is read once and types are not guessed."""
    return spark.read.schema(schema).option("header", True).csv(path)


def register_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing else writes to."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fingerprint(df: DataFrame) -> str:
    """Names what a frame computes: its plan (with sources and constants) and its columns. Holds within one application."""
    return hashlib.sha256(f"{df.semanticHash()} {df.schema.json()}".encode()).hexdigest()[:24]


# Leaves of a plan that say all there is to know of their rows: files (whose
# manifest is compared) and ranges of numbers.
_KNOWN_LEAVES = {"LogicalRelation", "Range", "OneRowRelation"}


def lasting_fingerprint(df: DataFrame, version: str | None = None) -> str | None:
    """As ``fingerprint``, but the same in every application; None if the plan does not tell all that makes the rows.

    That is so if rows come from the driver or from a source that is no file, and,
    unless ``version`` names their code, if the plan calls Python functions.
    """
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    leaves = plan.collectLeaves().iterator()
    while leaves.hasNext():
        if leaves.next().getClass().getSimpleName() not in _KNOWN_LEAVES:
            return None
    most = "spark.sql.debug.maxToStringFields"
    before = df.sparkSession.conf.get(most)
    df.sparkSession.conf.set(most, str(2**31 - 1))
    try:
        text = plan.toString()
    finally:
        df.sparkSession.conf.set(most, before)
    if version is None and re.search(r"Python|Pandas|Arrow", text):
        return None
    settings = [df.sparkSession.conf.get(name) for name in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")]
    return hashlib.sha256(json.dumps([text, df.schema.json(), version, settings]).encode()).hexdigest()[:24]


def source_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of every file the frame reads, in order; each folder is listed once."""
    spark, found = df.sparkSession, []
    wanted: dict[str, set[str]] = {}
    for path in df.inputFiles():
        folder, _, name = unquote(path).rpartition("/")
        wanted.setdefault(folder, set()).add(name)
    for folder, names in wanted.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for status in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target):
            if status.getPath().getName() in names:
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def stage(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], reuse: bool = False, version: str | None = None
) -> DataFrame:
    """Write a stage to the shared folder and read it back, which also cuts its lineage.

    Without ``reuse`` each run writes a folder of its own, so frames that still
    read an earlier one are not disturbed. With it, a complete stage of the same
    name is read instead, this application's or an earlier one's, if it was made
    by the same plan from the same files: a manifest of the source files (path,
    bytes, modification time) is stored beside the stage, and its digest is part
    of the stage's folder, so a changed, added or lost file makes another stage.
    A stage without the writer's ``_SUCCESS`` mark is not used. Where a plan does
    not tell all that makes its rows (``lasting_fingerprint``), the stage is
    reused within the application only. ``version`` names the code of Python
    functions in the plan; change it when they change.
    """
    df = build()
    if not reuse:
        return store(df, new_path(spark, name))
    plan = lasting_fingerprint(df, version)
    if plan is None:
        done = f"{run_dir(spark)}/{name}-{fingerprint(df)}"
        if exists(spark, f"{done}/_SUCCESS"):
            return spark.read.schema(df.schema).parquet(done)
        return store(df, new_path(spark, name) if exists(spark, done) else done)
    files = source_files(df)
    made_of = hashlib.sha256(json.dumps(files).encode()).hexdigest()[:24]
    home = f"{shared_dir(spark)}/admitflow/stages/{name}/{plan}-{made_of}"
    complete = [part for part in children(spark, home) if exists(spark, f"{part}/rows/_SUCCESS")]
    if complete:
        return spark.read.schema(df.schema).parquet(f"{min(complete)}/rows")
    # Two applications that build the same stage at once write apart; either copy will do.
    own = f"{home}/{uuid.uuid4().hex}"
    spark.createDataFrame(files, "path string, bytes long, modified long").write.parquet(f"{own}/sources")
    return store(df, f"{own}/rows")


def forget_stages(spark: SparkSession, name: str, keep: int = 0) -> int:
    """Delete all but the newest ``keep`` stages of that name; returns how many went. Frames that read them cannot be used afterwards."""
    home = f"{shared_dir(spark)}/admitflow/stages/{name}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    status = lambda path: fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).getModificationTime()
    old = sorted(children(spark, home), key=status, reverse=True)[keep:]
    for path in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return len(old)
