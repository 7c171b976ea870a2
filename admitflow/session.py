"""Session defaults, the package on the executors, and the shared folder used for stages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# Runtime settings every plan relies on. Shuffle width is left to the cluster:
# AQE merges small partitions and splits skewed ones. Arrow batches are kept
# short, since a row may hold a long text.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "200",
}
# Marks a session that is set up, and names its folder where spark.checkpoint.dir is not set.
TUNED, OWN_DIR = "spark.admitflow.tuned", "spark.admitflow.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Set this session up, once: the settings above (the time zone among them) and the package on the executors.

    Settings that the caller changes afterwards stay as the caller wants them.
    """
    if spark.conf.get(TUNED, None) is None:
        for name, value in RUNTIME_SETTINGS.items():
            spark.conf.set(name, value)
        ship(spark)
        spark.conf.set(TUNED, "true")
    return spark


def tune_tables(spark: SparkSession) -> SparkSession:
    """``tune``, for tables of narrow rows: partitions are merged up to 16 MB, unless the caller has set a size.

    A task holds such rows sorted or grouped in many times the bytes that are shuffled.
    """
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, "16m")
    return tune(spark)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, whose Python workers import them.

    The archive is built on the driver and served by Spark; executors need no
    copy of the package and no folder shared with the driver.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # already imported from an archive that Spark serves
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="admitflow-")), "admitflow_modules.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)


def local_session(app: str = "admitflow", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and timing runs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for stages (``spark.checkpoint.dir``).

    A machine-local folder is made only on a local master that names none; on
    a cluster, executors could not read one another's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="admitflow-")
    spark.conf.set(OWN_DIR, folder)  # Spark refuses to change its own setting in a running session
    return folder


def run_dir(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; two applications never meet in it."""
    return f"{shared_dir(spark)}/admitflow/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders directly inside one; none if it is absent."""
    if not exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().toString() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target) if s.isDirectory()]


def clear_run(spark: SparkSession) -> None:
    """Delete everything this application stored. Frames that read it cannot be used afterwards."""
    target = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as parquet and read it back with the schema it had."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Compute an intermediate once, into a new folder of the shared one.

    What is read from it afterwards does not go back to the source rows, and it
    survives the loss of executors. It is columnar, so later steps read only the
    columns they use. No folder is written twice, so no reader is disturbed.
    """
    return store(df, f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def together(*steps: Callable[[], T]) -> list[T]:
    """Run steps that do not need one another at the same time, so that the tasks of one fill the cores the others leave idle."""
    with ThreadPool(len(steps)) as pool:
        return pool.map(lambda step: step(), steps)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table scan over all cores, when it has fewer splits than cores.

    For work that is heavy per row, such as text cleaning, on a few files that
    cannot be split. A large input has more splits than cores and is left alone.
    Give it scans only: to count the splits of a plan with shuffles, Spark would
    run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
