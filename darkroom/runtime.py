"""Session plumbing: the shared scratch folder, written intermediates, and shipping this package to workers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can see.

    It is ``spark.checkpoint.dir``. Only a local session without that setting (a test) gets a temporary folder; on a cluster a
    missing setting is an error, as other machines would not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_darkroom_scratch", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="darkroom-")
            spark.sparkContext._darkroom_scratch = found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/darkroom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path now; a missing path is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Lets Spark delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that run inside lose their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def many_files(spark: SparkSession, mean_bytes: float):
    """Jobs inside read many files of a mean size: paths are listed in as many tasks as a shuffle has (by default up to 10,000, of a path or a few each), small files share a task, and no code is generated for a file."""
    # by default a file counts as 4 MB more than it has, so 32 small ones fill a task; Spark's image reader makes a row encoder a file, which takes longer to generate than a small image to decode
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": shuffle_partitions(spark), "spark.sql.files.openCostInBytes": min(4 << 20, max(1 << 18, int(64 * mean_bytes))),
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage like a checkpoint, survives lost executors, keeps column pruning and
    filter push-down for later readers, and gives later plans a true size. The write's shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in written:
        drop_path(df.sparkSession, df.scratch)


def ship(spark: SparkSession) -> None:
    """Make this package importable on Python workers, once per context."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        # long texts: fewer rows a batch than the default, so that a batch stays at a few MB
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if getattr(sc, "_darkroom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="darkroom-"), "darkroom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(Path(_ROOT.name) / p.relative_to(_ROOT)))
    sc.addPyFile(target)
    sc._darkroom_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which the cluster sizes for its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
