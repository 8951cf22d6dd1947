"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on: AQE re-plans joins from measured
# shuffle sizes (runtime broadcast of small sides, skew splitting, partition
# coalescing) and Arrow carries the few pandas UDFs.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "tessera", driver_memory: str = "16g") -> SparkSession:
    """Session for tests and local runs. On a cluster, build the session
    from the cluster's own config and call :func:`checkpoint_dir` once."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, from
    ``spark.checkpoint.dir``.

    The cluster's setting always wins. Where it is unset a fresh local folder
    is registered, but only for a ``local`` master: elsewhere other machines
    could not read it, so that is an error."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a write in this block are removed when it has ended;
    without it they stay until the driver happens to collect its garbage, and
    the disk holds those of all steps before."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and
    continue from the written copy: the lineage is cut, later branches read
    only the columns they need instead of recomputing (e.g. a Python UDF),
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, f"table-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(table: DataFrame) -> None:
    """Remove the files of a table from ``materialize`` that nothing reads any
    more; a table of another kind is left alone."""
    path = getattr(table, "_written", None)
    if path:
        jvm = table.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def parts_of(spark: SparkSession, total: int | float | None, each: int) -> int:
    """Number of partitions of about ``each`` out of ``total``, at least one per
    core. Given to ``repartition`` it holds whatever the session's number of partitions is, and
    AQE does not merge them: a task's work stays the same as the table grows."""
    return max(spark.sparkContext.defaultParallelism, -(-int(total or 0) // each))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers when it is on the
    driver's path only (once per session). Local masters need it too: their
    workers are processes that do not see the driver's ``sys.path``."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-zip-"), "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._tessera_shipped = True
