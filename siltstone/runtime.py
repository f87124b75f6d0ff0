"""Session settings and the shared folder for cut lineage.

Every table that an operator writes between stages goes to the folder that the session
names in ``spark.checkpoint.dir``, which all executors share. Only where that setting is
absent and the master is local (tests, a laptop) a local folder is made and set; on a cluster that is an error, as
each executor would write to a disk of its own.

Such tables are needed until the result that reads them has been written. ``release`` deletes those of a session that
are left; ``drop`` deletes one that nothing reads any more.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables between stages; set by us only where the session names none."""
    named = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{SHARED} must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, made, True)
        named = "file://" + made
        spark.conf.set(SHARED, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run within delete their shuffles when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost
    executor costs no recomputation of what came before. The shuffles of the write are deleted with it: Spark else
    keeps them until the driver happens to collect its garbage, on a large table those of all stages."""
    path = new_path(df.sparkSession, name)
    with cleaning(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._written = path
    _written.append(path)
    return held


def drop(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``: nothing may read it any more."""
    if (path := getattr(df, "_written", None)) in _written:
        remove(df.sparkSession, path)
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all tables between stages of this process; results not yet written can't be computed afterwards."""
    while _written:
        remove(spark, _written.pop())


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for costly work on a table of few files. A table
    with enough files or splits stays as it is, and so does what a shuffle has spread: no shuffle is added at scale."""
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def wide(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in as many partitions as there are cores or shuffle partitions, before costly Python: small rows after
    an aggregate would else be coalesced into one task, though each costs much."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, cores_for_shuffle(df.sparkSession))
    return df.repartition(n, *by)


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path object) of Hadoop for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def cores_for_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
