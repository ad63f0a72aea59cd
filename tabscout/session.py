"""Session helpers: building a session and finding the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_MANY_ROWS = 1_000_000


def get_spark(app_name: str = "tabscout", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; extra settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Learners that are fitted side by side share the cores.
        "spark.scheduler.mode": "FAIR",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder is only acceptable when driver and executors are one
    process, so outside local mode an unset folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tabscout-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it with its lineage cut.

    Unlike a cache, the files outlive a lost executor; unlike a checkpoint, they are
    computed once and read by column.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold_for_iteration(df: DataFrame) -> DataFrame:
    """Persist rows that many passes will read.

    Iterative learners run one task per partition and pass, so many rows that came
    in fewer partitions than there are cores are spread out first. Few rows gain
    nothing, and large inputs have partitions enough; neither is shuffled. The
    caller unpersists the result.
    """
    held = df.persist()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if held.count() < _MANY_ROWS or held.rdd.getNumPartitions() >= cores:
        return held
    spread = held.repartition(cores).persist()
    spread.count()
    held.unpersist()
    return spread


def side_by_side(spark: SparkSession, pool: ThreadPool, run: Callable, items: Sequence) -> list:
    """``run`` of each item in the pool's threads, results in order.

    Wrapped one by one: a wrapper hands the same local properties to every thread that calls it, and
    there one thread's query clears what another's is just about to read.
    """
    runs = [inheritable_thread_target(spark)(partial(run, item)) for item in items]
    return pool.map(lambda go: go(), runs, chunksize=1)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once: the checkout need not be installed there.

    Neither need it be on the path of local workers, which do not see what the driver's program
    puts on its own path.
    """
    context = spark.sparkContext
    # One thread at a time: a cluster takes a file name from one path only.
    with _SHIPPING:
        if context.applicationId in _SHIPPED:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="tabscout-"), "tabscout"), "zip",
            os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
