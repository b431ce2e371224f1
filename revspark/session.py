"""Spark session and checkpoint-directory helpers.

On a cluster the session is created by the platform; we only read its
settings.  ``get_spark`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    master = master or os.environ.get("REVSPARK_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName("revspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REVSPARK_DRIVER_MEM", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins.  Only when it is unset and Spark runs on this
    machine alone (tests, local runs) a fresh scratch folder is created and
    registered; on a cluster without the setting this raises.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="revspark-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def cut_lineage(df):
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage at a table that every executor can read; a later step
    reads only the columns it uses.  One pass over the plan, nothing cached."""
    spark = df.sparkSession
    path = scratch_table_dir(spark, uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: How a table of ``cut_by`` is read: rows of one key are known to be in one partition, in their written order, and a
#: table that is not yet dealt out by that key is moved to it, not both.
_BY_KEY = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def cut_by(df, keys: list[str], partitions: int, order: tuple[str, ...] = ()):
    """``cut_lineage`` for a table that is joined and grouped by ``keys`` (and more columns): a bucket for each partition.

    Spark knows of the read table that rows of equal keys are together, so a join, group or window by them moves nothing;
    with ``order`` each partition is also sorted by (keys, order).  The catalog's entry is dropped, the files stay."""
    spark = df.sparkSession
    for name, value in _BY_KEY.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    name = f"cut_{uuid.uuid4().hex}"
    out = df.repartition(partitions, *keys).write.bucketBy(partitions, *keys)
    out = out.sortBy(*keys, *order) if order else out
    out.option("path", scratch_table_dir(spark, name)).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


#: Tables that are planned and written at a time: while one is planned, the executors work on the other.
AT_ONCE = 2


def together(fns, at_once: int = AT_ONCE) -> list:
    """What the functions return, in their order; ``at_once`` of them run at a time, with the job group of the calling thread."""
    with ThreadPoolExecutor(at_once) as pool:
        inherit = inheritable_thread_target(SparkSession.active())
        return [x.result() for x in [pool.submit(inherit(fn)) for fn in fns]]


def written_together(makers, at_once: int = AT_ONCE):
    """The rows of all tables that ``makers`` (functions, at least one) make, of the same columns, as one written table.

    Each table is a job of its own, ``at_once`` of them at a time, so the driver holds the plans, the stages and the tasks of
    so many, not those of their union.  Each has a folder of its own: jobs that write one folder together clean up each other's files."""
    def write(make) -> tuple[str, DataFrame]:
        df = make()
        path = scratch_table_dir(df.sparkSession, uuid.uuid4().hex)
        df.write.option("compression", "zstd").parquet(path)
        return path, df

    paths, frames = zip(*together([partial(write, make) for make in makers], at_once))
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*paths)
