"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.session import ensure_checkpoint_dir

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch sent to Python, unless the session names a bound of its own.
BATCH_BYTES = 2 << 20
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def byte_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes (the same bound for every
    operator, so it does not matter which was built last), and let Python
    workers look for this package where the driver found it."""
    if spark.conf.get(BATCH_BYTES_CONF, None) is None:
        spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))
    package_path(spark)


def package_path(spark: SparkSession) -> None:
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), ROOT]))


_WORKER: dict = {}


def worker_cache(key, make):
    """make(), kept by this Python worker until another operator asks for its own.

    Workers live on from task to task; one operator's caches must not stay
    beside the next one's."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage at a table that every executor can read, so lost
    executors never force the work before it to be done again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns that are needed; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
