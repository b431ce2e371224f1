"""Tables that a ``foreachBatch`` query writes batch by batch.

Every micro-batch writes its outputs into folders named by its batch id
(overwrite, so a repeated batch replaces its own output) and, last of all, one
row into ``commits``.  Readers take committed batches only: the outputs of a
batch become visible together, and a batch that was killed half way shows
nothing until it has been done again.

A keyed table keeps the latest values of each key as changes: a batch writes
the keys it changed, reading merges the changes (the latest batch wins), and
every ``COMPACT_EVERY`` batches the merged rows are written as a new base, from
which reading starts.  So a batch writes as much as it changes, and a read
opens one base and a bounded number of change folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMPACT_EVERY = 8
_COMMITS = "batch_id long, base long, seen_until long"


class BatchTables:
    """The tables below ``path``, as seen by batch ``before`` (None: a reader of all committed batches)."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        done = self._folder("commits", _COMMITS)
        if done is not None and before is not None:
            done = done.filter(F.col("batch_id") < before)
        # the largest batch id of one row per batch
        self.last: Row | None = None if done is None else done.orderBy(F.col("batch_id").desc()).first()

    def _folder(self, name: str, schema) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def write(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame | None:
        """Rows of all committed batches with their batch_id; None before the first commit."""
        if self.last is None:
            return None
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("batch_id") <= self.last.batch_id)

    def latest(self, name: str, keys: list[str]) -> DataFrame | None:
        """The keyed table: one row per key, the values of its latest batch."""
        rows = self.read(name)
        if rows is None:
            return None
        if self.last.base >= 0:
            base = self.spark.read.parquet(f"{self.path}/{name}_base").filter(F.col("batch_id") == self.last.base)
            rows = rows.filter(F.col("batch_id") > self.last.base).unionByName(base)
        values = [c for c in rows.columns if c not in (*keys, "batch_id")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")

    def commit(self, batch_id: int, seen_until: int | None = None, base: bool = False) -> None:
        """Makes the batch visible.  ``base``: it also wrote the keyed table's ``_base``."""
        before = self.last.base if self.last else -1
        row = [(batch_id, batch_id if base else before, seen_until)]
        self.write("commits", self.spark.createDataFrame(row, _COMMITS).drop("batch_id").coalesce(1), batch_id)

    def compacts(self, batch_id: int) -> bool:
        return batch_id % COMPACT_EVERY == COMPACT_EVERY - 1


def compact(tables: BatchTables, name: str, keys: list[str], batch_id: int, keep=None) -> None:
    """Writes the merged rows of a keyed table, this batch's changes included, as its base; ``keep`` may leave rows out."""
    old = tables.latest(name, keys)
    own = tables.spark.read.parquet(f"{tables.path}/{name}/batch_id={batch_id}")
    rows = own if old is None else own.unionByName(old.join(own.select(*keys), keys, "left_anti"))
    tables.write(f"{name}_base", rows if keep is None else rows.filter(keep), batch_id)
