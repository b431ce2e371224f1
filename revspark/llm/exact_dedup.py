"""Exact deduplication by content sort (operator 8).

Texts are equal when identical after white space is deleted.  The normalised
bytes are dealt out by range (Spark samples the splitters), sorted externally
inside each range, and neighbours are compared in full.  The digest and the
row's rank follow the content in the range key, so a text with very many
copies is cut into several consecutive ranges instead of landing in one task;
the runs that touch a range's edge (two per range at most) are then joined up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches, id_text, stored

#: Deleted before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"
#: Leading bytes of the normalised text in the range key.  Bounds the sampled
#: splitters; the digest after them separates texts that share this prefix.
KEY_BYTES = 64

_RUNS = "doc_id long, n_cp int, sha string, pid int, run long, first boolean, n long, best_cp int, best_id long, edge boolean"
_RUNS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_cp", pa.int32()), ("sha", pa.string()), ("pid", pa.int32()), ("run", pa.int64()),
    ("first", pa.bool_()), ("n", pa.int64()), ("best_cp", pa.int32()), ("best_id", pa.int64()), ("edge", pa.bool_()),
])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted range; the first row of a run is its best."""
    ctx = TaskContext.get()
    pid = ctx.partitionId() if ctx else 0
    run, last, sha, ids, cps = -1, None, "", [], []
    out: list[tuple] = []

    def close(edge: bool) -> None:
        out.extend((i, c, sha, pid, run, k == 0, len(ids), cps[0], ids[0], edge) for k, (i, c) in enumerate(zip(ids, cps)))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[] for _ in _RUNS_ARROW]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUNS_ARROW)], schema=_RUNS_ARROW)

    for b in batches:
        norms, docs, n_cps, shas = (b.column(i) for i in range(4))
        docs, n_cps = docs.to_pylist(), n_cps.to_pylist()
        for k, norm in enumerate(norms.to_pylist()):
            if norm != last:
                if ids:
                    close(run == 0)
                run, last, sha, ids, cps = run + 1, norm, shas[k].as_py(), [], []
            ids.append(docs[k])
            cps.append(n_cps[k])
        if len(out) > 5000:
            yield flush()
    if ids:
        close(True)
    yield flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_cp.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest id (a null id ranks last).  Null text counts as
    empty; all empty or white texts are one group.  Of fully repeated rows
    exactly one has kept = true.  An empty table gives an empty result.  Other
    columns are never read, so their names cannot clash."""
    spark = docs.sparkSession
    byte_batches(spark)
    norm = F.regexp_replace("text", WHITE, "")
    rows = (
        id_text(docs, id_col, text_col)
        .select(norm.cast("binary").alias("norm"), "doc_id", F.length("text").alias("n_cp"))
        .withColumn("sha", F.sha2("norm", 256))
        .withColumn("head", F.substring("norm", 1, KEY_BYTES))
    )
    rank = [F.col("n_cp").desc(), F.col("doc_id").asc_nulls_last()]
    ranges = rows.repartitionByRange("head", "sha", *rank).sortWithinPartitions("head", "sha", "norm", *rank)
    runs = stored(ranges.select("norm", "doc_id", "n_cp", "sha").mapInArrow(_runs, _RUNS), "exact-runs")

    # At most the first and the last run of each range: bounded by twice the number of ranges.
    edges = (
        runs.filter("edge and first")
        .groupBy("sha")
        .agg(
            F.sum("n").alias("all_n"),
            F.min(F.struct((-F.col("best_cp")).alias("c"), F.col("best_id").isNull().alias("z"), F.col("best_id").alias("i"),
                           F.col("pid").alias("p"), F.col("run").alias("r"))).alias("b"),
        )
        .withColumn("edge", F.lit(True))
    )
    # Only rows at the edge of a range meet the sums; the others are done.
    inner = runs.filter(~F.col("edge")).withColumns({"all_n": F.lit(None).cast("long"), "b": F.lit(None).cast(edges.schema["b"].dataType)})
    joined = runs.filter("edge").join(edges.drop("edge"), "sha", "left").unionByName(inner)
    whole = F.col("all_n").isNull()
    return joined.select(
        "doc_id",
        F.when(whole, F.col("best_id")).otherwise(F.col("b.i")).alias("keep_id"),
        F.when(whole, F.col("n")).otherwise(F.col("all_n")).alias("group_size"),
        (F.col("first") & (whole | ((F.col("b.p") == F.col("pid")) & (F.col("b.r") == F.col("run"))))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_cp",
    )
