"""Token ids in Parquet list columns (operator 12).

``write_tokens`` encodes every whole text and writes one row per document, in
ascending id order over all files:

    part int, doc_id long, local_start long, n_tokens long, ids array<int>

``ids`` is dictionary encoded (ids repeat; a row group's dictionary is at most
the vocabulary); the other columns climb or hardly change and are delta
encoded.  Row groups and pages are kept small and the writer adds page indexes
on the ascending columns, so a filter on doc_id reads the matching pages
only, and a read without ``ids`` never touches the tokens.

A document's place in the whole stream is its place in its file (local_start)
plus the file's place.  The latter stands in a narrow index beside the files,
one row per file: part, first_token, n_tokens, n_docs, first_doc, last_doc.
So the texts are encoded once and move once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches
from revspark.llm.packing import WordTokens, token_encoder

END_ID = 2
#: Bytes of a row group, of a page, and rows of a page at most.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 256
#: Words remembered per Python worker (two generations of this many, and as many pieces): about 350 MB.
CACHE_WORDS = 600_000
TOKENS_DDL = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Writer settings: version 2 pages (delta encoding of integers), a dictionary for the ids only.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def _encode(tokenizer_path: str, end_id: int):
    """Sorted (doc_id, text) rows of one file -> rows of the file format."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: WordTokens = token_encoder(tokenizer_path, CACHE_WORDS)
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            own = enc.ids(b.column(1))
            n = np.array([len(x) + 1 for x in own], np.int64)
            ends = np.cumsum(n)
            flat = np.concatenate([y for x in own for y in (x, end)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(at + ends - n), pa.array(n), ids],
                names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            at += int(ends[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``path``/tokens and ``path``/index.

    Ids are those of the whole text (null: empty), then ``end_id``.  Null ids
    come first; rows that share an id go by a digest of their text, and rows
    equal in both by their place in the input, so copies of one row may be in
    many files.  An empty table writes empty tables.  Other columns are never
    read."""
    spark = docs.sparkSession
    byte_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("copy"))
    order = ["doc_id", "digest", "copy"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(_encode(tokenizer_path, end_id), TOKENS_DDL).write.options(**WRITER).parquet(f"{path}/tokens")
    # One row per file is summed up in order; the ids are not read for it.
    files = _tokens(spark, path).groupBy("part").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files.select("part", F.coalesce(before, F.lit(0)).alias("first_token"), "n_tokens", "n_docs", "first_doc", "last_doc").write.parquet(f"{path}/index")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS_DDL).parquet(f"{path}/tokens")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: part, first_token, n_tokens, n_docs, first_doc, last_doc."""
    return spark.read.schema("part int, first_token long, n_tokens long, n_docs long, first_doc long, last_doc long").parquet(f"{path}/index")


def _with_start(rows: DataFrame, index: DataFrame) -> DataFrame:
    start = (F.col("first_token") + F.col("local_start")).alias("start")
    return rows.join(index.select("part", "first_token"), "part").select("doc_id", start, *[c for c in rows.columns if c not in ("part", "doc_id", "local_start")])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; the ids are not read."""
    return _with_start(_tokens(spark, path).select("part", "doc_id", "local_start", "n_tokens"), read_index(spark, path))


def read_documents(spark: SparkSession, path: str, first_doc: int, last_doc: int) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with first_doc <= doc_id <= last_doc; the filter goes down to the pages."""
    return _with_start(_tokens(spark, path).filter(F.col("doc_id").between(first_doc, last_doc)), read_index(spark, path))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ids`` replaced by the crc32 of their little-endian unsigned 32-bit form."""
    for b in batches:
        ids = b.column(4)
        cuts = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files; only the narrow columns meet the index."""
    byte_batches(spark)
    rows = _tokens(spark, path).mapInArrow(_crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(rows, read_index(spark, path))
