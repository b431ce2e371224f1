"""Training-corpus pipeline over ``documents``.

Five stages, each one operator of ``revspark.llm``: toxic documents go, of
equal texts one stays, of near duplicates one stays, personal data becomes
pseudonyms, and what is left is packed into training sequences.  Every stage
works on all rows that the one before kept; all but the last return the
columns they were given.  An empty table goes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm import exact_dedup, minhash_dedup, packing, pii, queries, toxicity
from revspark.llm.common import byte_batches, read_table, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier does not call toxic (score below 0.5), unchanged.

    The classifier learns from the labels table.  Null and empty texts stay."""
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    byte_batches(spark)
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    return docs.filter(~(has_text & (toxicity.scorer(model)("text") >= 0.5)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, unchanged; of fully repeated rows one."""
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    keys = ["__row_id", "__row_sha", "__row_cp"]
    text = F.coalesce("text", F.lit(""))
    norm = F.regexp_replace(text, exact_dedup.WHITE, "").cast("binary")
    left = docs.withColumns({"__row_id": own("doc_id"), "__row_sha": F.sha2(norm, 256), "__row_cp": F.length(text)})
    right = kept.select(own("doc_id").alias("__row_id"), F.col("text_sha256").alias("__row_sha"), F.col("n_cp").alias("__row_cp"))
    return left.join(right, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8), unchanged: the one with the smallest id.

    Rows are compared, not ids: each has a written key of its own, so rows that
    share an id or have none take part with their own texts.  A row without an
    id comes after all others; of one id the smallest text digest is first."""
    keyed = stored(docs.withColumn("__row_key", F.monotonically_increasing_id()), "near-rows")
    near = minhash_dedup.near_dedup(keyed, words=5, percent=80, id_col="__row_key").select(F.col("doc_id").alias("__row_key"), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row_key")
    first = near.join(keyed.select("__row_key", rank.alias("rank")), "__row_key").groupBy("component_id").agg(F.min("rank").alias("rank"))
    kept = first.select(F.col("rank.__row_key").alias("__row_key"))
    return keyed.join(kept, "__row_key", "left_semi").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by pseudonyms of the same format and length."""
    key = spark.conf.get(queries.PII_KEY_CONF, queries.PII_KEY)
    return pii.pseudonymise(docs, key, list_col="__pii").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, MinHash and the packing rule have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
