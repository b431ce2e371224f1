"""S1 folder scan and K1 distributed ids."""
from pyspark.sql import functions as F

from revspark.sources import sinks as K
from revspark.sources.scan import scan_source_dir


def test_scan_source_dir_keeps_supported_nonblank(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("# doc\n")
    (tmp_path / "c.java").write_text("   \n")
    sub = tmp_path / "pkg"
    sub.mkdir()
    (sub / "D.java").write_text("class D {}\n")
    got = sorted(r.file.rsplit("/", 1)[-1] for r in scan_source_dir(spark, str(tmp_path)).collect())
    assert got == ["D.java", "a.py"]


def test_row_ids_dense_unique_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("v"))
    out = K.with_row_ids(df, ["k"], partitions=5).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(1, 1001))
    assert all(r.id == r.k + 1 for r in out)


def test_limits_flag_overflow(spark):
    df = spark.createDataFrame([("a" * 2500, "m")], "code_snippet string, message string")
    r = K.flag_overflow(df).collect()[0]
    assert len(r.code_snippet) == 2500 and r.code_snippet_overflow and not r.message_overflow


def test_ids_go_on_after_the_stored_ones(spark, tmp_path):
    path = str(tmp_path / "findings")
    for k in range(2):
        df = spark.range(5).select((F.col("id") + 10 * k).alias("k"), F.lit("R").alias("rule_id"))
        K.persist_findings(K.with_row_ids(df, ["k"], partitions=2, after=K.last_id(spark, path)), path)
    rows = sorted((r.id, r.k) for r in spark.read.parquet(path).collect())
    assert rows == [(k + 1, k if k < 5 else k + 5) for k in range(10)]
