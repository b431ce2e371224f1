"""Inputs shared by the tests (a module with a name of its own: two folders here have a conftest)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def files_df(spark, sources: dict, review_id: int = 0):
    rows = [(review_id, k, v) for k, v in sources.items()]
    return spark.createDataFrame(rows, "review_id long, file string, content string")
