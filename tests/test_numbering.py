"""Numbering against a plain count, with a group that holds most rows, null groups and few rows."""

from pyspark.sql import functions as F

from citewell.operators import ranking
from citewell.operators.numbering import numbered


def test_numbers_within_groups_and_over_the_table(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 7).alias("g"), F.hash("id").alias("v"), "id")
    out = numbered(df, ["v", "id"], "n", ["g"])
    assert out.columns == ["g", "v", "id", "n"]
    rows = out.toPandas().sort_values(["g", "v", "id"])
    assert (rows.groupby("g", dropna=False).cumcount() == rows["n"]).all() and len(rows) == 5000
    assert numbered(df, ["v", "id"]).toPandas().sort_values(["v", "id"])["n"].tolist() == list(range(5000))


def test_few_rows(spark):
    df = spark.range(3).coalesce(1)
    assert sorted(r["n"] for r in numbered(df, ["id"]).collect()) == [0, 1, 2]
    assert numbered(df.where("id > 9"), ["id"]).collect() == []


def test_batches_have_no_window_over_one_partition(spark):
    out = ranking.batched(spark.range(100), 32, ["id"])
    assert "Window" not in out._jdf.queryExecution().toString()
    assert {r["batch"]: r["count"] for r in out.groupBy("batch").count().collect()} == {0: 32, 1: 32, 2: 32, 3: 4}
