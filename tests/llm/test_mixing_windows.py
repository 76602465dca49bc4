"""Running sums of the mix where one id, or one and the same row, is most of the table."""

from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from citewell.llm import mixing


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_rows_of_one_id_fill_no_window(spark, monkeypatch, ids):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 500)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("some words "), F.repeat(F.lit("more "), (F.col("id") % 4).cast("int")))).otherwise(F.lit("always the same words"))
    own = {"null": F.lit(None).cast("long"), "one": F.lit(7).cast("long"), "few": F.when(F.col("id") % 2 == 0, F.col("id") % 5)}[ids]
    docs = spark.range(20_000).select(own.alias("doc_id"), text.alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    out = mixing.mix(docs)
    rows = out.select("source", "size", "upto", "target", "taken").collect()
    assert len(rows) == 20_000
    for source in ("a", "b"):
        mine = sorted((r["upto"], r["size"]) for r in rows if r["source"] == source)
        assert [u for u, _ in mine] == list(accumulate(s for _, s in mine))  # one running sum, whatever repeats
        target = next(r["target"] for r in rows if r["source"] == source)
        assert abs(sum(r["taken"] for r in rows if r["source"] == source) - target) <= 10
