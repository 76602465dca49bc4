"""What is an error rather than a row: missing citations, invalid ranges; predicates over audits."""

import pytest

from citewell.operators import chunking, coverage, review, verify


def test_carried_citations_keep_their_order_and_miss_nothing(spark):
    chunks = spark.createDataFrame([("a", "s", "v"), ("b", "s", "v")], "chunk_id string, source_id string, source_version string")
    items = lambda refs: spark.createDataFrame([(1, refs)], "item_id int, refs array<string>")
    assert [r["chunk_id"] for r in review.carried_citations(items(["b", " ", "a", "b"]), chunks).orderBy("pos").collect()] == ["b", "a", "b"]
    assert review.carried_citations(items([]), chunks).collect() == []
    with pytest.raises(Exception, match="item 1 cites a missing chunk: x"):
        review.carried_citations(items(["a", "x"]), chunks).collect()


def test_strict_mappings_stop_at_an_invalid_range(spark):
    schema = "id string, source_id string, source_version string, group_id int, start int, end int, mapping_type string"
    good = spark.createDataFrame([("a", "s", "v", 1, 2, 2, "single_ayah"), ("t", "s", "v", 1, 0, 0, "thematic")], schema)
    assert chunking.chunk_anchor_map(good, strict=True).where("not invalid").count() == 2
    bad = good.unionByName(spark.createDataFrame([("x", "s", "v", 1, 3, 2, "multi_ayah")], schema))
    assert chunking.chunk_anchor_map(bad).where("invalid").count() == 1
    with pytest.raises(Exception, match="invalid range of chunk x"):
        chunking.chunk_anchor_map(bad, strict=True).collect()


def test_predicates_over_audits(spark):
    drift = spark.createDataFrame([("a", "mismatch")], "chunk_id string, shape string")
    assert [coverage.no_drift(d).first()[0] for d in (drift, drift.limit(0))] == [False, True]
    audited = spark.createDataFrame([("a", []), ("b", ["missing"])], "id string, defects array<string>")
    assert [r["id"] for r in verify.needs_embedding(audited).collect()] == ["b"]
