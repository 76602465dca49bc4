"""Corpora split inside of their files against the parser of whole files."""

import pytest

from citewell.sources import tables


@pytest.mark.parametrize("carry", [2000, 3])
def test_split_files_give_the_sections_of_whole_files(spark, tmp_path, monkeypatch, carry):
    monkeypatch.setattr(tables, "_CARRY", carry)
    body = lambda i: f"text {i}\n\nmore of it, été\n" + "".join(f"## note {k}\nline\n" for k in range(i % 7))
    one = "# Title\n\npreamble\n" + "".join(f"## 12:{i}\n\n{body(i)}" for i in range(1, 300))
    two = "##  12:300 \r\nat the start\r\n## 13:1\nother group\n## 12:301\n## 12:302\nlast"
    (tmp_path / "a.md").write_text(one, encoding="utf-8", newline="")
    (tmp_path / "b.md").write_text(two, encoding="utf-8", newline="")
    (tmp_path / "c.md").write_text("no heading here\n## nor here\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split = tables.read_corpus(spark, str(tmp_path), 12)
        assert spark.read.text(str(tmp_path), lineSep="\n## ").rdd.getNumPartitions() > 5
        got = {(r["path"].split("/")[-1], r["anchor"], r["text"]) for r in split.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = tables.parse_corpus(tables.read_whole_texts(spark, str(tmp_path)), 12)
    want = {(r["path"].split("/")[-1], r["anchor"], r["text"]) for r in whole.collect()}
    assert got == want and len(got) == 302
