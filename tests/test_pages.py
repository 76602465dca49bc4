"""The queries that clean pages against their SQL, on pages that the given small tables lack."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citewell.functions import text as T
from citewell.operators import chunking
from citewell.plans import runs
from tests.rows import rows

PAGES = [
    "<title>token = &quot</title><p>cut off</p>", "<p>&copy &lt &nbsp &middot x</p>", "<p>&amp &amplt; &amp;quot; &amp;amp;</p>", "&eacute; &#233; &#xe9; &hellip;", "<pé>a</pé>b<p1>c", "text \n ", "text \u0085", "a\r\n\r\nb\rc", None, "", "<p> </p>",
    "<p>" + "word &quot " * 90 + "</p><p>same</p><p>same</p>",
]


@pytest.mark.parametrize("name", ["chunk_build", "clean_html", "html_paragraphs", "html_entities", "ingest_report"])
def test_pages_are_cleaned_as_the_sql_does_it(spark, tmp_path, name):
    pd.DataFrame({"page_id": range(1, len(PAGES) + 1), "url": "u", "html": PAGES}).to_parquet(tmp_path / "pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_ingest_report_cleans_each_page_once(spark, tmp_path, monkeypatch):
    """Two runs read the same clean pages; before, every run cleaned its pages anew."""
    cleaned = f"{tmp_path}/cleaned"

    @F.pandas_udf("string")
    def clean(html: pd.Series) -> pd.Series:
        with open(cleaned, "a", encoding="utf-8") as f:
            f.writelines(f"{h}\n" for h in html)
        return html

    monkeypatch.setattr(runs, "clean_page", clean)
    texts = [f"text {i}" for i in range(12)]
    pd.DataFrame({"page_id": range(12), "url": "u", "html": texts}).to_parquet(tmp_path / "pages.parquet")
    assert runs.ingest_report(spark, str(tmp_path)).first()["total"] == 12
    assert sorted(open(cleaned, encoding="utf-8").read().split("\n")[:-1]) == sorted(texts)


def test_paragraphs_go_to_python_without_the_others_of_their_section(spark):
    sections = spark.range(3).selectExpr("cast(id as string) document_id", "0 group_id", "1 doc_group_id", "'s' source_id", "'v' source_version", "0 ordinal", "1 start", "1 end", "'single_ayah' mapping_type", "repeat('word\n\n', 5) text")
    chunks = chunking.build_chunks(sections, 400, pack=T.pack_words_udf(400))
    assert sorted((r["document_id"], r["dup"], r["parent_chunk_id"] is None) for r in chunks.collect()) == [(str(d), n, False) for d in range(3) for n in range(5)]
    seen = [line for line in chunks._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate posexplode(_ps" in line]
    assert len(seen) == 1 and re.search(r"posexplode\(_ps#\d+\), \[\d+", seen[0])  # the array is not asked for after
