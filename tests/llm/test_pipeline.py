"""The stages one after the other, each against a plain version on its own input."""

import re

import corpus_pipeline
from tests.llm.helpers import components
from tests.llm.test_operators import plain_spans


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs.toPandas()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.toPandas())
    raw, good, single, clean, mix, packed = tables
    assert 0.8 * len(raw) < len(good) < len(raw)
    roots = components(list(zip(good.doc_id, good.text, strict=True)), 5, 80)
    assert set(single.doc_id) == set(roots.values()) and single.doc_id.is_unique
    assert set(clean.doc_id) == set(single.doc_id)
    before = dict(zip(single.doc_id, single.text, strict=True))
    for i, text, n in zip(clean.doc_id, clean.text, clean.n_chars, strict=True):
        assert plain_spans(text) == [] and n == len(text)
        assert ("[SECRET]" in text) == bool(plain_spans(before[i]))
        if "[SECRET]" not in text:
            assert text == before[i]
    assert set(mix.doc_id) <= set(clean.doc_id) and mix.groupby("doc_id").size().max() <= 2
    assert set(packed.doc_id) == set(mix.doc_id)
    assert packed[packed.piece == 0].groupby("doc_id").size().to_dict() == mix.groupby("doc_id").size().to_dict()


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [n for n in range(1, 11) if not any(re.match(rf"op{n}_", x) for x in names)] == []
