"""Counting of trigrams part by part against counting at once; the collected model against plain counts."""

import numpy as np

from citewell.llm import language as L


def test_long_texts_are_counted_part_by_part(monkeypatch):
    monkeypatch.setattr(L, "_BYTES", 50)
    texts = ["héllo wörld " * 9, "", "x" * 130 + "yz abc 中文", "quick", "a" * 49, " " * 60 + "z"]
    keys, times = L.tallied(texts)
    bucket, text = L.trigrams(texts)
    want, n = np.unique((text << L.BUCKET_BITS) | bucket, return_counts=True)
    assert (keys == want).all() and (times == n).all()


def test_the_model_comes_as_one_row_a_language(spark):
    rows = [("hello there", "en"), ("hello again", "en"), ("guten tag", "de"), (None, "fr"), ("no label", None)]
    model = L.learn(spark.createDataFrame(rows * 3, "text string, lang string"))
    counts = np.zeros(1 << L.BUCKET_BITS)
    np.add.at(counts, np.concatenate([L.trigrams([t])[0] for t, lang in rows if lang == "en"]), 3)
    p = counts + L.SMOOTHING
    assert model.langs == ["de", "en"] and np.allclose(model.p[1], p / p.sum())
