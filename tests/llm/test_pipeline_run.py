"""run() as a whole: against plain versions of mixing and packing, on empty tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from citewell.llm import mixing, packing
from tests.llm.helpers import awkward, words

DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def plain_mix(docs):
    """{doc_id: copies} of (doc_id, text, source): one queue a source, finish times, the cut at the budget."""
    sized = [(i, len(words(t)), s) for i, t, s in docs]
    sources = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(sources)}
    cap = {s: size[s] * float(mixing.MAX_COPIES) for s in sources}
    budget, open_, target = sum(size.values()) * mixing.BUDGET_RATIO, sorted(sources, key=lambda s: (cap[s] / weight[s], sources.index(s))), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        if cap[open_[0]] > level * weight[open_[0]]:
            break
        target[open_[0]] = cap[open_[0]]
        budget -= cap[open_.pop(0)]
    target |= {s: level * weight[s] for s in open_}
    copies, upto = [], Counter()
    key = lambda d: (int(hashlib.sha256(f"{mixing.SEED}:{d[0]}".encode()).hexdigest()[:15], 16), d[0], d[1])
    for i, n, s in sorted(sized, key=key):
        upto[s] += n
        copies += [((size[s] * c + upto[s]) / target[s], sources.index(s), upto[s], c, n, i) for c in range(mixing.MAX_COPIES) if n]
    out, used, left = Counter(), 0, sum(target.values())
    for finish, _, _, _, n, i in sorted(copies):
        used += n
        if finish <= 1 or used <= left:
            out[i] += 1
    return out


def pieces(tokenizer, doc_id, text):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(doc_id, k, at, len(x := ids[at : at + 2048]), zlib.crc32(x.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]


def test_run_against_plain_mixing_and_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    clean = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    taken, texts = plain_mix(clean), {i: t for i, t, _ in clean}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter(p for i, n in taken.items() for p in pieces(tokenizer, i, texts[i]) for _ in range(n))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


def run_on(spark, path, documents, labels):
    documents.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_run_on_empty_tables(spark, tmp_path):
    assert run_on(spark, tmp_path, spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS)) == []


def test_run_on_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(13)] + [(None, 1, 0), (4, 1, 0), (5, None, None)], LABELS)
    rows = run_on(spark, tmp_path, awkward(spark), labels)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict()) if rows else True
    assert all(r["length"] <= 2048 for r in rows)


def test_no_stage_names_a_local_folder():
    assert re.search(r"tempfile|/tmp", open(corpus_pipeline.__file__, encoding="utf-8").read()) is None
