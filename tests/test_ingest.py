"""Committed ingests: gate, previews, checks, one call a chunk, failed batches, pruning and lost mappings."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from citewell.operators import embedding, ingest as I
from citewell.sources import commits as K

SECTIONS = "array<struct<ordinal:int,group_id:int,start:int,end:int,mapping_type:string,text:string>>"
DOCS = f"id string, source_id string, source_version string, language string, content_type string, group_id int, sections {SECTIONS}"
SOURCES = "id string, verification_status string, licensing_status string, version_id string, version_hash string, language string, authority_tier int"


def now(month=1):
    return F.lit(f"2024-0{month}-01 00:00:00").cast("timestamp")


def docs(spark, texts, source="s", version="", mapping="single_ayah"):
    rows = [(f"d{i}", source, version, "", "", 1, [(k, 0, i + 1, i + 1, mapping, t) for k, t in enumerate(own)]) for i, own in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sources(spark):
    return spark.createDataFrame([("s", "verified", "cleared", "v1", "h1", "ar", 1), ("u", "unverified", "cleared", "v1", "h1", "ar", 1)], SOURCES)


def counted(path):
    def embedder(texts):
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[1.0, 0.0] for _ in texts]

    return embedder


def log_at(spark, tmp_path):
    return K.Commits(spark, f"file://{tmp_path}/store")


def run(log, documents, spark, embedder, month=1, **more):
    return I.ingest(log, documents, sources(spark), embedder, "m1", 2, now(month), buckets=4, backoff=0.0, **more)


def test_each_chunk_is_embedded_once_and_a_rerun_calls_nothing(spark, tmp_path):
    log, calls = log_at(spark, tmp_path), tmp_path / "calls"
    texts = [["first text", "second text"], ["third\n\nfourth"]]
    report = run(log, docs(spark, texts), spark, counted(calls), batch=3)
    assert sorted(calls.read_text().split("\n")[:-1]) == ["first text", "fourth", "second text", "third"]
    assert (report["total"], report["pending"], report["calls"], report["written"], report["mapped"], report["commit"]) == (4, 4, 2, 4, 4, 1)
    again = run(log, docs(spark, texts), spark, None, 2)  # needs no embedder
    assert (again["reused"], again["pending"], again["calls"], again["deleted"], again["commit"]) == (4, 0, 0, 0, 2)
    changed = run(log, docs(spark, [["first text", "other text"], ["third\n\nfourth"]]), spark, counted(calls), 3)
    assert (changed["reused"], changed["written"], changed["deleted"], changed["deleted_mappings"]) == (3, 1, 1, 1)
    stored = log.read("chunks").collect()
    assert sorted(r["text"] for r in stored) == ["first text", "fourth", "other text", "third"]
    assert {r["text"] for r in stored if r["updated_at"].month == 3} == {"other text"}  # reused rows are not rewritten
    assert {(r["source_version"], r["language"], r["content_type"], r["source_version_hash"]) for r in stored} == {("v1", "ar", "tafsir", "h1")}
    assert log.read("status").first()["status"] == "ingested"


def test_gate_preview_and_dry_run(spark, tmp_path):
    log = log_at(spark, tmp_path)
    with pytest.raises(I.Refused, match="u"):
        run(log, docs(spark, [["a"]], "u"), spark, None)
    with pytest.raises(I.Refused):
        run(log, docs(spark, [["a"]], "u"), spark, None, dry_run=True)
    report = run(log, docs(spark, [["a"]], "u"), spark, None, dry_run=True, preview=True)
    assert (report["total"], report["calls"], report["commit"]) == (1, 1, 0) and log.numbers() == []
    assert run(log, docs(spark, []), spark, None)["total"] == 0 and log.numbers() == []


@pytest.mark.parametrize(
    ("texts", "more", "match"),
    [([["  "]], {}, "white space"), ([[""]], {}, "no section with text"), ([["a"]], {"version": "v9"}, "not the pinned one"), ([["a"]], {"mapping": "thematic"}, "range invalid"), ([["a"]], {"mapping": "other"}, "range invalid")],
)
def test_violations_stop_before_anything_is_embedded(spark, tmp_path, texts, more, match):
    log, calls = log_at(spark, tmp_path), tmp_path / "calls"
    with pytest.raises(ValueError, match=match):
        run(log, docs(spark, texts, **more), spark, counted(calls))
    assert not calls.exists() and log.numbers() == []


def test_a_failed_batch_leaves_the_tables_and_names_its_range(spark, tmp_path):
    log = log_at(spark, tmp_path)
    run(log, docs(spark, [["kept"]]), spark, lambda texts: [[1.0, 0.0] for _ in texts])

    def broken(texts):
        if "d" in texts:
            raise TimeoutError("no answer")
        return [[1.0, 0.0] for _ in texts]

    many = docs(spark, [[t] for t in "abcdefg"])
    with pytest.raises(embedding.BatchError, match=r"\[3:6\] failed after 3 attempts: TimeoutError: no answer") as e:
        run(log, many, spark, broken, 2, batch=3)
    assert (e.value.start, e.value.end, e.value.attempts) == (3, 6, 3)
    assert [r["text"] for r in log.read("chunks").collect()] == ["kept"]
    assert log.read("status").first()["status"] == "failed"


@pytest.mark.parametrize(
    ("answer", "match", "attempts"),
    [
        (lambda t: [[1.0, 0.0]] * (len(t) - 1), "got 1 vectors for 2 texts", 1), (lambda t: [[1.0]] * len(t), "expected 2 dimensions, got 1", 1), (lambda t: [[float("nan"), 0.0]] * len(t), "NaN", 1),
        (lambda t: [[float("inf"), 0.0]] * len(t), "NaN or Inf", 1), (lambda t: [[0.0, 0.0]] * len(t), "zero vector", 1), (lambda t: [[2.0, 0.0]] * len(t), "not normalized", 1), (lambda t: [None] * len(t), "got 0", 1),
        (lambda t: (_ for _ in ()).throw(ValueError("no")), "ValueError", 1), (lambda t: (_ for _ in ()).throw(ConnectionError("no")), "ConnectionError", 3),
    ],
)
def test_answers_that_are_wrong(answer, match, attempts):
    frame = pd.DataFrame({"id": ["a", "b"], "text": ["x", "y"], "n": [0, 1], "batch": [0, 0]})
    out = embedding._batch(frame, answer, 2, 3, 0.0)
    assert re.search(match, out["error"][0]) and out["error"].nunique() == 1 and out["embedding"].isna().all() and set(out["attempts"]) == {attempts}


def test_a_lost_mapping_comes_back(spark, tmp_path):
    log = log_at(spark, tmp_path)
    run(log, docs(spark, [["a"], ["b"]]), spark, lambda t: [[1.0, 0.0] for _ in t])
    one = log.read("mappings").limit(1)
    log.commit(1, [K.prune(log, "mappings", one.select("chunk_id"), {"source_id": "s"}, ["chunk_id"])])
    assert log.read("mappings").count() == 1
    report = run(log, docs(spark, [["a"], ["b"]]), spark, None, 2)
    assert report["mapped"] == 1 and log.read("mappings").count() == 2


@pytest.mark.parametrize("few", [0, 10**6])
def test_a_run_writes_each_table_once_and_keeps_what_came_first(spark, tmp_path, monkeypatch, few):
    """Upsert and prune of a run are one writing; rows of another model are replaced, whether keys are broadcast or not."""
    monkeypatch.setattr(K, "FEW", few)
    log, one = log_at(spark, tmp_path), lambda texts: [[1.0, 0.0] for _ in texts]
    run(log, docs(spark, [["a", "a", "b"], ["c\n\nc\n\nd"], ["gone"]]), spark, one)
    other = docs(spark, [["a", "a", "new"], ["c\n\nc\n\nd"]])
    report = run(log, other, spark, one, 2)
    assert (report["total"], report["reused"], report["deleted"], report["deleted_mappings"], report["mapped"]) == (6, 5, 2, 2, 1)
    for table in ("chunks", "mappings"):
        assert len(list((tmp_path / "store" / table).glob("part=*"))) == 2
    again = I.ingest(log, other, sources(spark), one, "m2", 2, now(3), buckets=4)
    assert (again["reused"], again["pending"], again["deleted"]) == (0, 6, 0)
    rows = log.read("chunks").collect()
    assert sorted((r["text"], r["dup"], r["created_at"].month, r["updated_at"].month, r["model"]) for r in rows) == [("a", 0, 1, 3, "m2"), ("a", 1, 1, 3, "m2"), ("c", 0, 1, 3, "m2"), ("c", 1, 1, 3, "m2"), ("d", 0, 1, 3, "m2"), ("new", 0, 2, 3, "m2")]
    assert all(r["content_hash"] and r["text_normalized"] and r["embedding_hash"] for r in rows)


@pytest.mark.parametrize("size", [1, 3, 4, 100])
def test_batches_may_go_on_in_the_next_arrow_batch(size):
    """Rows come in any portions; every batch is asked for once, with all its rows, and rows keep their other columns."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"id": f"i{n}", "text": "bad" if n == 9 else f"t{n}", "more": [n], "n": n, "batch": n // 4} for n in (*range(4), *range(8, 13))])
    asked = []

    def embedder(texts):
        asked.append(texts)
        return [[0.0, 0.0] if t == "bad" else [1.0, 0.0] for t in texts]

    parts = [rows.slice(at, size) for at in range(0, len(rows), size)]
    out = pa.Table.from_batches(embedding._answers(embedder, 2, 1, 0.0)(iter([rows.slice(0, 0), *parts]))).to_pylist()
    assert asked == [["t0", "t1", "t2", "t3"], ["t8", "bad", "t10", "t11"], ["t12"]]
    assert [{k: r[k] for k in rows.schema.names} for r in out] == rows.to_pylist()
    assert [(r["embedding"], r["error"], r["attempts"]) for r in out] == [([1.0, 0.0], None, 1)] * 4 + [(None, "i9: zero vector", 1)] * 4 + [([1.0, 0.0], None, 1)]
