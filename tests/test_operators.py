"""Scenarios: chunks, increments, retrieval, coverage, review, files."""

import pytest
from pyspark.sql import functions as F

from citewell.operators import chunking, coverage, incremental, ranking, registry, retrieval, review, scans, verify
from citewell.sources import snapshots, tables

SECTION = "document_id string, group_id int, doc_group_id int, source_id string, source_version string, ordinal int, start int, end int, mapping_type string, text string"


def sections(spark, *texts, document="d", start=1):
    return spark.createDataFrame([(document, 0, 12, "s", "v", i, start + i, start + i, "single_ayah", t) for i, t in enumerate(texts)], SECTION)


def test_one_chunk_a_paragraph_with_a_shared_parent(spark):
    rows = chunking.build_chunks(sections(spark, "one\n\ntwo\n\nthree")).collect()
    assert len(rows) == 3 and len({r["parent_chunk_id"] for r in rows}) == 1 and {r["group_id"] for r in rows} == {12}
    assert rows[0]["parent_chunk_id"] not in {r["id"] for r in rows}


def test_oversized_section_is_packed(spark):
    rows = chunking.build_chunks(sections(spark, "word " * 900)).collect()
    assert len(rows) >= 2 and all(len(r["text"]) <= 1200 for r in rows)


def test_repeats_and_stability(spark):
    same = chunking.build_chunks(sections(spark, "same\n\nsame", "same")).collect()
    assert len({r["id"] for r in same}) == 3
    before = {r["text"]: r["id"] for r in chunking.build_chunks(sections(spark, "a", "b", start=5)).collect()}
    shifted = sections(spark, "new").unionByName(sections(spark, "a", "b", start=5).withColumn("ordinal", F.col("ordinal") + 1))
    after = {r["text"]: r["id"] for r in chunking.build_chunks(shifted).collect()}
    assert after["a"] == before["a"] and after["b"] == before["b"]


def test_two_documents_keep_their_identities(spark):
    both = sections(spark, "same").unionByName(sections(spark, "same", document="e"))
    assert chunking.build_chunks(both).select("id").distinct().count() == 2
    assert chunking.build_chunks(both, legacy=True).select("id").distinct().count() == 1


def test_empty_section_vanishes(spark):
    assert chunking.build_chunks(sections(spark, "", "real")).count() == 1


def test_document_violations(spark):
    rows = spark.createDataFrame([("a", "v", "ar", "tafsir", [("x",)]), ("b", "v", "ar", "odd", [(" ",), ("x",)]), ("c", None, "ar", "tafsir", [("",)])], "id string, source_version string, language string, content_type string, sections array<struct<text:string>>")
    found = {r[0]: r[1] for r in chunking.document_violations(rows).collect()}
    assert found["a"] == [] and len(found["b"]) == 2 and "no section with text" in found["c"]
    with pytest.raises(ValueError):
        chunking.enforce(chunking.document_violations(rows), "documents")


def test_chunk_violations(spark):
    rows = spark.createDataFrame([("i", "s", "v", "t", "tafsir", 1, "single_ayah", 1, 1, None)], "id string, source_id string, source_version string, text string, content_type string, authority_tier int, mapping_type string, start int, end int, content_hash string")
    good = rows.withColumn("content_hash", F.sha2("text", 256))
    assert good.select(chunking.chunk_violations()).first()[0] == []
    assert rows.select(chunking.chunk_violations()).first()[0] == ["content_hash differs"]


def test_ingest_rerun_edit_and_gate(spark):
    sources = spark.createDataFrame([("s", "verified", "cleared")], "id string, verification_status string, licensing_status string")
    empty = spark.createDataFrame([], "id string, model string")
    planned, report = chunking.ingest(sections(spark, "a", "b", "c"), sources, empty, "m")
    assert report.first().asDict() == {"total": 3, "reused": 0, "pending": 3, "calls": 1, "stale": 0}
    stored = planned.select("id", "model")
    assert chunking.ingest(sections(spark, "a", "b", "c"), sources, stored, "m")[1].first()["pending"] == 0
    assert chunking.ingest(sections(spark, "a", "b", "c"), sources, stored, "m2")[1].first()["pending"] == 3
    edited = chunking.ingest(sections(spark, "a", "B", "c"), sources, stored, "m")[1].first()
    assert edited["pending"] == 1 and edited["stale"] == 1
    closed = sources.withColumn("licensing_status", F.lit("pending"))
    assert chunking.ingest(sections(spark, "a"), closed, empty, "m")[0].count() == 0


def test_embedder_is_checked(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    assert {r["id"] for r in chunking.embed_batches(rows, lambda t: [[1.0, 0.0]] * len(t), "m", 2).collect()} == {"1", "2"}
    with pytest.raises(Exception, match="embedder"):
        chunking.embed_batches(rows, lambda t: [[1.0]] * len(t), "m", 2).collect()


def test_prune_stays_in_its_scope(spark):
    rows = spark.createDataFrame([("1", "s", "v"), ("2", "s", "v"), ("3", "s", "w")], "id string, source string, version string")
    none = rows.where("false")
    assert {r["id"] for r in incremental.prune(rows, none, {"source": "s", "version": "v"}).collect()} == {"3"}
    assert {r["id"] for r in incremental.prune(rows, rows.where("id = '2'"), {"source": "s", "version": "v"}).collect()} == {"2", "3"}


def test_upsert_is_idempotent(spark):
    schema = "id string, x int, created_at string, updated_at string"
    stored = spark.createDataFrame([("1", 1, "t0", "t0")], schema)
    new = spark.createDataFrame([("1", 2), ("2", 3)], "id string, x int")
    first = incremental.upsert(stored, new, ["id"], F.lit("t1"))
    assert {tuple(r) for r in first.collect()} == {("1", 2, "t0", "t1"), ("2", 3, "t1", "t1")}
    assert {tuple(r)[:3] for r in incremental.upsert(first, new, ["id"], F.lit("t2")).collect()} == {("1", 2, "t0"), ("2", 3, "t1")}


def test_retrieval_chain(spark):
    sizes = spark.createDataFrame([(1, 9)], "group_id int, n int")
    maps = spark.createDataFrame([("e", 1, 3, 4, True), ("u", 1, 5, 5, False), ("wide", 1, 8, 20, True)], "chunk_id string, group_id int, start int, end int, verified boolean")
    thematic = spark.createDataFrame([("t", 1, [1.0, 0.0], True), ("n", 1, [1.0, 0.0], False)], "chunk_id string, group_id int, v array<double>, verified boolean")
    anchors = spark.createDataFrame([(1, 3, [1.0, 0.0]), (1, 5, [1.0, 0.0]), (1, 6, None), (1, 8, [])], "group_id int, anchor int, v array<double>")
    found = {r["anchor"]: (r["tier"], r["chunk_id"]) for r in retrieval.evidence_chain(anchors, maps, sizes, thematic).collect()}
    assert found == {3: ("exact", "e"), 5: ("thematic", "t"), 6: ("insufficient", None), 8: ("insufficient", None)}
    closed = retrieval.evidence_chain(anchors, maps, sizes, thematic, embedder=False)
    assert {r["tier"] for r in closed.where("anchor = 5").collect()} == {"insufficient"}


def test_coverage_and_drift(spark):
    sizes = spark.createDataFrame([(1, 3)], "group_id int, n int")
    maps = spark.createDataFrame([("a", 1, 1, 1, "single_ayah"), ("b", 1, 1, 1, "single_ayah"), ("c", 1, 2, 2, "single_ayah"), ("z", 1, 500, 500, "single_ayah")], "chunk_id string, group_id int, start int, end int, mapping_type string")
    chunks = spark.createDataFrame([("a", False, None), ("b", None, None), ("c", True, None)], "chunk_id string, verified boolean, parent_id string")
    rows = {r["anchor"]: (r["chunks"], r["usable"], r["parents"]) for r in coverage.coverage_by_start(maps.where("chunk_id <> 'z'"), chunks, sizes).collect()}
    assert rows == {1: (2, 0, 2), 2: (1, 1, 1), 3: (0, 0, 0)}
    assert [r["chunk_id"] for r in coverage.out_of_range(maps, sizes).collect()] == ["z"]
    wide = maps.withColumn("end", F.when(F.col("chunk_id") == "a", 40).otherwise(F.col("end"))).where("chunk_id <> 'c'")
    drift = {r["chunk_id"]: r["shape"] for r in coverage.mapping_drift(wide, maps.where("chunk_id <> 'b'")).collect()}
    assert drift == {"a": "mismatch", "b": "mapping_only", "c": "chunk_only"}
    assert coverage.coverage_report(coverage.coverage_by_start(maps.where("chunk_id <> 'z'"), chunks, sizes)).first()["verdict"] == "FAIL"


def test_empty_corpus_fails_its_audit(spark):
    rows = spark.createDataFrame([], "id string, v array<double>, model string, normalized boolean, hash string")
    tally = {r["defect"]: r["n"] for r in verify.defect_tally(verify.vector_audit(rows, "m", 2)).collect()}
    assert tally == {"VERDICT": 0}


def test_vector_audit(spark):
    rows = spark.createDataFrame([("ok", [1.0, 0.0], "m", True, "h"), ("null", None, "m", True, "h"), ("w", [1.0], "m", True, "h"), ("f", [1.0, 0.0], "x", False, None)], "id string, v array<double>, model string, normalized boolean, hash string")
    found = {r["id"]: r["defects"] for r in verify.vector_audit(rows, "m", 2).collect()}
    assert found == {"ok": [], "null": ["missing"], "w": ["wrong_width"], "f": ["foreign_model", "not_marked_normalized", "no_hash"]}


def test_vector_audit_recomputes_hashes(spark):
    import hashlib

    plain = lambda model, *parts: hashlib.sha256(f"{model}\0".encode() + b"".join(f"{x}\0".encode() for x in parts) + b"\1").hexdigest()
    good = plain("m", "0.6", "0.8")
    data = [("ok", [0.6, 0.8], "m", good), ("swapped", [0.8, 0.6], "m", good), ("sign", [-0.6, 0.8], "m", good), ("constant", [0.6, 0.8], "m", "h"), ("model", [0.6, 0.8], "x", good), ("own", [0.6, 0.8], "x", plain("x", "0.6", "0.8")), ("w", [1.0], "m", good), ("blank", [0.6, 0.8], "m", ""), ("null", None, "m", good), ("empty", [], "m", good)]
    rows = spark.createDataFrame([(i, v, m, True, h) for i, v, m, h in data], "id string, v array<double>, model string, normalized boolean, hash string")
    audited = verify.vector_audit(rows, "m", 2, rehash=True)
    found = {r["id"]: r["defects"] for r in audited.collect()}
    bad = ["hash_mismatch"]
    assert found == {"ok": [], "swapped": bad, "sign": bad, "constant": bad, "model": ["foreign_model", *bad], "own": ["foreign_model"], "w": ["wrong_width", *bad], "blank": ["no_hash"], "null": ["missing"], "empty": ["missing"]}
    tally = {r["defect"]: r["n"] for r in verify.defect_tally(audited.where("id in ('ok', 'sign')")).collect()}
    assert tally == {"hash_mismatch": 1, "VERDICT": 0}


def test_decisions(spark):
    log = spark.createDataFrame([(1, 1, 1, "escalate", "r", None), (1, 2, 2, "approve", "r", None), (1, 3, 3, "reject", "r", None), (2, 1, 4, "edit_approve", "r", None), (2, 2, 5, "edit_approve", "r", "t"), (3, 1, 6, "odd", "r", None), (3, 2, 7, "reject", " ", None)], "item_id int, ts int, seq int, decision string, reviewer string, text string")
    outcome = {r["seq"]: r["outcome"] for r in review.fold_decisions(log).collect()}
    assert outcome == {1: "applied", 2: "applied", 3: "not_pending", 4: "error", 5: "applied", 6: "error", 7: "error"}
    assert {r["item_id"]: r["status"] for r in review.final_decisions(log).collect()} == {1: "published", 2: "published"}


def test_queue_keeps_cited_order_and_reports_missing(spark):
    items = spark.createDataFrame([(1, 1, 1, ["b", "", "x", "a", "b"], "v1"), (2, 1, 2, [], "v1")], "item_id int, group_id int, start int, refs array<string>, snapshot string")
    chunks = spark.createDataFrame([("a", "s", "v1"), ("b", "s", "v2")], "chunk_id string, source_id string, source_version string")
    sources = spark.createDataFrame([("s", "Title")], "id string, title string")
    rows = {r["item_id"]: r for r in review.review_queue(items, chunks, sources).collect()}
    assert rows[1]["evidence"] == ["b", "a", "b"] and rows[1]["missing"] == ["x"] and rows[1]["citation"] == "Title" and rows[1]["mismatch"]
    assert rows[2]["evidence"] == [] and not rows[2]["mismatch"]


def test_pins(spark):
    sources = spark.createDataFrame([("a", "v1"), ("b", None), ("c", None), ("d", "v1"), ("e", "gone"), ("f", None)], "id string, current_version string")
    versions = spark.createDataFrame([("v1", "a", "h"), ("v2", "b", "h"), ("v3", "c", "h"), ("v4", "c", "h"), ("v6", "f", "")], "id string, source_id string, content_hash string")
    found = {r["id"]: (r["version"], r["reason"]) for r in registry.resolve_pins(sources, versions).collect()}
    assert found == {"a": ("v1", None), "b": ("v2", None), "c": (None, "ambiguous"), "d": (None, "wrong_owner"), "e": (None, "dangling_pointer"), "f": (None, "no_hash")}


def test_scans(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert scans.get(df, id=2) == {"id": 2, "x": "b"}
    with pytest.raises(scans.NotFound):
        scans.get(df, id=3)
    assert scans.public(df, {"x"}).columns == ["id"]
    rows, total = ranking.bounded(df, 1, ["id"])
    assert rows.count() == 1 and total.first()["truncated"]


def test_manifest_files(spark, tmp_path):
    assert tables.read_manifest(spark, None).count() == 0 and tables.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('[{"id":"d","source_version":"v","language":"ar","content_type":"tafsir","group_id":3,"sections":[{"ordinal":0,"group_id":0,"start":1,"end":1,"mapping_type":"single_ayah","text":"a\\n\\nb"}]}]')
    manifest = tables.read_manifest(spark, str(tmp_path / "m.json"))
    assert chunking.build_chunks(tables.sections_of(manifest, "s")).count() == 2
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        tables.read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_corpus_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(12, i, f"text {i}") for i in range(1, 4)], "group_id int, anchor int, text string")
    (tmp_path / "c.md").write_text(snapshots.corpus_markdown("Title", rows))
    parsed = tables.parse_corpus(tables.read_whole_texts(spark, str(tmp_path / "c.md")), 12)
    assert {(r["anchor"], r["text"]) for r in parsed.collect()} == {(i, f"text {i}") for i in range(1, 4)}
    assert tables.corpus_violations(parsed, 3).first()["violations"] == []
    assert tables.corpus_violations(parsed, 4).first()["violations"] == ["gap"]
    assert "no headings" in tables.corpus_violations(parsed.where("false"), 3).first()["violations"]
    assert snapshots.unchanged(str(tmp_path / "c.md"), snapshots.corpus_markdown("Title", rows))


def test_snapshots_swap(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int"
    assert snapshots.read(spark, path, schema).count() == 0
    snapshots.write(spark.range(2).selectExpr("cast(id as int) id"), path)
    snapshots.write(snapshots.read(spark, path, schema).where("id > 0"), path)
    assert [r["id"] for r in snapshots.read(spark, path, schema).collect()] == [1]


def test_registry_checks(spark):
    reg = spark.createDataFrame([("s", "v", "d", "f"), ("x", "v9", "d", "f")], "source_id string, version_id string, document_id string, raw_text_ref string")
    ids = lambda i, **c: spark.createDataFrame([(i, *c.values())], "id string" + "".join(f", {k} string" for k in c))
    files = spark.createDataFrame([("f", "other")], "path string, content_hash string")
    found = {(r[0], r[1]) for r in registry.registry_integrity(reg, ids("s"), ids("v", content_hash="h"), ids("d"), files).collect()}
    assert found == {("x", "no_source"), ("x", "no_version"), ("s", "hash_differs")}


def test_topk_in_portions_and_blocks(spark):
    vectors = [(i, 1 if i % 4 else 2, [float((i * 7) % 11 - 5), float((i * 3) % 13 - 6), 1.0]) for i in range(40)]
    own = spark.createDataFrame(vectors, "chunk_id int, group_id int, v array<double>")
    asked = own.where("chunk_id < 20 or group_id = 2").withColumnRenamed("chunk_id", "query_id")
    few, one = (retrieval.topk_in_group(asked, own, 3, block=b).select("query_id", "rank", "chunk_id", "score") for b in (4, 4096))
    assert sorted(few.collect()) == sorted(one.collect()) and few.count() == 3 * asked.count()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for i, group, v in vectors[:20]:
        best = sorted((-round(cosine(v, w), 12), j) for j, other, w in vectors if other == group)[:3]
        assert [r["chunk_id"] for r in few.where(F.col("query_id") == i).orderBy("rank").collect()] == [j for _, j in best]
