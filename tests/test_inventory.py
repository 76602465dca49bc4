"""What the catalogue's queries cannot show: errors, both paths of the overlap, writers, and a whole ingest."""

import pytest
from pyspark.sql import functions as F

from citewell.functions import overlap
from citewell.functions import text as T
from citewell.operators import chunking, scans, verify
from citewell.plans import retrieval
from citewell.sources import snapshots, tables
from tests.rows import rows


@pytest.mark.parametrize("name", ["quote_coverage", "quoted_run", "corroboration_queue"])
def test_overlap_by_the_join_equals_the_oracle(name, spark, sf, duck):
    """The path beyond the index, on the driver's tables."""
    got = retrieval.QUERIES[name](spark, sf, max_windows=0).toPandas()
    assert rows(got) == rows(duck.execute(retrieval.ORACLES[name]).df())


def test_both_overlap_paths_agree_on_short_and_repeated_texts(spark):
    verses = spark.createDataFrame([(1, "abc"), (2, "tiny"), (3, "one two three four five six"), (4, ""), (5, None), (6, "aaaaaaaaaaaa"), (7, "é中\U0001f600")], "verse_id long, text string")
    passages = spark.createDataFrame([(1, "xx abc yy"), (2, "abc"), (3, "a tiny one two three four"), (4, None), (5, "aaaaaaaaa"), (6, "é中\U0001f600 one two three four five six")], "passage_id long, text string")
    both = [overlap.scored_pairs(verses, passages, least=0.01, max_windows=n).toPandas() for n in (0, 1000)]
    assert rows(both[0]) == rows(both[1])
    assert {(r.verse_id, r.passage_id) for r in both[0].itertuples()} >= {(1, 1), (1, 2), (2, 3), (7, 6)}
    best = [overlap.scored_pairs(verses, passages, least=0.01, best=True, max_windows=n).toPandas() for n in (0, 1000)]
    assert rows(best[0]) == rows(best[1]) and len(best[0]) == len(set(best[0].verse_id))


def test_lists_of_entries(spark):
    assert scans.parse_list(" 7-9, 3,,12 ") == [(3, 3), (7, 9), (12, 12)]
    for bad in ("x", "1-", "3-y"):
        with pytest.raises(ValueError):
            scans.parse_list(bad)
    entries = spark.range(1, 11).withColumnRenamed("id", "n")
    assert [r[0] for r in scans.select_entries(entries, "n", "9, 2-4, 3").collect()] == [2, 3, 3, 4, 9]
    assert [r[0] for r in scans.select_entries(entries, "n", queue=F.col("n") > 8).collect()] == [9, 10]
    with pytest.raises(LookupError, match="no such entry: 11, 12"):
        scans.select_entries(entries, "n", "10-12")


def test_a_file_without_header_is_rejected(spark):
    table = spark.createDataFrame([("h\n---\nbody\n---\nmore",)], "t string")
    assert table.select(T.body_of(F.col("t"))).first()[0] == "body\n---\nmore"
    with pytest.raises(Exception, match="no header separator"):
        table.select(T.body_of(F.lit("no separator here"))).collect()


def test_mixed_versions_have_no_set_hash(spark):
    table = spark.createDataFrame([(1, 1, "a", "v"), (1, 2, "b", "v"), (2, 1, "a", "v"), (2, 2, "b", "w"), (3, 1, "a", None)], "g int, n int, h string, v string")
    got = {r["g"]: (r["error"], r["set_hash"] is None) for r in verify.versioned_set_hash(table, ["g"], "n", "h", "v").collect()}
    assert got == {1: (None, False), 2: ("mixed_versions", True), 3: ("no_version", True)}


def test_digest_has_provenance_and_a_stable_body(spark):
    table = spark.createDataFrame([(1, 2, 0.1, "uncorroborated"), (2, 9, 0.9, "corroborated"), (3, 0, 0.0, "uncorroborated")], "anchor int, run int, coverage double, verdict string")
    one = snapshots.provenance_digest("T", {"source": "s", "at": "1"}, table)
    two = snapshots.provenance_digest("T", {"source": "s", "at": "2"}, table)
    assert one != two and one.split("\n---\n", 1)[1] == two.split("\n---\n", 1)[1]
    assert one.startswith("at: 1\nsource: s\n") and one.index("| 3 | 0 |") < one.index("| 1 | 2 |") and "| 2 | 9 |" not in one
    assert "| 2 | 9 |" in snapshots.provenance_digest("T", {}, table, "2") and "- uncorroborated: 2" in one


def test_manifest_text_and_file_hashes(spark, tmp_path):
    rows_ = spark.createDataFrame([(2, "b"), (1, "é")], "ordinal int, text string")
    text = snapshots.manifest_json(rows_)
    assert text == snapshots.manifest_json(rows_.orderBy("text")) and text.index('"ordinal": 1') < text.index('"ordinal": 2') and "é" in text
    (tmp_path / "raw.txt").write_text("abc")
    found = tables.file_hashes(spark, str(tmp_path)).first()
    assert found["path"].endswith("raw.txt") and found["content_hash"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tables.raw_text_path("/root", "a/b") == "/root/a/b" and tables.raw_text_path("/root", "/c") == "/c"


def test_keys_by_position_and_editions(spark, tmp_path):
    records = spark.createDataFrame([(1, "4:1"), (2, "4:3"), (3, None)], "position int, key string")
    assert [r["position"] for r in tables.positional_mismatches(records, 4).orderBy("position").collect()] == [2, 3]
    (tmp_path / "e.json").write_text('[{"id": 2, "name": "b"}, {"id": 1, "name": "a"}]')
    assert [r["id"] for r in tables.read_editions(spark, str(tmp_path / "e.json")).collect()] == [1, 2]
    assert tables.read_editions(spark, str(tmp_path / "e.json"), 2).first()["name"] == "b"


def test_a_whole_ingest(spark):
    """Twice: the second run reuses what is stored, embeds what is new and lets go what the source no longer gives."""
    section = "document_id string, group_id int, doc_group_id int, source_id string, source_version string, ordinal int, start int, end int, mapping_type string, text string"
    make = lambda texts: spark.createDataFrame([("d", 1, 1, s, "v", i, i + 1, i + 1, "single_ayah", t) for s in ("good", "closed") for i, t in enumerate(texts)], section)
    sources = spark.createDataFrame([("good", "verified", "cleared", None, None), ("closed", "verified", "restricted", None, None)], "id string, verification_status string, licensing_status string, ingestion_status string, ingested_at timestamp")
    stored = spark.createDataFrame([], "id string, source_id string, source_version string, group_id int, start int, end int, mapping_type string, text string, content_hash string, model string, embedding array<double>, created_at timestamp, updated_at timestamp")
    mappings = chunking.chunk_anchor_map(stored)
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    one = chunking.ingest_all(make(["first", "second"]), sources, stored, mappings, embed, "m", 2, at(1))
    chunks = spark.createDataFrame(one["chunks"].collect(), stored.schema)
    maps = spark.createDataFrame(one["mappings"].collect(), mappings.schema)
    assert {(r["source_id"], r["text"]) for r in chunks.collect()} == {("good", "first"), ("good", "second")} and maps.count() == 2
    assert {r["id"]: r["ingestion_status"] for r in one["sources"].collect()} == {"good": "ingested", "closed": None}
    refuse = lambda texts: [[float(len(t)), 1.0] for t in texts if t != "first"]  # noqa: E731  a stored chunk must not be embedded again
    two = chunking.ingest_all(make(["first", "third"]), sources, chunks, maps, refuse, "m", 2, at(2))
    got = {r["text"]: (r["embedding"], r["created_at"].day, r["updated_at"].day) for r in two["chunks"].collect()}
    assert got == {"first": ([5.0, 1.0], 1, 2), "third": ([5.0, 1.0], 2, 2)}
    assert {r["chunk_id"] for r in two["mappings"].collect()} == {r["id"] for r in two["chunks"].collect()}
    report = two["report"].first()
    assert (report["total"], report["reused"], report["pending"], report["stale"]) == (2, 1, 1, 1)
    with pytest.raises(ValueError, match="bad range"):
        bad = make(["x"]).withColumn("end", F.lit(9))
        chunking.ingest_all(bad, sources, stored, mappings, embed, "m", 2, at(1))


def test_a_failing_embedder_names_its_batch(spark):
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string").coalesce(1)

    def broken(texts):
        raise RuntimeError("busy")

    with pytest.raises(Exception, match="ids a to b: busy"):
        chunking.embed_batches(table, broken, "m", 2).collect()


def test_set_hash_of_runs_nulls_ties_and_many_batches(spark):
    import hashlib
    from collections import defaultdict

    rows = [(g, i % 900, f"v{i * 7919 % 1000}") for i in range(5000) for g in ("a", "b") if g == "a" or i % 5 == 0]
    rows += [(None, 1, "x"), (None, None, "y"), ("c", 2, None), ("c", 10, "é"), ("c", 9, "e"), ("d", None, None)]
    table = spark.createDataFrame(rows, "g string, n int, h string").repartition(7)
    want = defaultdict(list)
    for g, n, h in rows:
        want[g].append((n, h))
    plain = {}
    for g, own in want.items():
        lines = sorted(x for x in own if None not in x)
        plain[g] = (hashlib.sha256("".join(f"{n}\t{h}\n" for n, h in lines).encode()).hexdigest(), len(own))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for records in ("10000", "700", "1"):  # a group in one batch, in several, in one a row
        spark.conf.set(name, records)
        try:
            got = {r["g"]: (r["set_hash"], r["n"]) for r in verify.set_hash(table, ["g"], "n", "h").collect()}
        finally:
            spark.conf.unset(name)
        assert got == plain
    assert verify.set_hash(table.where("false"), ["g"], "n", "h").count() == 0
