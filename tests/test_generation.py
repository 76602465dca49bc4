from __future__ import annotations

import json

from pyspark.sql import functions as F

from citewell.operators import generation, registry, scans
from citewell.sources import tables


def test_retry_counts():
    log = []

    def flaky():
        log.append(1)
        if len(log) < 3:
            raise generation.ProviderError(503)
        return "x"

    def refused():
        raise generation.ProviderError(400)

    assert generation.with_retry(flaky) == ("x", None, 3)
    assert generation.with_retry(refused)[2] == 1
    log.clear()
    assert generation.with_retry(lambda: (_ for _ in ()).throw(generation.ProviderError(429)), retries=2)[2] == 3


def _generator(request):
    body = json.loads(request)
    if "blocked" in body["evidence"]:
        raise generation.ProviderError(400, "no")
    return json.dumps({"content": "some text", "source_refs": ["2", "1", "9", "2"], "claims": ["c"], "requires_review": "short" not in body["evidence"]})


def test_drafts(spark):
    e = "item_id int, evidence array<struct<id:string,source_id:string,source_version:string,text:string>>"
    pair = lambda word: [("a", "s", "v2", word), ("b", "s", "v1", "more")]
    rows = spark.createDataFrame([(1, pair("good")), (2, pair("blocked")), (3, []), (4, pair("short"))], e)
    got = {r["item_id"]: r for r in generation.drafts(rows, "brief", _generator).collect()}
    assert got[1]["outcome"] == "pending" and got[1]["source_refs"] == ["b", "a"] and got[1]["snapshot"] == "v1+v2" and len(got[1]["warnings"]) == 1
    assert (got[2]["outcome"], got[2]["reason"]) == ("provider_error", "no")
    assert got[3]["outcome"] == "insufficient_evidence" and (got[4]["outcome"], got[4]["reason"]) == ("validation_failed", "review_not_required")
    assert generation.prompts(spark, {"t": "brief"}).first()["prompt_version"].startswith("sys-")


def test_forbidden_fields(spark):
    df = spark.createDataFrame([], "a int, b array<struct<secret:int,c:map<string,struct<secret:int>>>>")
    assert scans.forbidden(df, {"secret"}) == ["b.secret", "b.c.secret"]


def test_registry_record_replaces_its_rows(spark):
    names = ("sources", "source_versions", "documents_registry")
    empty = {n: spark.createDataFrame([], tables.SCHEMAS[n]) for n in names}
    record = spark.range(1).select(F.lit("s").alias("id"), *[F.lit("x").alias(c) for c in ("title", "author", "language", "licensing_status", "verification_status", "edition", "methodology_classification", "raw_text_ref")], F.lit(1).alias("authority_tier"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit("v").alias("version_id"), F.lit("d").alias("document_id"), F.lit("tafsir").alias("content_type"), F.lit(1).alias("group_id"), F.lit(2).alias("anchor_count"))
    now = F.lit("2024-01-01").cast("timestamp")
    once = registry.apply_record(empty, record, "h1", now)
    twice = registry.apply_record(once, record, "h2", now)
    assert [twice[n].count() for n in names] == [1, 1, 1] and twice["source_versions"].first()["content_hash"] == "h2"


def test_secondary_source(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"number":1,"text":"بسم الله الرحمن الرحيم قل هو"},{"number":2,"text":"x"}]')
    assert {(r["anchor"], r["text"]) for r in tables.read_secondary(spark, str(tmp_path / "s.json")).collect()} == {(1, "قل هو"), (2, "x")}
