"""Introduction runs: one call a request, checks in order, resolved references, rows that are decided."""

import json

import pytest
from pyspark.sql import functions as F

from citewell.operators import generation, introduction as I
from citewell.sources import commits as K

EVIDENCE = "group_id long, evidence array<struct<id:string,source_id:string,source_version:string,text:string>>"
GOOD = [("e1", "s", "v2", "first"), ("e2", "s", "v1", "second"), ("e3", "s", "v3", "third")]


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def claim(text="a claim", *refs):
    return {"text": text, "source_refs": list(refs)}


def output(claims=None, reports=(), review=True, **section):
    return {"sections": [{"type": "context", "title": "t", "claims": claims if claims is not None else [claim("a claim", "1")]} | section], "differing_reports": list(reports), "requires_review": review}


@pytest.mark.parametrize(
    ("out", "problem"),
    [
        (output(), None), (output([claim("x", "e1", "1", " 2 ")]), None), ({"sections": [], "requires_review": True}, "no sections"), (output(review=False), "review not required"), (output(review=None), "review not required"),
        (output(type="other"), "section 0 needs an allowed type, title, and claims"), (output(title=" "), "section 0 needs an allowed type, title, and claims"), (output([]), "section 0 needs an allowed type, title, and claims"),
        (output([claim("x", "1"), claim(" ", "1")]), "section 0 claim 1: claim text is empty"), (output([claim("x")]), "section 0 claim 0: claim has no source_refs"), (output([claim("x", "4")]), "section 0 claim 0: source_ref does not resolve"),
        (output([claim("x", "e9")]), "section 0 claim 0: source_ref does not resolve"), (output([claim("x", "0")]), "section 0 claim 0: source_ref does not resolve"), (output([claim("x", "1", "1")]), "section 0 claim 0: duplicate source_ref"),
        (output(reports=[claim("x", "1"), claim("y", "7")]), "differing report 1: source_ref does not resolve"), (output([claim("نص عربي", "1")]), "no_latin"),
    ],
)
def test_checks_in_order(spark, out, problem):
    row = spark.createDataFrame([(1, GOOD)], EVIDENCE).withColumn("out", F.from_json(F.lit(json.dumps(out)), I.OUTPUT))
    assert row.select(I.draft_problem(F.col("out"), F.col("evidence"), F.lit("en"))).first()[0] == problem


def test_each_request_is_asked_once_and_references_resolve(spark, tmp_path):
    log, calls = K.Commits(spark, f"file://{tmp_path}/store"), tmp_path / "calls"

    def generator(request):
        with open(calls, "a", encoding="utf-8") as f:
            f.write("x")
        if "broken" in request and len(calls.read_text()) < 99:
            raise generation.ProviderError(400, "no")
        return json.dumps(output([claim("one", "2", "e1", "1"), claim("two", "3")], [claim("other", "e3")]))

    rows = spark.createDataFrame([(1, GOOD), (2, GOOD), (3, []), (4, [("e", "s", "v", "broken")]), (5, [("e", "", "v", "x")])], EVIDENCE)
    done, counts = I.run(log, rows, "en", "beginner", "brief", generator, "m", now(), 4)
    assert {r["group_id"]: r["outcome"] for r in done.collect()} == {1: "pending", 2: "pending", 3: "insufficient_evidence", 4: "provider_error", 5: "insufficient_evidence"}
    assert counts["calls"] == 2 and len(calls.read_text()) == 2  # groups 1 and 2 are one request
    saved = {r["group_id"]: r for r in log.read("introductions").collect()}
    assert set(saved) == {1, 2}
    one = saved[1]
    assert one["sections"][0]["content"] == "one two" and one["sections"][0]["source_refs"] == ["e2", "e1", "e3"] and one["sections"][0]["claims"][0]["source_refs"] == ["e2", "e1"]
    assert one["source_refs"] == ["e2", "e1", "e3"] and one["source_version_snapshot"] == "v1+v2+v3" and one["review_status"] == "pending" and one["prompt_version"].startswith("sys-")
    _, again = I.run(log, rows, "en", "beginner", "brief", generator, "m", now(), 4)
    assert again["calls"] == 1  # only the one that failed


def test_decided_rows_stay(spark, tmp_path):
    log = K.Commits(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, GOOD), (2, GOOD)], EVIDENCE)
    generator = lambda _: json.dumps(output())
    I.run(log, rows, "en", "beginner", "brief", generator, "m", now(), 4)
    published = log.read("introductions").where("group_id = 1").withColumn("review_status", F.lit("published")).drop("created_at", "updated_at")
    log.commit(log.state()[0], [K.upsert(log, "introductions", published, I.KEY, now(), I.INTRODUCTIONS, 4)])
    done, counts = I.run(log, rows, "en", "advanced", "brief", generator, "m2", now(), 4)
    assert {r["group_id"]: r["outcome"] for r in done.collect()} == {1: "decided", 2: "pending"} and counts["calls"] == 0
    assert {r["group_id"]: (r["review_status"], r["level"], r["model_version"]) for r in log.read("introductions").collect()} == {1: ("published", "beginner", "m"), 2: ("pending", "advanced", "m2")}


def test_unsupported_style_and_level(spark, tmp_path):
    log = K.Commits(spark, f"file://{tmp_path}/store")
    for style, level in (("fr", "beginner"), ("en", " ")):
        with pytest.raises(ValueError, match="style"):
            I.run(log, spark.createDataFrame([], EVIDENCE), style, level, "b", None, "m", now())


def test_evidence_is_verified_pinned_and_ordered(spark):
    chunks = spark.createDataFrame([("b", 1, 2, "s", "v1", "t", True), ("a", 1, 2, "s", "v1", "t", True), ("c", 1, 1, "s", "v1", "t", True), ("d", 1, 1, "s", "v0", "t", True), ("e", 1, 1, "s", "v1", "t", False), ("f", 2, 1, "u", "v1", "t", True)], "id string, group_id long, start int, source_id string, source_version string, text string, verified boolean")
    sources = spark.createDataFrame([("s", "v1", True), ("u", "v1", False)], "id string, version_id string, usable boolean")
    got = {r["group_id"]: [e["id"] for e in r["evidence"]] for r in I.load_evidence(chunks, sources).collect()}
    assert got == {1: ["c", "a", "b"]}
