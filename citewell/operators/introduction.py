"""Introductions of groups as one run: evidence, one question a different request, checks, resolved references, drafts.

The answers are a table of their own, keyed by the hash of the request, and are committed before anything is made of
them. A request that has an answer is not asked again, however often a run is repeated or dies after that commit.
All that follows an answer is one plan of column expressions: decoding against its schema, the checks in order, sections
and claims with their references resolved, the snapshot of versions. Drafts replace only what nobody has decided on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.operators import generation, rules
from citewell.operators.registry import snapshot_of
from citewell.sources import commits as K
from citewell.sources.shared import keep, scratch

CLAIMS = "array<struct<text:string,source_refs:array<string>>>"
OUTPUT = f"sections array<struct<type:string,title:string,claims:{CLAIMS}>>, differing_reports {CLAIMS}, requires_review boolean"
ANSWERS = "request_hash string, raw string, calls int, created_at timestamp, updated_at timestamp"
SECTIONS = f"array<struct<type:string,title:string,content:string,source_refs:array<string>,claims:{CLAIMS}>>"
INTRODUCTIONS = f"group_id long, style string, level string, sections {SECTIONS}, source_refs array<string>, differing_reports {CLAIMS}, review_status string, source_version_snapshot string, prompt_version string, model_version string, created_at timestamp, updated_at timestamp"
LANGUAGES = {"simplified_ar": "ar", "egyptian_ar": "ar", "en": "en"}
KEY = ["group_id", "style"]


def load_evidence(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """group_id, evidence: verified chunks of the pinned version of approved sources, by start and id.

    chunks: id, group_id, start, source_id, source_version, text, verified; sources: id, version_id, usable. A group's evidence is
    one request's content, so it is one row by definition.
    """
    pins = sources.where(F.coalesce("usable", F.lit(False))).select(F.col("id").alias("source_id"), F.col("version_id").alias("source_version"))
    good = chunks.where(F.coalesce("verified", F.lit(False))).join(pins, ["source_id", "source_version"], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("start", "id", "source_id", "source_version", "text")))
    return good.groupBy("group_id").agg(F.transform(listed, lambda e: F.struct(e["id"].alias("id"), e["source_id"].alias("source_id"), e["source_version"].alias("source_version"), e["text"].alias("text"))).alias("evidence"))


def _position(ref: Column) -> Column:
    return F.trim(ref).try_cast("int")


def resolve(ref: Column, ids: Column) -> Column:
    """The id that a reference means: a number is a position from 1, anything else must be one of the ids; else null."""
    n = _position(ref)
    return F.when(n.isNotNull(), F.when(n.between(1, F.size(ids)), F.try_element_at(ids, F.greatest(n, F.lit(1))))).when(F.array_contains(ids, ref), ref)


def claim_problem(claim: Column, ids: Column) -> Column:
    """The first check that a claim fails, or null: text, references, that each resolves, that none is given twice."""
    refs = claim["source_refs"]
    lost = F.exists(refs, lambda r: r.isNull() | resolve(r, ids).isNull())
    return (
        F.when(T.is_blank(claim["text"]), "claim text is empty").when(F.coalesce(F.size(refs), F.lit(0)) < 1, "claim has no source_refs").when(lost, "source_ref does not resolve")
        .when(F.size(F.array_distinct(refs)) < F.size(refs), "duplicate source_ref")
    )


def _claims_problem(claims: Column, ids: Column, where: Column) -> Column:
    """`where claim i: what` of the first bad claim, or null."""
    each = F.transform(F.coalesce(claims, F.array().cast(CLAIMS)), lambda c, i: F.concat(where, F.lit(" "), i.cast("string"), F.lit(": "), claim_problem(c, ids)))
    return F.try_element_at(F.array_compact(each), F.lit(1))


def draft_problem(output: Column, evidence: Column, style: Column) -> Column:
    """The first check that an output fails, in order: sections, review, their type, title and claims, reports, script.

    evidence: array of structs with id, in the order of the request.
    """
    ids = F.transform(evidence, lambda e: e["id"])
    sections, reports = output["sections"], F.coalesce(output["differing_reports"], F.array().cast(CLAIMS))

    def section(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("section "), i.cast("string"))
        whole = F.coalesce(s["type"].isin(*rules.SECTION_TYPES), F.lit(False)) & ~T.is_blank(s["title"]) & (F.coalesce(F.size(s["claims"]), F.lit(0)) > 0)
        return F.when(~whole, F.concat(at, F.lit(" needs an allowed type, title, and claims"))).otherwise(_claims_problem(s["claims"], ids, F.concat(at, F.lit(" claim"))))

    texts = F.concat(F.flatten(F.transform(sections, lambda s: F.transform(s["claims"], lambda c: c["text"]))), F.transform(reports, lambda c: c["text"]))
    return (
        F.when(F.coalesce(F.size(sections), F.lit(0)) < 1, "no sections").when(~F.coalesce(output["requires_review"], F.lit(False)), "review not required")
        .otherwise(F.coalesce(F.try_element_at(F.array_compact(F.transform(sections, section)), F.lit(1)), _claims_problem(reports, ids, F.lit("differing report")), rules.script_reason(style, F.array_join(texts, " "))))
    )


def _distinct(refs: Column) -> Column:
    return F.array_distinct(F.filter(refs, lambda r: r.isNotNull() & (r != "")))


def resolved_claims(claims: Column, ids: Column) -> Column:
    one = lambda c: F.struct(c["text"].alias("text"), _distinct(F.transform(c["source_refs"], lambda r: resolve(r, ids))).alias("source_refs"))
    return F.transform(F.coalesce(claims, F.array().cast(CLAIMS)), one)


def _refs(claims: Column) -> Column:
    return _distinct(F.flatten(F.transform(claims, lambda c: c["source_refs"])))


def resolved_sections(sections: Column, ids: Column) -> Column:
    """Sections with their claims resolved, their content (claims joined by spaces) and distinct references."""

    def whole(s: Column) -> Column:
        claims = resolved_claims(s["claims"], ids)
        return F.struct(s["type"].alias("type"), s["title"].alias("title"), F.array_join(F.transform(claims, lambda c: c["text"]), " ").alias("content"), _refs(claims).alias("source_refs"), claims.alias("claims"))

    return F.transform(sections, whole)


def ask(commits: K.Commits, requests: DataFrame, generator: Callable[[str], str], now: Column, buckets: int = 16, retries: int = 3) -> tuple[DataFrame, int]:
    """(request_hash, raw, error of every different request; calls made): what has no answer yet is asked, once.

    requests: request_hash, request. Answers are committed before this returns; a failed call has no answer and is asked
    again by the next run.
    """
    base = commits.state()[0]
    known = commits.read("answers", ANSWERS, K.touched_buckets(requests, ["request_hash"], commits.buckets("answers", buckets)), base).select("request_hash", F.col("raw").alias("_known"))
    open_ = requests.join(known, "request_hash", "left_anti").dropDuplicates(["request_hash"]).select(F.col("request_hash").alias("item_id"), "request")
    given = keep(generation.generate(open_, generator, retries), "asked")  # asked once, whatever comes after
    calls = given.agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
    new = given.where("error is null").select(F.col("item_id").alias("request_hash"), "raw", "calls")
    if calls:
        commits.commit(base, [K.upsert(commits, "answers", new, ["request_hash"], now, ANSWERS, buckets, base)])
    told = known.select("request_hash", F.col("_known").alias("raw"), F.lit(None).cast("string").alias("error"))
    return told.unionByName(given.select(F.col("item_id").alias("request_hash"), "raw", "error")), int(calls)


def run(commits: K.Commits, evidence: DataFrame, style: str, level: str, brief: str, generator: Callable[[str], str], model: str, now: Column, buckets: int = 16, retries: int = 3) -> tuple[DataFrame, dict[str, int]]:
    """Drafts of all groups, committed; (group_id, outcome, reason as a table, counts by outcome with the calls made).

    evidence: group_id, evidence (array<struct<id, source_id, source_version, text>> in order). outcome: insufficient_evidence,
    provider_error, invalid_output, invalid_draft, decided (a published or rejected row stays), pending (the draft is
    saved). An unsupported style or a blank level is an error.
    """
    if style not in LANGUAGES or not level.strip():
        raise ValueError(f"unsupported style {style!r} or no level")
    with scratch("introductions") as result:
        fine = F.size(rules.evidence_violations(F.col("evidence"))) == 0
        request = F.to_json(F.struct(F.lit("introduce").alias("task"), F.lit(LANGUAGES[style]).alias("language"), F.lit(style).alias("style"), rules.request_body(F.lit(brief), F.transform("evidence", lambda e: e["text"])).alias("body")))
        slim = F.transform("evidence", lambda e: F.struct(e["id"].alias("id"), e["source_version"].alias("source_version")))  # texts are in the request alone
        asked = keep(evidence.select(F.col("group_id").cast("long").alias("group_id"), slim.alias("evidence"), F.when(fine, request).alias("request")).withColumn("request_hash", T.content_hash(F.col("request"))), "requests")
        rows = asked.select("group_id", "evidence", "request_hash")
        answers, calls = ask(commits, asked.where("request is not null").select("request_hash", "request"), generator, now, buckets, retries)
        base = commits.state()[0]
        output = rules.decode_output(F.col("raw"), OUTPUT)
        told = keep(rows.join(answers, "request_hash", "left").withColumn("out", output).drop("raw"), "decoded")
        told = told.withColumn("problem", draft_problem(F.col("out.value"), F.col("evidence"), F.lit(style)))
        outcome = F.when(F.col("request_hash").isNull(), "insufficient_evidence").when(F.col("error").isNotNull(), "provider_error").when(F.col("out.error").isNotNull(), "invalid_output").when(F.col("problem").isNotNull(), "invalid_draft").otherwise("pending")
        reason = F.when(outcome == "provider_error", F.col("error")).when(outcome == "invalid_output", F.col("out.error")).when(outcome == "invalid_draft", F.col("problem"))
        stored = commits.read("introductions", INTRODUCTIONS, number=base).where(F.col("review_status").isin("published", "rejected") & (F.col("style") == style)).select("group_id", F.lit(True).alias("_decided"))
        ids = F.transform("evidence", lambda e: e["id"])
        judged = told.withColumns({"outcome": outcome, "reason": reason}).join(stored, "group_id", "left")
        judged = judged.withColumn("outcome", F.when((F.col("outcome") == "pending") & F.col("_decided"), "decided").otherwise(F.col("outcome")))
        made = judged.withColumns({"_s": resolved_sections(F.col("out.value.sections"), ids), "_d": resolved_claims(F.col("out.value.differing_reports"), ids)})
        refs = _distinct(F.concat(F.flatten(F.transform("_s", lambda s: s["source_refs"])), _refs(F.col("_d"))))
        made = keep(made.withColumn("_refs", refs), "judged")
        used = F.transform(F.filter("evidence", lambda e: F.array_contains(F.col("_refs"), e["id"])), lambda e: e["source_version"])
        drafts = made.where("outcome = 'pending'").select(
            "group_id", F.lit(style).alias("style"), F.lit(level).alias("level"), F.col("_s").cast(SECTIONS).alias("sections"), F.col("_refs").alias("source_refs"), F.col("_d").cast(CLAIMS).alias("differing_reports"),
            F.lit("pending").alias("review_status"), snapshot_of(used).alias("source_version_snapshot"), T.prompt_fingerprint(F.lit(brief)).alias("prompt_version"), F.lit(model).alias("model_version"),
        )
        commits.commit(base, [K.upsert(commits, "introductions", drafts, KEY, now, INTRODUCTIONS, buckets, base)])
        done = result(made.select("group_id", "outcome", "reason"))
    counts = {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}
    return done, counts | {"calls": calls}
