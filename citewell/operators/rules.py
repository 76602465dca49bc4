"""Decisions over single rows as ordered CASE expressions: drafts, references, reachability, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citewell.functions import text as T
from citewell.functions.overlap import bound
from citewell.operators.contract import json_value, kind_of, schema_of, violations

MAX_DRAFT = 2000
#: Enumerations and markers.
PLACEHOLDER_HOSTS = ("example.com", "placeholder", "localhost")
SECTION_TYPES = ("classification", "context", "themes", "stories", "asbab")
DECISIONS = {"approve": "published", "edit_approve": "published", "reject": "rejected", "escalate": "pending"}


def arabic_letters(text: Column) -> Column:
    """Characters of the Arabic script, annotation marks included."""
    return F.regexp_count(text, F.lit(r"\p{IsArabic}"))


def latin_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def script_reason(style: Column, text: Column) -> Column:
    """Null if the text is in the script of its style; else why not."""
    arabic, latin = arabic_letters(text), latin_letters(text)
    return (
        F.when(F.endswith(style, F.lit("_ar")), F.when(arabic == 0, "no_arabic").when(arabic < latin, "mostly_latin"))
        .when(style == "en", F.when(latin == 0, "no_latin").when(latin < arabic, "mostly_arabic"))
        .otherwise("unknown_style")
    )


def draft_reason(content: Column, n_claims: Column, n_refs: Column, requires_review: Column, style: Column, limit: int = MAX_DRAFT) -> Column:
    """The first check that a draft fails, or null."""
    return (
        F.when(F.coalesce(content, F.lit("")) == "", "empty")
        .when(F.length(content) > limit, "too_long")
        .when((n_claims > 0) & (n_refs == 0), "claims_without_refs")
        .when(~F.coalesce(requires_review, F.lit(False)), "review_not_required")
        .otherwise(script_reason(style, content))
    )


def is_placeholder(url: Column) -> Column:
    low = F.lower(url)
    found = F.lit(False)
    for host in PLACEHOLDER_HOSTS:
        found = found | F.contains(low, F.lit(host))
    return found


def is_audio(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return F.startswith(low, F.lit("audio/")) | F.contains(low, F.lit("mpeg")) | F.contains(low, F.lit("mp3"))


def reachability(head_status: Column, content_type: Column, get_status: Column) -> Column:
    """reachable, unreachable or error, from recorded statuses; a null status is a transport error.

    A HEAD of 200 with audio decides; 404, 405, or no answer falls back to a ranged GET, whose 200 and 206 count.
    """
    fallback = F.when(get_status.isNull(), "error").when(get_status.isin(200, 206), "reachable").otherwise("unreachable")
    return (
        F.when((head_status == 200) & is_audio(content_type), "reachable")
        .when(head_status.isNull() | head_status.isin(404, 405), fallback)
        .otherwise("unreachable")
    )


def retryable(status: Column, variant: str = "embedding") -> Column:
    """embedding: 429 and all 5xx; generation: 429 and 503; no status (transport error) in both."""
    server = status.between(500, 599) if variant == "embedding" else status == 503
    return F.coalesce((status == 429) | server, F.lit(True))


def status_class(status: Column) -> Column:
    """Error class of an embedding answer."""
    return (
        F.when(status.isNull(), "transport").when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status == 413, "too_large")
        .when(status.isin(401, 403), "unauthorized").when(status.between(500, 599), "server").otherwise("rejected")
    )


def provider(url: Column) -> Column:
    """Null for a host that is not supported."""
    return F.when(F.contains(F.lower(url), F.lit("generativelanguage.googleapis.com")), "gemini")


# ---------------------------------------------------------------- references


def resolve_positions(refs: Column, ids: Column) -> Column:
    """struct(resolved, warnings): refs are positions from 1 into ids, as text; repeats are kept, others warned of."""
    at = lambda r: r.try_cast("int")
    good = lambda r: F.coalesce((at(r) >= 1) & (at(r) <= F.size(ids)), F.lit(False))
    resolved = F.transform(F.filter(refs, good), lambda r: F.try_element_at(ids, F.greatest(at(r), F.lit(1))))
    warnings = F.transform(F.filter(refs, lambda r: ~good(r)), lambda r: F.concat(F.lit("unresolved reference "), r))
    return F.struct(resolved.alias("resolved"), warnings.alias("warnings"))


def resolve_claim_refs(refs: Column, ids: Column) -> Column:
    """Distinct ids of one claim: a number is a position, anything else must be a known id; null entries do not resolve."""
    one = lambda r: F.when(r.try_cast("int").isNotNull(), F.when(r.try_cast("int").between(1, F.size(ids)), F.try_element_at(ids, F.greatest(r.try_cast("int"), F.lit(1))))).when(F.array_contains(ids, r), r)
    return F.array_distinct(F.transform(refs, one))


def claims_valid(claims: Column, ids: Column) -> Column:
    """Every claim has text and at least one reference; all resolve; none repeats within a claim."""
    return F.forall(
        claims,
        lambda c: ~T.is_blank(c["text"]) & (F.size(c["source_refs"]) > 0) & ~F.exists(resolve_claim_refs(c["source_refs"], ids), lambda r: r.isNull()) & (F.size(resolve_claim_refs(c["source_refs"], ids)) == F.size(c["source_refs"])),
    )


def section_content(claims: Column) -> Column:
    return F.array_join(F.transform(claims, lambda c: c["text"]), " ")


def section_refs(claims: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(claims, lambda c: c["source_refs"])))


def evidence_violations(evidence: Column) -> Column:
    """array<string>: blank fields and repeated ids of array<struct<id, source_id, source_version, text>>."""
    blank = F.exists(evidence, lambda e: T.is_blank(e["id"]) | T.is_blank(e["source_id"]) | T.is_blank(e["source_version"]) | T.is_blank(e["text"]))
    ids = F.transform(evidence, lambda e: e["id"])
    return F.array_compact(F.array(F.when(F.size(evidence) <= 0, "no evidence"), F.when(blank, "blank field"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated id")))


def introduction_reason(sections: Column, requires_review: Column, style: Column, ids: Column) -> Column:
    """The first check that an introduction draft fails, or null. sections: type, title, claims."""
    script = F.array_join(F.transform(sections, lambda s: section_content(s["claims"])), " ")
    return (
        F.when(F.size(sections) <= 0, "no_sections")
        .when(F.exists(sections, lambda s: ~F.coalesce(s["type"].isin(*SECTION_TYPES), F.lit(False))), "section_type")
        .when(F.exists(sections, lambda s: T.is_blank(s["title"])), "section_title")
        .when(F.exists(sections, lambda s: F.size(s["claims"]) <= 0), "section_claims")
        .when(F.exists(sections, lambda s: ~claims_valid(s["claims"], ids)), "claims")
        .when(~F.coalesce(requires_review, F.lit(False)), "review_not_required")
        .otherwise(script_reason(style, script))
    )


def _structured(raw: Column, schema: str) -> Column:
    """struct(value, error) of a text that must be one JSON object of this schema and nothing else."""

    def judged(t: Column, v: Column) -> Column:
        return F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "empty").when(v.isNull() | (kind_of(v) != "object"), "malformed").when(F.size(violations(v, schema_of(schema))) > 0, "malformed")

    def told(t: Column) -> Column:
        error = bound(json_value(t), lambda v: judged(t, v))
        return bound(error, lambda e: F.struct(F.when(e.isNull(), F.from_json(t, schema)).alias("value"), e.alias("error")))

    return bound(raw, told)


def decode_output(raw: Column, schema: str) -> Column:
    """struct(value, error): a model's JSON output, one object whose fields have the schema's types.

    error: empty, blocked (a provider's refusal in place of an output), malformed (anything else but one such object:
    lists, strings, text before or after it, fields of other types), or null.
    """

    def told(t: Column) -> Column:
        refused = F.coalesce(F.get_json_object(t, "$.promptFeedback.blockReason"), F.lit("")) != ""
        error = lambda out: F.when(refused, "blocked").otherwise(out["error"])
        return bound(_structured(t, schema), lambda out: bound(error(out), lambda e: F.struct(F.when(e.isNull(), out["value"]).alias("value"), e.alias("error"))))

    return bound(raw, told)


def decode_answer(body: Column, schema: str) -> Column:
    """struct(value, error, finish): a provider's answer around the model's output, in the order of its checks.

    error: malformed; error: <message>; blocked: <reason>; no_candidates; no_parts; malformed_output (the first part of the
    first candidate is not one JSON object of the schema); empty_content (neither content nor sections); or null.
    """
    fields = {f.name for f in StructType.fromDDL(schema)}

    def told(v: Column, out: Column) -> Column:
        at = lambda path: F.try_variant_get(v, path, "string")
        many = lambda path: F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.lit(0))
        filled = F.lit("content" not in fields and "sections" not in fields)
        filled = filled | F.coalesce(out["value"]["content"] != "", F.lit(False)) if "content" in fields else filled
        filled = filled | F.coalesce(F.size(out["value"]["sections"]) > 0, F.lit(False)) if "sections" in fields else filled
        error = (
            F.when(v.isNull() | ~kind_of(v).isin("object", "null"), "malformed")
            .when(F.coalesce(at("$.error.message"), F.lit("")) != "", F.concat(F.lit("error: "), at("$.error.message")))
            .when(F.coalesce(at("$.promptFeedback.blockReason"), F.lit("")) != "", F.concat(F.lit("blocked: "), at("$.promptFeedback.blockReason")))
            .when(many("$.candidates") < 1, "no_candidates")
            .when(many("$.candidates[0].content.parts") < 1, "no_parts")
            .when(out["error"].isNotNull(), "malformed_output")
            .when(~filled, "empty_content")
        )
        return bound(error, lambda e: F.struct(F.when(e.isNull(), out["value"]).alias("value"), e.alias("error"), at("$.candidates[0].finishReason").alias("finish")))

    return bound(json_value(body), lambda v: bound(_structured(F.try_variant_get(v, "$.candidates[0].content.parts[0].text", "string"), schema), lambda out: told(v, out)))


def request_body(system: Column, evidence: Column) -> Column:
    """JSON of a generation request: the brief, and evidence as numbered lines."""
    lines = F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e)), "\n")
    return F.to_json(F.struct(system.alias("system"), lines.alias("evidence")))


# ---------------------------------------------------------------- workflow


def decision_status(decision: Column) -> Column:
    """Status after a decision; null for an unknown one."""
    out = None
    for word, status in DECISIONS.items():
        out = F.when(decision == word, status) if out is None else out.when(decision == word, status)
    return out


def rerun_action(status: Column, run_id: Column, prompt: Column, this_run: Column, this_prompt: Column) -> Column:
    """generate without a row; skip a decided row or one of this run and prompt; else regenerate."""
    return (
        F.when(status.isNull(), "generate").when(status.isin("published", "rejected"), "skip_decided")
        .when(run_id.eqNullSafe(this_run) & prompt.eqNullSafe(this_prompt), "skip_same").otherwise("regenerate")
    )


def attempt_outcome(has_evidence: Column, grounded: Column, intact: Column, dry_run: Column, provider_ok: Column, draft: Column, written: Column) -> Column:
    """Outcome of one generation attempt from its stage flags, in the order in which stages run."""
    return (
        F.when(~has_evidence, "insufficient_evidence").when(~grounded, "invalid_grounding").when(~intact, "corpus_mismatch").when(dry_run, "dry_run")
        .when(~provider_ok, "provider_error").when(draft.isNotNull(), "validation_failed").when(~written, "write_failed").otherwise("pending")
    )


def introduction_decision(decision: Column, checklist: Column, publishable: Column) -> Column:
    """Status after a decision on an introduction; approval needs all seven checks and a publishable row."""
    all_checked = (F.size(checklist) == 7) & F.forall(checklist, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(decision == "approve", F.when(~all_checked, "error_checklist").when(~publishable, "error_not_publishable").otherwise("published")).when(decision == "reject", "rejected").when(decision == "escalate", "pending").otherwise("error_decision")


def reviewable(missing: Column, mismatch: Column, checklist: Column | None = None) -> Column:
    """Whether approval may be offered: all references resolve, grounding is current, the four checks are set."""
    ok = (F.size(missing) == 0) & ~mismatch
    return ok if checklist is None else ok & (F.size(checklist) == 4) & F.forall(checklist, lambda x: F.coalesce(x, F.lit(False)))


def grounding_violation(start: Column, end: Column, anchor: Column, verified: Column) -> Column:
    """Why a chunk may not ground an anchor (fails closed on unanchored chunks), or null."""
    return F.when(~F.coalesce(verified, F.lit(False)), "unverified").when(~F.coalesce((start > 0) & (start <= anchor) & (anchor <= end), F.lit(False)), "does_not_cover")
