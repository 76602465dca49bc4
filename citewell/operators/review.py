"""The review queue, decisions and what may be published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.operators.incremental import usable
from citewell.operators.registry import evidence_with_pin, snapshot_of
from citewell.operators.rules import decision_status


def resolve_refs(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, evidence (array<struct<pos, chunk_id, source_id, source_version>> in cited order), missing (array).

    items: item_id, refs (array<string>). Blank references are skipped, repeats kept.
    """
    refs = items.select("item_id", F.posexplode_outer("refs").alias("pos", "chunk_id")).where(F.col("pos").isNull() | ~T.is_blank(F.col("chunk_id")))
    own = chunks.select("chunk_id", "source_id", "source_version")
    joined = refs.join(own, "chunk_id", "left")
    found = F.when(F.col("source_id").isNotNull(), F.struct("pos", "chunk_id", "source_id", "source_version"))
    lost = F.when(F.col("source_id").isNull() & F.col("chunk_id").isNotNull(), F.struct("pos", "chunk_id"))
    grouped = joined.groupBy("item_id").agg(F.array_sort(F.collect_list(found)).alias("evidence"), F.array_sort(F.collect_list(lost)).alias("_lost"))
    every = items.select("item_id").join(grouped, "item_id", "left")
    empty = F.array().cast(grouped.schema["evidence"].dataType)
    return every.select("item_id", F.coalesce("evidence", empty).alias("evidence"), F.coalesce(F.transform("_lost", lambda x: x["chunk_id"]), F.array().cast("array<string>")).alias("missing"))


def carried_citations(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, pos, chunk_id, source_id, source_version: the citations of items in their stored order; one that does not
    resolve is an error that names the item and the reference.

    items: item_id, refs (array<string>). Blank references are skipped, repeats kept.
    """
    resolved = resolve_refs(items, chunks)
    lost = F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(" cites a missing chunk: "), F.col("missing")[0])
    sure = F.when(F.size("missing") > 0, F.raise_error(lost)).otherwise(F.col("evidence"))
    return resolved.select("item_id", F.explode(sure).alias("e")).select("item_id", "e.*")


def range_text(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """item_id, text: the texts of anchors start..end of the item's group, one a line, blank ones left out."""
    wanted = items.where("start >= 1 and end >= start").select("item_id", "group_id", F.explode(F.sequence("start", "end")).alias("anchor"))
    lines = wanted.join(anchors, ["group_id", "anchor"]).where(~T.is_blank(F.col("text")))
    joined = lines.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return items.select("item_id").join(joined, "item_id", "left").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


def review_queue(items: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Queue rows in the order (group_id, start, item_id): evidence, missing, citation (title of the first evidence's
    source) and mismatch (the snapshot of the evidence differs from the item's).

    items: item_id, group_id, start, refs, snapshot.
    """
    resolved = resolve_refs(items, chunks)
    first = F.try_element_at(F.col("evidence"), F.lit(1))["source_id"]
    titled = resolved.withColumn("source_id", first).join(sources.select(F.col("id").alias("source_id"), "title"), "source_id", "left")
    now = snapshot_of(F.transform("evidence", lambda e: e["source_version"]))
    rows = items.select("item_id", "group_id", "start", "snapshot").join(titled, "item_id")
    differs = (F.size("evidence") > 0) & ~now.eqNullSafe(F.col("snapshot"))
    return rows.select(
        "item_id", "group_id", "start", F.transform("evidence", lambda e: e["chunk_id"]).alias("evidence"), "missing", F.coalesce("title", F.lit("")).alias("citation"), differs.alias("mismatch")
    ).orderBy("group_id", "start", "item_id")


def fold_decisions(log: DataFrame) -> DataFrame:
    """log with status and outcome of each decision: applied, not_pending (after a final one) or error.

    log: item_id, ts, seq, decision, reviewer, text. Decisions of an item are taken in order; the first one that
    publishes or rejects ends it, escalation keeps it open. No reviewer, an unknown decision, or an edit without
    text is an error and decides nothing.
    """
    status = decision_status(F.col("decision"))
    error = T.is_blank(F.col("reviewer")) | status.isNull() | ((F.col("decision") == "edit_approve") & T.is_blank(F.col("text")))
    marked = log.withColumns({"status": status, "_error": F.coalesce(error, F.lit(True))})
    final = (~F.col("_error") & F.col("status").isin("published", "rejected")).cast("int")
    earlier = Window.partitionBy("item_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(final).over(earlier), F.lit(0)) == 1
    return marked.withColumn("outcome", F.when(closed, "not_pending").when(F.col("_error"), "error").otherwise("applied")).drop("_error")


def final_decisions(log: DataFrame) -> DataFrame:
    """item_id, status, ts, seq: the decision that ended each item; by partial aggregates, without a sort.

    Same final states as fold_decisions, for when the log's history is not asked for.
    """
    status = decision_status(F.col("decision"))
    good = ~(T.is_blank(F.col("reviewer")) | ((F.col("decision") == "edit_approve") & T.is_blank(F.col("text"))))
    final = log.where(good & status.isin("published", "rejected"))
    first = final.groupBy("item_id").agg(F.min(F.struct("ts", "seq", status.alias("status"))).alias("d"))
    return first.select("item_id", "d.status", "d.ts", "d.seq")


def published(rows: DataFrame, style: str) -> DataFrame:
    return rows.where((F.col("review_status") == "published") & (F.col("style") == style))


def introduction_state(introductions: DataFrame) -> DataFrame:
    """group_id, style, state: published, processing (something unpublished exists) or unavailable."""
    grouped = introductions.groupBy("group_id", "style").agg(F.max((F.col("review_status") == "published").cast("int")).alias("p"), F.max(F.col("review_status").isin("pending", "processing").cast("int")).alias("u"))
    return grouped.select("group_id", "style", F.when(F.col("p") == 1, "published").when(F.col("u") == 1, "processing").otherwise("unavailable").alias("state"))


def publication_problem(items: DataFrame, chunks: DataFrame, sources: DataFrame, pins: DataFrame, versions: DataFrame) -> DataFrame:
    """item_id and the first reason why an item may not be published, or null.

    items: item_id, refs, claims (array<struct<text, source_refs>>), snapshot; chunks: chunk_id, source_id, source_version,
    source_version_hash, verified; sources: id and statuses; pins: id, version; versions: id, content_hash. Every claim
    has text and cites references of the item; every reference is a verified chunk of a usable source, at the
    source's pinned version and hash; and the snapshot is that of these versions.
    """
    empty = F.exists("claims", lambda c: T.is_blank(c["text"]) | (F.coalesce(F.size(c["source_refs"]), F.lit(0)) <= 0))
    stray = F.exists("claims", lambda c: F.size(F.array_except(c["source_refs"], F.col("refs"))) > 0)
    own = F.when((F.coalesce(F.size("refs"), F.lit(0)) <= 0) | (F.coalesce(F.size("claims"), F.lit(0)) <= 0), "nothing_cited").when(empty, "empty_claim").when(stray, "stray_ref")
    own = items.select("item_id", "refs", own.alias("_own"), "snapshot")  # claims stay where they are; an item with a reason of its own looks nothing up
    state = sources.select(F.col("id").alias("source_id"), usable().alias("_usable"))
    known = evidence_with_pin(chunks.where("verified"), pins, versions, state)
    each = F.when(F.col("source_version").isNull(), 1).when(~F.coalesce("_usable", F.lit(False)), 2).when(F.col("problem").isNotNull(), 3)
    known = known.select("chunk_id", "source_version", each.cast("byte").alias("_each"), F.lit(True).alias("_there"))
    refs = own.where("_own is null").select("item_id", F.explode(F.array_distinct("refs")).alias("chunk_id")).join(known, "chunk_id", "left")
    per = refs.groupBy("item_id").agg(F.min(F.when(F.col("_there"), F.col("_each")).otherwise(1)).alias("_each"), snapshot_of(F.collect_set("source_version")).alias("_now"))
    told = F.when(F.col("_each") == 1, "unresolved").when(F.col("_each") == 2, "unusable_source").when(F.col("_each") == 3, "not_pinned")
    found = F.coalesce("_own", told, F.when(~F.col("_now").eqNullSafe(F.col("snapshot")), "stale_snapshot"))
    return own.drop("refs").join(per, "item_id", "left").select("item_id", found.alias("problem"))


def introduction_queue(items: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Pending introductions in the order (group_id, style, item_id) with their evidence, titles and why approval is blocked.

    items: item_id, group_id, style, refs, snapshot, review_status. block: missing_refs, no_evidence, changed or null.
    """
    own = items.where("review_status = 'pending'")
    resolved = resolve_refs(own, chunks)
    named = resolved.select("item_id", F.explode_outer(F.array_distinct(F.transform("evidence", lambda e: e["source_id"]))).alias("id")).join(sources.select("id", "title"), "id", "left")
    titles = named.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"))
    now = snapshot_of(F.transform("evidence", lambda e: e["source_version"]))
    block = F.when(F.size("missing") > 0, "missing_refs").when(F.size("evidence") == 0, "no_evidence").when(~now.eqNullSafe(F.col("snapshot")), "changed")
    rows = own.select("item_id", "group_id", "style", "snapshot").join(resolved, "item_id").join(titles, "item_id")
    return rows.select("item_id", "group_id", "style", F.size("evidence").alias("evidence"), "missing", "titles", block.alias("block")).orderBy("group_id", "style", "item_id")


def stale_items(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extension: published items whose evidence has another snapshot now than when they were published."""
    resolved = resolve_refs(items.where("review_status = 'published'"), chunks)
    now = snapshot_of(F.transform("evidence", lambda e: e["source_version"]))
    return items.select("item_id", "snapshot").join(resolved, "item_id").where(~now.eqNullSafe(F.col("snapshot"))).select("item_id", "snapshot", now.alias("current"))


def cited_problems(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, chunk_id, problem: references that are missing or whose chunk is not verified."""
    refs = items.select("item_id", F.explode("refs").alias("chunk_id"))
    joined = refs.join(chunks.select("chunk_id", "verified"), "chunk_id", "left")
    return joined.select("item_id", "chunk_id", F.when(F.col("verified").isNull(), "missing").when(~F.col("verified"), "unverified").alias("problem")).where("problem is not null")


def eligible_base(explanations: DataFrame, anchors: DataFrame, style: str) -> DataFrame:
    """group_id, anchor, reason: published base text of each anchor; gap, blank_text or no_refs where it cannot serve."""
    own = published(explanations, style).select("group_id", F.col("start").alias("anchor"), "text", "source_refs")
    joined = anchors.select("group_id", "anchor").join(own.withColumn("_there", F.lit(True)), ["group_id", "anchor"], "left")
    reason = F.when(F.col("_there").isNull(), "gap").when(T.is_blank(F.col("text")), "blank_text").when(F.coalesce(F.size("source_refs"), F.lit(0)) <= 0, "no_refs")
    return joined.select("group_id", "anchor", reason.alias("reason"))


def reader_page(anchors: DataFrame, explanations: DataFrame, media: DataFrame) -> DataFrame:
    """anchors with the explanation that starts at each and its media; of equal keys the later one (seq) wins."""
    text = explanations.groupBy("group_id", F.col("start").alias("anchor")).agg(F.max_by("text", "seq").alias("explanation"))
    url = media.groupBy("group_id", "anchor").agg(F.max_by("url", "seq").alias("url"))
    return anchors.join(text, ["group_id", "anchor"], "left").join(url, ["group_id", "anchor"], "left")
