"""Queries over the smaller operators: keys, selections, registry checks, introductions, gaps and incremental logs.

Stand-ins: an order is a group, its line numbers are anchors; documents are items, suppliers are sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.functions.entities import unescape_html
from citewell.functions import vectors as V
from citewell.operators import chunking, coverage, incremental, ranking, registry, retrieval, review, rules, scans, verify
from citewell.plans.common import clean_html_sql, clean_page, q, trim_sql
from citewell.sources.tables import driver_table

CAP = chunking.CHUNK_CAP
NOW = "2024-06-01 00:00:00"

# ---------------------------------------------------------------- keys and short texts


def _urls():
    return F.concat(F.lit("https://generativelanguage.googleapis.com/v1/models/m-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ":generate").when(F.col("doc_id") % 3 == 1, "?x=1").otherwise(""))


def string_keys(spark, d):
    """The short forms of documents: preview, line, keys, fingerprint, model, languages and defaults."""
    docs = driver_table(spark, d, "documents")
    url = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).otherwise(_urls())
    style = F.when(F.col("doc_id") % 4 == 0, "simplified_ar").when(F.col("doc_id") % 4 == 1, "en").when(F.col("doc_id") % 4 == 2, "other_ar")
    return docs.select(
        "doc_id", T.preview(F.col("text"), 20).alias("preview"), T.truncate_line(F.col("text"), 15).alias("line"), T.run_key(F.col("doc_id") % 200, F.col("doc_id")).alias("run_key"),
        T.media_key(F.col("doc_id") % 200, F.col("doc_id")).alias("media_key"), T.prompt_fingerprint(F.col("text")).alias("prompt"), T.model_of_url(url).alias("model"), rules.provider(url).alias("provider"),
        T.style_language(T.style_or_default(style)).alias("language"), T.strict_style_language(style).alias("strict_language"), T.style_or_default(style).alias("style"), T.summarize(F.col("text"), 40).alias("summary"),
    )


_KEYS_SQL = f"""WITH x AS (SELECT *, {trim_sql('text')} AS t, {trim_sql("translate(text, chr(10), ' ')")} AS l, CASE WHEN doc_id % 5 = 0 THEN 'https://example.org/' || doc_id ELSE 'https://generativelanguage.googleapis.com/v1/models/m-' || doc_id || CASE doc_id % 3 WHEN 0 THEN ':generate' WHEN 1 THEN '?x=1' ELSE '' END END AS url,
  CASE doc_id % 4 WHEN 0 THEN 'simplified_ar' WHEN 1 THEN 'en' WHEN 2 THEN 'other_ar' END AS st FROM documents)
SELECT doc_id, CASE WHEN length(t) > 20 THEN left(t, 20) || '...' ELSE t END AS preview, CASE WHEN length(l) > 15 THEN left(l, 15) || '…' ELSE l END AS line, printf('s%03da%03d', doc_id % 200, doc_id) AS run_key, printf('%03d%03d.mp3', doc_id % 200, doc_id) AS media_key,
  'sys-' || left(sha256(text), 12) AS prompt, CASE WHEN doc_id % 5 = 0 THEN url ELSE 'm-' || doc_id END AS model, CASE WHEN doc_id % 5 <> 0 THEN 'gemini' END AS provider, CASE WHEN coalesce(st, 'simplified_ar') LIKE '%\\_ar' ESCAPE '\\' THEN 'ar' ELSE 'en' END AS language,
  CASE st WHEN 'simplified_ar' THEN 'ar' WHEN 'en' THEN 'en' END AS strict_language, coalesce(st, 'simplified_ar') AS style, left(t, 40) AS summary FROM x"""


def split_header(spark, d):
    """Header and body of texts with a provenance header; every third has none and is not accepted."""
    docs = driver_table(spark, d, "documents")
    held = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("source: "), F.col("source"), F.lit("\n---\n"), F.col("text"), F.lit("\n---\nmore")))
    parts = T.split_header(held)
    return docs.select("doc_id", parts["header"].alias("header"), T.content_hash(parts["body"]).alias("body"), parts["ok"].alias("ok")).withColumn("ok", F.col("ok").cast("int"))


_PLANTED = (("A&#233;B &#xe9; &hellip;", "AéB é …"), ("&eacute;t&eacute; &mdash; &Sigma;", "été — Σ"), ("&#8220;x&#8221; &amp;lt; &nosuch;", "“x” &lt; &nosuch;"), ("&frac12; &euro;&#36; &#x1F600;", "½ €$ \U0001f600"))


def html_entities(spark, d):
    """Every named and numeric entity where they are planted; the whole pages cleaned as their SQL does it."""
    pages = driver_table(spark, d, "pages")
    planted = F.element_at(F.array(*[F.lit(x) for x, _ in _PLANTED]), (F.col("page_id") % len(_PLANTED) + 1).cast("int"))
    return pages.select("page_id", unescape_html(planted).alias("planted"), T.content_hash(clean_page(F.col("html"))).alias("sha"))


_ENTITIES_SQL = f"SELECT page_id, [{', '.join(q(y) for _, y in _PLANTED)}][page_id % {len(_PLANTED)} + 1] AS planted, sha256({clean_html_sql('html')}) AS sha FROM pages"

# ---------------------------------------------------------------- selection and estimates


def entry_selection(spark, d):
    """Entries by a list with ranges, in the order of their number."""
    return scans.select_entries(driver_table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "20, 7-12, 3, 9")


def all_entries(spark, d):
    return scans.select_entries(driver_table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")


def _counts(spark, d):
    return coverage.piece_counts(driver_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), CAP)


def piece_histogram(spark, d):
    return coverage.piece_histogram(_counts(spark, d))


def chunk_estimate(spark, d):
    return coverage.chunk_estimate(_counts(spark, d))


_PIECES_SQL = f"WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS length, CAST(list_sum(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: ceil(length(x) / {CAP}))) AS BIGINT) AS pieces FROM documents)"


def _lines(spark, d, together: bool = False):
    """Line items as rows with a group, an anchor, statuses and texts; together: the rows of a group in one partition, for those who group them next.

    Distinct by four numbers, which the id is made of, so no text is moved.
    """
    rows = driver_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("int").alias("anchor"), "l_partkey", "l_suppkey")
    rows = (rows.repartition("group_id") if together else rows).distinct()
    return rows.select(
        "group_id", "anchor", F.concat_ws("-", *[F.col(c).cast("string") for c in rows.columns]).alias("id"),
        F.when(F.col("l_suppkey") % 3 == 0, "pending").when(F.col("l_suppkey") % 3 == 1, "published").otherwise("rejected").alias("review_status"), "l_partkey", "l_suppkey",
    )


_LINES_SQL = "l AS (SELECT DISTINCT l_orderkey AS group_id, CAST(l_linenumber AS INTEGER) AS anchor, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE l_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'published' ELSE 'rejected' END AS review_status, l_partkey, l_suppkey FROM lineitem)"


def gated_group(spark, d):
    rows = _lines(spark, d).select("id", "group_id", F.col("anchor").alias("start"), (F.col("l_suppkey") % 5 != 0).alias("verified"))
    return scans.gated_group(rows, 7).select("id", "group_id", F.col("start").cast("long").alias("start"))


def pending_anchors(spark, d):
    return scans.pending_anchors(_lines(spark, d))


def published_rows(spark, d):
    rows = _lines(spark, d).withColumn("style", F.when(F.col("l_partkey") % 2 == 0, "en").otherwise("simplified_ar"))
    return review.published(rows, "en").groupBy("group_id").agg(F.count("*").alias("n"))


def plain_list(spark, d):
    return driver_table(spark, d, "supplier").select("s_suppkey", "s_name")


def covering(spark, d):
    """How many anchors 1 to 7 each range mapping covers; unanchored ones cover none."""
    start = F.when(F.col("l_suppkey") % 4 == 0, 0).otherwise(F.col("anchor"))
    end = F.when(F.col("l_suppkey") % 4 == 0, 0).otherwise(F.col("anchor") + (F.col("l_partkey") % 3).cast("int"))
    hit = lambda k: F.coalesce(retrieval.covers(F.lit(k), start, end), F.lit(False)).cast("long")
    why = lambda k: F.coalesce(rules.grounding_violation(start, end, F.lit(k), F.col("l_suppkey") % 7 != 0), F.lit("fine"))
    return _lines(spark, d).select("id", sum((hit(k) for k in range(1, 8)), F.lit(0).cast("long")).alias("covered"), why(3).alias("third"))


_COVERING_SQL = f"WITH {_LINES_SQL}, r AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE anchor END AS s, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE anchor + l_partkey % 3 END AS e FROM l) SELECT id, CASE WHEN s = 0 THEN 0 ELSE greatest(least(e, 7) - s + 1, 0) END AS covered, CASE WHEN l_suppkey % 7 = 0 THEN 'unverified' WHEN s > 0 AND 3 BETWEEN s AND e THEN 'fine' ELSE 'does_not_cover' END AS third FROM r"

# ---------------------------------------------------------------- integrity, gaps, drift


def corpus_integrity(spark, d):
    """Subjects whose anchor is not in the corpus, or is blank there."""
    docs = driver_table(spark, d, "documents").select((F.col("doc_id") % 10).alias("group_id"), F.col("doc_id").alias("anchor"), F.when(F.col("doc_id") % 11 == 5, F.lit("  \n")).otherwise(F.col("text")).alias("text"))
    return verify.anchor_integrity(docs, docs.where("anchor % 7 <> 3"))


def _sizes(spark, d):
    return driver_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg((F.max("l_linenumber") - 1).cast("int").alias("n"))


def missing_anchors(spark, d):
    return coverage.missing_anchors(_lines(spark, d).where("l_partkey % 3 <> 0"), _sizes(spark, d)).withColumn("anchor", F.col("anchor").cast("long"))


def extras(spark, d):
    return verify.extras(_lines(spark, d), _sizes(spark, d)).groupBy("group_id").agg(F.count("*").alias("n"))


_SIZES_SQL = "g AS (SELECT l_orderkey AS group_id, max(l_linenumber) - 1 AS n FROM lineitem GROUP BY l_orderkey)"


def beyond_range(spark, d):
    return incremental.beyond_range(_lines(spark, d), "anchor", 4)


def drift_sentence(spark, d):
    rows = _lines(spark, d).select(F.col("id").alias("chunk_id"), "group_id", F.col("anchor").alias("start"), F.col("anchor").alias("end"), F.lit("single_ayah").alias("mapping_type"), "l_partkey", "l_suppkey")
    kept = rows.where("l_partkey % 31 <> 0").withColumn("end", F.when(F.col("l_suppkey") % 37 == 0, F.col("end") + 1).otherwise(F.col("end")))
    return coverage.drift_sentence(coverage.mapping_drift(kept, rows.where("l_partkey % 29 <> 0")))


def versioned_set_hash(spark, d):
    """Set hashes of sources by version; a source with rows of two versions is an error."""
    docs = driver_table(spark, d, "documents")
    rows = docs.select("source", F.col("doc_id").alias("n_of"), T.content_hash(F.col("text")).alias("hash"), F.when((F.length("source") % 2 == 0) & (F.col("doc_id") % 50 == 0), "v2").otherwise("v1").alias("version"))
    return verify.versioned_set_hash(rows, ["source"], "n_of", "hash", "version")


_SET_SQL = """WITH x AS (SELECT source, doc_id, sha256(text) AS h, CASE WHEN length(source) % 2 = 0 AND doc_id % 50 = 0 THEN 'v2' ELSE 'v1' END AS v FROM documents),
g AS (SELECT source, sha256(string_agg(doc_id || chr(9) || h || chr(10), '' ORDER BY doc_id)) AS s, count(*) AS n, count(DISTINCT v) AS k, min(v) AS v FROM x GROUP BY source)
SELECT source, CASE WHEN k = 1 THEN v END AS version, CASE WHEN k = 1 THEN s END AS set_hash, n, CASE WHEN k > 1 THEN 'mixed_versions' END AS error FROM g"""

# ---------------------------------------------------------------- lists


def first_seen(spark, d):
    """Distinct values in the order of their first occurrence, with and without empty ones; distinct ids."""
    seen = driver_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("role")).alias("r")))).alias("x"))
    roles = F.transform("x", lambda x: x["r"])
    return seen.select("conv_id", F.array_join(ranking.first_seen_distinct(roles), ",").alias("seen"), F.array_join(ranking.first_seen_distinct(roles, True), ",").alias("named"))


_SEEN_SQL = """WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS r FROM conversations), f AS (SELECT conv_id, r, min(turn) AS t FROM x GROUP BY ALL)
SELECT conv_id, string_agg(r, ',' ORDER BY t, r) AS seen, coalesce(string_agg(r, ',' ORDER BY t, r) FILTER (WHERE r <> ''), '') AS named FROM f GROUP BY conv_id"""


def failure_sample(spark, d):
    failed = driver_table(spark, d, "orders").where("o_orderstatus = 'F'")
    return ranking.first_failures(failed, "o_custkey", ["o_orderkey"]).select(F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


def retry_delays(spark, d):
    attempt = (F.col("doc_id") % 7).cast("int")
    return driver_table(spark, d, "documents").select("doc_id", V.retry_delay_ms(attempt).alias("delay"))


def bounded_run(spark, d):
    """The first 12 pending rows in order, and whether more were left."""
    top, total = ranking.bounded(_lines(spark, d).where("review_status = 'pending'").select("group_id", "anchor", "id"), 12, ["group_id", "anchor", "id"])
    return top.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).crossJoin(total)  # two tables of one row


# ---------------------------------------------------------------- registry


def _sources(spark, d):
    """Suppliers as sources; some records are incomplete, some statuses unknown."""
    k = F.col("s_suppkey")
    return driver_table(spark, d, "supplier").select(
        k.cast("string").alias("id"), F.when(k % 9 == 1, " ").otherwise(F.col("s_name")).alias("title"), F.concat(F.lit("of "), "s_name").alias("author"), F.when(k % 7 == 1, F.lit(None)).otherwise("en").alias("language"),
        F.lit("first").alias("edition"), F.concat(F.lit("raw/"), k.cast("string")).alias("raw_text_ref"), F.when(k % 4 == 0, "restricted").otherwise("cleared").alias("licensing_status"),
        F.when(k % 5 == 0, "unknown").when(k % 5 == 1, "unverified").otherwise("verified").alias("verification_status"), (k % 5).cast("int").alias("authority_tier"), F.when(k % 3 == 0, "ingested").when(k % 3 == 1, "odd").alias("ingestion_status"),
        F.when(k % 6 != 0, F.concat(k.cast("string"), F.lit("@1"))).alias("current_version"),
    )


def registry_records(spark, d):
    return _sources(spark, d).select("id", F.array_join(registry.registry_violations(), "; ").alias("violations"))


_REGISTRY_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS id, array_to_string(list_filter([CASE WHEN s_suppkey % 9 = 1 THEN 'title missing' END, CASE WHEN s_suppkey % 7 = 1 THEN 'language missing' END, CASE WHEN s_suppkey % 5 = 0 THEN 'verification_status unknown' END,
  CASE WHEN s_suppkey % 5 NOT BETWEEN 1 AND 3 THEN 'authority_tier out of range' END, CASE WHEN s_suppkey % 3 = 1 THEN 'ingestion_status unknown' END], lambda x: x IS NOT NULL), '; ') AS violations FROM supplier"""


def registry_inventory(spark, d):
    return registry.inventory(_sources(spark, d)).withColumn("usable", F.col("usable").cast("int"))


def _versions(sources):
    """Versions @1 of all sources, and a second one of those without a pointer if their id is even."""
    two = F.when(F.col("current_version").isNull() & (F.col("id").cast("int") % 4 == 0), F.array(F.lit("@1"), F.lit("@2"))).otherwise(F.array(F.lit("@1")))
    return sources.select(F.explode(two).alias("v"), F.col("id").alias("source_id")).select(F.concat("source_id", "v").alias("id"), "source_id", F.sha2(F.concat("source_id", "v").cast("binary"), 256).alias("content_hash"))


def _evidence(spark, d, together: bool = False):
    """Line items as chunks of their suppliers: some of an older version, some with another hash, some not verified."""
    key = F.col("l_suppkey").cast("string")
    version = F.concat(key, F.when(F.col("l_partkey") % 19 == 0, "@0").otherwise("@1"))
    good = F.sha2(version.cast("binary"), 256)
    return _lines(spark, d, together).select("group_id", "anchor", F.col("id").alias("chunk_id"), key.alias("source_id"), version.alias("source_version"), F.when(F.col("l_partkey") % 23 == 0, "x").otherwise(good).alias("source_version_hash"), (F.col("l_partkey") % 13 != 0).alias("verified"))


def pinned_evidence(spark, d):
    sources = _sources(spark, d)
    versions = _versions(sources)
    found = registry.evidence_with_pin(_evidence(spark, d), registry.resolve_pins(sources, versions), versions)
    return found.select("chunk_id", F.coalesce("problem", F.lit("fine")).alias("problem"))


_EVIDENCE_SQL = f"""{_LINES_SQL}, c AS (SELECT group_id, anchor, id AS chunk_id, l_suppkey AS k, l_suppkey || CASE WHEN l_partkey % 19 = 0 THEN '@0' ELSE '@1' END AS v, l_partkey, l_partkey % 13 <> 0 AS verified,
  CASE WHEN l_suppkey % 6 = 0 AND l_suppkey % 4 = 0 THEN 'no_pin' WHEN l_partkey % 19 = 0 THEN 'version_differs' WHEN l_partkey % 23 = 0 THEN 'hash_differs' END AS problem, l_suppkey % 5 > 1 AND l_suppkey % 4 <> 0 AS usable FROM l)"""


def publication_problems(spark, d):
    """The first reason why each order, as an introduction that cites its lines, may not be published."""
    sources = _sources(spark, d)
    versions = _versions(sources)
    chunks = _evidence(spark, d, together=True)
    k = F.col("item_id")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("anchor", "chunk_id"))), lambda x: x["chunk_id"])
    items = chunks.groupBy(F.col("group_id").alias("item_id")).agg(refs.alias("refs"), registry.snapshot_of(F.collect_set("source_version")).alias("snapshot"))
    claim = lambda text, refs: F.struct(text.alias("text"), refs.alias("source_refs"))
    claims = F.when(k % 17 == 0, F.array().cast("array<struct<text:string,source_refs:array<string>>>")).otherwise(F.array(claim(F.when(k % 11 == 0, " ").otherwise("claim"), F.slice("refs", 1, 1)), claim(F.lit("other"), F.when(k % 13 == 0, F.array(F.lit("stray"))).otherwise(F.col("refs")))))
    items = items.select("item_id", "refs", claims.alias("claims"), F.when(k % 5 == 0, "old").otherwise(F.col("snapshot")).alias("snapshot"))
    found = review.publication_problem(items, chunks, sources, registry.resolve_pins(sources, versions), versions)
    return found.select("item_id", F.coalesce("problem", F.lit("publishable")).alias("problem"))


_PUBLICATION_SQL = f"""WITH {_EVIDENCE_SQL}, e AS (SELECT group_id AS item_id, min(CASE WHEN NOT verified THEN 1 WHEN NOT usable THEN 2 WHEN problem IS NOT NULL THEN 3 END) AS w, string_agg(DISTINCT v, '+' ORDER BY v) AS s FROM c GROUP BY group_id)
SELECT item_id, CASE WHEN item_id % 17 = 0 THEN 'nothing_cited' WHEN item_id % 11 = 0 THEN 'empty_claim' WHEN item_id % 13 = 0 THEN 'stray_ref' WHEN w = 1 THEN 'unresolved' WHEN w = 2 THEN 'unusable_source' WHEN w = 3 THEN 'not_pinned' WHEN item_id % 5 = 0 THEN 'stale_snapshot' ELSE 'publishable' END AS problem FROM e"""


def introduction_queue(spark, d):
    chunks = _evidence(spark, d, together=True)
    items = chunks.groupBy(F.col("group_id").alias("item_id")).agg(F.array_sort(F.collect_list("chunk_id")).alias("refs"), registry.snapshot_of(F.collect_set("source_version")).alias("snapshot"))
    k = F.col("item_id")
    items = items.select("item_id", (k % 9).alias("group_id"), F.when(k % 2 == 0, "en").otherwise("simplified_ar").alias("style"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("refs")).alias("refs"), F.when(k % 5 == 0, "old").otherwise(F.col("snapshot")).alias("snapshot"), F.when(k % 3 == 0, "published").otherwise("pending").alias("review_status"))
    rows = review.introduction_queue(items, chunks.where("chunk_id not like '%3'"), _sources(spark, d))
    return rows.select("item_id", "group_id", "style", F.col("evidence").cast("long").alias("evidence"), F.array_join("missing", ",").alias("missing"), "titles", F.coalesce("block", F.lit("")).alias("block"))


_INTRODUCTIONS_SQL = f"""WITH {_EVIDENCE_SQL}, i AS (SELECT group_id AS item_id, string_agg(DISTINCT v, '+' ORDER BY v) AS s0 FROM c GROUP BY group_id), own AS (SELECT *, CASE WHEN item_id % 5 = 0 THEN 'old' ELSE s0 END AS snapshot FROM i WHERE item_id % 3 <> 0),
r AS (SELECT item_id, chunk_id, k, v, chunk_id NOT LIKE '%3' AS there FROM own JOIN c ON c.group_id = item_id WHERE item_id % 7 <> 0),
g AS (SELECT item_id, count(*) FILTER (WHERE there) AS evidence, string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (WHERE NOT there) AS missing, string_agg(DISTINCT CASE WHEN s_suppkey % 9 = 1 THEN ' ' ELSE s_name END, '; ' ORDER BY CASE WHEN s_suppkey % 9 = 1 THEN ' ' ELSE s_name END) FILTER (WHERE there) AS titles, string_agg(DISTINCT v, '+' ORDER BY v) FILTER (WHERE there) AS now FROM r LEFT JOIN supplier ON s_suppkey = k GROUP BY item_id)
SELECT own.item_id, own.item_id % 9 AS group_id, CASE WHEN own.item_id % 2 = 0 THEN 'en' ELSE 'simplified_ar' END AS style, coalesce(evidence, 0) AS evidence, coalesce(missing, '') AS missing, coalesce(titles, '') AS titles,
  CASE WHEN missing IS NOT NULL THEN 'missing_refs' WHEN coalesce(evidence, 0) = 0 THEN 'no_evidence' WHEN now IS DISTINCT FROM snapshot THEN 'changed' ELSE '' END AS block FROM own LEFT JOIN g USING (item_id)"""


def introduction_decisions(spark, d):
    """Status after a decision: approval takes all seven checks and a publishable row; and whether review may be offered."""
    k = F.col("doc_id")
    checks = F.array(*[(k % p != 0) for p in (2, 3, 5, 7, 11, 13, 17)])
    decision = F.when(k % 10 < 7, "approve").when(k % 10 == 7, "reject").when(k % 10 == 8, "escalate").otherwise("other")
    missing = F.when(k % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return driver_table(spark, d, "documents").select("doc_id", rules.introduction_decision(decision, checks, k % 19 != 0).alias("status"), rules.reviewable(missing, k % 6 == 1, F.slice(checks, 1, 4)).cast("int").alias("reviewable"))


_NOT = "(" + " OR ".join(f"doc_id % {p} = 0" for p in (2, 3, 5, 7, 11, 13, 17)) + ")"
_DECISIONS_SQL = f"SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN CASE WHEN {_NOT} THEN 'error_checklist' WHEN doc_id % 19 = 0 THEN 'error_not_publishable' ELSE 'published' END WHEN doc_id % 10 = 7 THEN 'rejected' WHEN doc_id % 10 = 8 THEN 'pending' ELSE 'error_decision' END AS status, CAST(doc_id % 4 <> 0 AND doc_id % 6 <> 1 AND doc_id % 2 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS INTEGER) AS reviewable FROM documents"


def introduction_drafts(spark, d):
    """What is wrong with drafted introductions and with their evidence."""
    k = F.col("doc_id")
    claim = F.struct(F.when(k % 7 == 0, " ").otherwise("some words in english here").alias("text"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("E1"))).alias("source_refs"))
    section = F.struct(F.when(k % 11 == 0, "odd").otherwise("themes").alias("type"), F.when(k % 13 == 0, "").otherwise("title").alias("title"), F.when(k % 17 == 0, F.slice(F.array(claim), 1, 0)).otherwise(F.array(claim)).alias("claims"))
    sections = F.when(k % 19 == 0, F.slice(F.array(section), 1, 0)).otherwise(F.array(section))
    piece = lambda i: F.struct(i.alias("id"), F.lit("s").alias("source_id"), F.when(k % 4 == 0, "").otherwise("v").alias("source_version"), F.lit("t").alias("text"))
    evidence = F.when(k % 6 == 0, F.slice(F.array(piece(F.lit("a"))), 1, 0)).otherwise(F.array(piece(F.lit("a")), piece(F.when(k % 9 == 1, "a").otherwise("b"))))
    reason = rules.introduction_reason(sections, k % 3 != 0, F.lit("en"), F.array(F.lit("E1")))
    return driver_table(spark, d, "documents").select("doc_id", F.coalesce(reason, F.lit("fine")).alias("reason"), F.array_join(rules.evidence_violations(evidence), ", ").alias("evidence"))


_DRAFTS_SQL = """SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'no_sections' WHEN doc_id % 11 = 0 THEN 'section_type' WHEN doc_id % 13 = 0 THEN 'section_title' WHEN doc_id % 17 = 0 THEN 'section_claims' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'claims' WHEN doc_id % 3 = 0 THEN 'review_not_required' ELSE 'fine' END AS reason,
CASE WHEN doc_id % 6 = 0 THEN 'no evidence' ELSE array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'blank field' END, CASE WHEN doc_id % 9 = 1 THEN 'repeated id' END], lambda x: x IS NOT NULL), ', ') END AS evidence FROM documents"""

# ---------------------------------------------------------------- maintenance


def eligible_base(spark, d):
    rows = _lines(spark, d).where("anchor <= 3").groupBy("group_id", F.col("anchor").alias("start")).agg(F.min("l_partkey").alias("p"), F.min("review_status").alias("review_status"))
    rows = rows.select("group_id", "start", "review_status", F.lit("en").alias("style"), F.when(F.col("p") % 5 == 0, " ").otherwise("text").alias("text"), F.when(F.col("p") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))).alias("source_refs"))
    anchors = _lines(spark, d).select("group_id", "anchor").distinct()
    return review.eligible_base(rows, anchors, "en").select("group_id", F.col("anchor").cast("long").alias("anchor"), F.coalesce("reason", F.lit("eligible")).alias("reason"))


_ELIGIBLE_SQL = f"""WITH {_LINES_SQL}, r AS (SELECT group_id, anchor, min(l_partkey) AS p, min(review_status) AS st FROM l WHERE anchor <= 3 GROUP BY ALL), a AS (SELECT DISTINCT group_id, anchor FROM l)
SELECT a.group_id, CAST(a.anchor AS BIGINT) AS anchor, CASE WHEN p IS NULL THEN 'gap' WHEN p % 5 = 0 THEN 'blank_text' WHEN p % 7 = 0 THEN 'no_refs' ELSE 'eligible' END AS reason FROM a LEFT JOIN (SELECT * FROM r WHERE st = 'published') r ON r.group_id = a.group_id AND r.anchor = a.anchor"""


def run_log(spark, d):
    """A run log keyed by run and attempt, written again for some runs: keys of two parts, created_at of the first."""
    runs = driver_table(spark, d, "orders").select(T.run_key(F.col("o_orderkey") % 150, F.col("o_orderkey")).alias("run_id"), (F.col("o_custkey") % 3).alias("attempt"), F.col("o_orderstatus").alias("outcome"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    again = runs.where("attempt = 1").withColumn("outcome", F.lit("rerun"))
    new = runs.where("attempt = 2").withColumn("attempt", F.lit(9).cast(dict(runs.dtypes)["attempt"]))
    found = incremental.upsert(runs, again.unionByName(new), ["run_id", "attempt"], F.lit(NOW).cast("timestamp"))
    return found.groupBy("outcome", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated")).agg(F.count("*").alias("n"))


_RUN_SQL = """WITH o AS (SELECT o_custkey % 3 AS a, o_orderstatus AS s FROM orders) SELECT outcome, created, updated, count(*) AS n FROM (
SELECT CASE WHEN a = 1 THEN 'rerun' ELSE s END AS outcome, '2024-01-01' AS created, CASE WHEN a = 1 THEN '2024-06-01' ELSE '2024-01-01' END AS updated FROM o UNION ALL SELECT s, '2024-06-01', '2024-06-01' FROM o WHERE a = 2) GROUP BY ALL"""


def media_upsert(spark, d):
    """Media rows keyed by reciter, group and anchor; later addresses replace earlier ones."""
    own = _lines(spark, d).groupBy((F.col("l_suppkey") % 4).alias("reciter"), "group_id", "anchor").agg(F.min("id").alias("audio_url"))
    stamps = {"created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-01").cast("timestamp")}
    old, new = own.where("group_id % 3 <> 0").withColumns(stamps), own.where("group_id % 2 = 0").withColumn("audio_url", F.concat(F.lit("new-"), "audio_url"))
    found = incremental.upsert(old, new, ["reciter", "group_id", "anchor"], F.lit(NOW).cast("timestamp"))
    return found.select(F.col("reciter").cast("long").alias("reciter"), "group_id", F.col("anchor").cast("long").alias("anchor"), "audio_url", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


_MEDIA_SQL = f"""WITH {_LINES_SQL}, o AS (SELECT l_suppkey % 4 AS reciter, group_id, anchor, min(id) AS u FROM l GROUP BY ALL)
SELECT CAST(reciter AS BIGINT) AS reciter, group_id, CAST(anchor AS BIGINT) AS anchor, CASE WHEN group_id % 2 = 0 THEN 'new-' || u ELSE u END AS audio_url, CASE WHEN group_id % 3 <> 0 THEN '2024-01-01' ELSE '2024-06-01' END AS created, CASE WHEN group_id % 2 = 0 THEN '2024-06-01' ELSE '2024-01-01' END AS updated FROM o WHERE group_id % 3 <> 0 OR group_id % 2 = 0"""


def anchor_map(spark, d):
    """The mappings of chunks as a view of them, with those whose range does not fit their type."""
    rows = _lines(spark, d).select("id", F.col("l_suppkey").cast("string").alias("source_id"), F.lit("v").alias("source_version"), "group_id", F.col("anchor").alias("start"), (F.col("anchor") + (F.col("l_partkey") % 3).cast("int") - 1).alias("end"), F.when(F.col("l_partkey") % 2 == 0, "multi_ayah").otherwise("single_ayah").alias("mapping_type"))
    found = chunking.chunk_anchor_map(rows)
    return found.groupBy("mapping_type").agg(F.count("*").alias("n"), F.count_if("invalid").alias("invalid"))


_MAP_SQL = f"""WITH {_LINES_SQL}, m AS (SELECT anchor AS s, anchor + l_partkey % 3 - 1 AS e, CASE WHEN l_partkey % 2 = 0 THEN 'multi_ayah' ELSE 'single_ayah' END AS t FROM l)
SELECT t AS mapping_type, count(*) AS n, count(*) FILTER (WHERE NOT (s >= 1 AND CASE WHEN t = 'single_ayah' THEN s = e ELSE s <= e END)) AS invalid FROM m GROUP BY t"""


def attached_vectors(spark, d):
    """Vectors given by id, with the default model where theirs is blank, and the portable hash."""
    e = driver_table(spark, d, "embeddings")
    given = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 2 == 0, " ").otherwise("own").alias("model"))
    found = chunking.attach_vectors(e.select(F.col("vec_id").alias("id")), given, "m")
    return found.select("id", F.coalesce("embedding_model", F.lit("")).alias("model"), F.coalesce("embedding_dimensions", F.lit(0)).cast("long").alias("width"), F.coalesce("embedding_hash", F.lit("")).alias("hash"))


_VECTORS_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN vec_id % 2 = 0 THEN 'm' ELSE 'own' END AS model FROM embeddings)
SELECT vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN model ELSE '' END AS model, CASE WHEN vec_id % 3 <> 0 THEN len(v) ELSE 0 END AS width,
  CASE WHEN vec_id % 3 <> 0 THEN sha256(model || chr(0) || array_to_string(list_transform(v, lambda x: regexp_replace(CAST(x AS VARCHAR), '\\.0$', '') || chr(0)), '') || chr(1)) ELSE '' END AS hash FROM e"""

_NAMES = """string_keys split_header html_entities entry_selection all_entries piece_histogram chunk_estimate gated_group pending_anchors published_rows plain_list covering corpus_integrity missing_anchors extras
beyond_range drift_sentence versioned_set_hash first_seen failure_sample retry_delays bounded_run registry_records registry_inventory pinned_evidence publication_problems introduction_queue introduction_decisions
introduction_drafts eligible_base run_log media_upsert anchor_map attached_vectors"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}
ORACLES = {
    "string_keys": _KEYS_SQL,
    "split_header": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'source: ' || source END AS header, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || chr(10) || '---' || chr(10) || 'more' END) AS body, CAST(doc_id % 3 <> 0 AS INTEGER) AS ok FROM documents",
    "html_entities": _ENTITIES_SQL,
    "entry_selection": "SELECT n_nationkey, n_name FROM nation JOIN (SELECT unnest([20, 3, 9] || range(7, 13)) AS k) ON k = n_nationkey",
    "all_entries": "SELECT r_regionkey, r_name FROM region",
    "piece_histogram": f"{_PIECES_SQL} SELECT pieces, count(*) AS sections FROM p GROUP BY pieces",
    "chunk_estimate": f"{_PIECES_SQL} SELECT count(*) AS sections, count(*) FILTER (WHERE pieces > 1) AS split, max(length) AS longest, min(doc_id) FILTER (WHERE length = (SELECT max(length) FROM p)) AS longest_id, CAST(sum(pieces) AS BIGINT) AS chunks FROM p",
    "gated_group": f"WITH {_LINES_SQL} SELECT id, group_id, CAST(anchor AS BIGINT) AS \"start\" FROM l WHERE group_id = 7 AND l_suppkey % 5 <> 0",
    "pending_anchors": f"WITH {_LINES_SQL} SELECT count(DISTINCT (group_id, anchor)) AS pending FROM l WHERE review_status = 'pending'",
    "published_rows": f"WITH {_LINES_SQL} SELECT group_id, count(*) AS n FROM l WHERE review_status = 'published' AND l_partkey % 2 = 0 GROUP BY group_id",
    "plain_list": "SELECT s_suppkey, s_name FROM supplier",
    "covering": _COVERING_SQL,
    "corpus_integrity": "SELECT doc_id % 10 AS group_id, doc_id AS anchor, CASE WHEN doc_id % 7 = 3 THEN 'not_in_corpus' ELSE 'empty_text' END AS problem FROM documents WHERE doc_id % 7 = 3 OR doc_id % 11 = 5",
    "missing_anchors": f"WITH {_LINES_SQL}, {_SIZES_SQL}, grid AS (SELECT group_id, unnest(range(1, n + 1)) AS anchor FROM g) SELECT group_id, anchor FROM grid WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.group_id = grid.group_id AND l.anchor = grid.anchor AND l_partkey % 3 <> 0)",
    "extras": f"WITH {_LINES_SQL}, {_SIZES_SQL} SELECT group_id, count(*) AS n FROM l JOIN g USING (group_id) WHERE anchor > g.n GROUP BY group_id",
    "beyond_range": f"WITH {_LINES_SQL} SELECT count(*) FILTER (WHERE anchor > 4) AS beyond FROM l",
    "drift_sentence": f"WITH {_LINES_SQL}, n AS (SELECT count(*) FILTER (WHERE l_partkey % 29 <> 0 AND l_partkey % 31 = 0) AS a, count(*) FILTER (WHERE l_partkey % 29 = 0 AND l_partkey % 31 <> 0) AS b, count(*) FILTER (WHERE l_partkey % 29 <> 0 AND l_partkey % 31 <> 0 AND l_suppkey % 37 = 0) AS c FROM l) SELECT CASE WHEN a + b + c = 0 THEN 'none' ELSE a || ' unmapped chunks, ' || b || ' orphan mappings, ' || c || ' mismatched' END AS drift FROM n",
    "versioned_set_hash": _SET_SQL,
    "first_seen": _SEEN_SQL,
    "failure_sample": "SELECT string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_orderkey) AS sample FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20)",
    "retry_delays": "SELECT doc_id, CAST(500 * pow(2, greatest(doc_id % 7, 1) - 1) AS BIGINT) AS delay FROM documents",
    "bounded_run": f"WITH {_LINES_SQL}, p AS (SELECT * FROM l WHERE review_status = 'pending'), t AS (SELECT id FROM p ORDER BY group_id, anchor, id LIMIT 12) SELECT (SELECT string_agg(id, ',' ORDER BY id) FROM t) AS ids, count(*) > 12 AS truncated, count(*) AS available FROM p",
    "registry_records": _REGISTRY_SQL,
    "registry_inventory": "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey % 5 > 1 AND s_suppkey % 4 <> 0 AS INTEGER) AS usable, CASE s_suppkey % 3 WHEN 0 THEN 'ingested' WHEN 1 THEN 'odd' ELSE 'not_started' END AS ingestion_status FROM supplier",
    "pinned_evidence": f"WITH {_EVIDENCE_SQL} SELECT chunk_id, coalesce(problem, 'fine') AS problem FROM c",
    "publication_problems": _PUBLICATION_SQL,
    "introduction_queue": _INTRODUCTIONS_SQL,
    "introduction_decisions": _DECISIONS_SQL,
    "introduction_drafts": _DRAFTS_SQL,
    "eligible_base": _ELIGIBLE_SQL,
    "run_log": _RUN_SQL,
    "media_upsert": _MEDIA_SQL,
    "anchor_map": _MAP_SQL,
    "attached_vectors": _VECTORS_SQL,
}
