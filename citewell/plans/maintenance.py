"""Queries over incremental maintenance, the registry, review and cross-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.operators import incremental as I
from citewell.operators import numbering, ranking, registry, review, rules, scans, verify
from citewell.plans.common import letter_key_sql
from citewell.sources.tables import driver_table

NOW = "2024-06-01 00:00:00"


# ---------------------------------------------------------------- scans


def group_scan(spark, d):
    """One equality filter that reaches the scan, in order."""
    return scans.where_equal(driver_table(spark, d, "orders"), ["o_orderkey"], o_orderpriority="1-URGENT").select("o_orderkey", "o_custkey", "o_orderstatus")


def point_lookup(spark, d):
    return scans.lookup(driver_table(spark, d, "customer"), c_custkey=7).select("c_custkey", "c_name", "c_mktsegment")


def ordered_list(spark, d):
    return scans.ordered(driver_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


def narrowed(spark, d):
    """Rows that fail a guard are counted by kind instead of vanishing."""
    kept, rejected = scans.narrow(driver_table(spark, d, "events").select("event_type", "value"), (F.col("value") > 1) & (F.col("event_type") != "error"))
    return kept.agg(F.count("*").alias("kept")).crossJoin(rejected)  # two tables of one row


# ---------------------------------------------------------------- increments


def _old_new(spark, d):
    docs = driver_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", T.content_hash(F.col("text")).alias("hash"))
    model = F.when(F.col("id") % 10 == 4, "m0").otherwise("m1")
    old = docs.where(F.col("id") % 2 == 0).select("id", "source", F.when(F.col("id") % 6 == 0, F.lit("stale")).otherwise(F.col("hash")).alias("hash"), model.alias("model"))
    new = docs.where(F.col("id") % 9 != 5).select("id", "source", "hash", F.lit("m1").alias("model"))
    return old, new


def delta_plan(spark, d):
    old, new = _old_new(spark, d)
    return I.run_report(I.delta(old, new))


def upsert_prune(spark, d):
    """The next snapshot after an upsert and a prune of one source."""
    old, new = _old_new(spark, d)
    t0, now = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(NOW).cast("timestamp")
    stored = old.withColumns({"created_at": t0, "updated_at": t0})
    merged = I.upsert(stored, new, ["id"], now)
    pruned = I.prune(merged, new.select("id"), {"source": "src4"})
    return pruned.select("id", "source", "hash", "model", (F.col("created_at") == now).alias("created_now"), (F.col("updated_at") == now).alias("updated_now"))


def vector_upsert(spark, d):
    """Vectors set on known ids, and the unknown ids that were given."""
    e = driver_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"))
    chunks = e.where(F.col("id") % 4 != 0).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("embedding")).alias("embedding"), F.lit("old").alias("model"))
    given = e.where(F.col("id") % 6 == 0).select("id", "embedding", F.lit("new").alias("model"))
    updated, missing = I.set_vectors(chunks, given)
    done = updated.select("id", F.col("model").alias("state"), F.col("embedding").isNotNull().alias("has_vector"))
    return done.unionByName(missing.select("id", F.lit("missing").alias("state"), F.lit(False).alias("has_vector")))


def undecided_upsert(spark, d):
    """Drafts over stored rows: only undecided ones are replaced."""
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    orders = driver_table(spark, d, "orders")
    stored = orders.where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("id"), status.alias("review_status"), F.lit("old").alias("text"), t0.alias("created_at"), t0.alias("updated_at"))
    drafts = orders.where(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("review_status"), F.lit("new").alias("text"))
    after = I.upsert_undecided(stored, drafts, ["id"], F.lit(NOW).cast("timestamp"))
    return after.groupBy("review_status", "text", (F.col("created_at") == F.col("updated_at")).alias("untouched")).agg(F.count("*").alias("n"))


def approval_gate(spark, d):
    """Documents with their source's approval passed on, and whether that changed."""
    docs = driver_table(spark, d, "documents").select(F.col("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), (F.col("doc_id") % 3 == 0).alias("source_verified"), F.lit(1).alias("authority_tier"))
    labels = driver_table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("quality") == 1, "verified").otherwise("unverified").alias("verification_status"), F.when(F.col("toxic") == 0, "cleared").otherwise("pending").alias("licensing_status"), F.lit(1).alias("authority_tier"))
    done = I.sync_state(docs, labels)
    return done.select("doc_id", F.col("source_verified").alias("usable"), "changed")


def latest_status(spark, d):
    """Last event of each user in an append-only log."""
    log = driver_table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return I.latest_status(log).select(F.col("id").alias("user_id"), "status")


def duplicate_keys(spark, d):
    return I.duplicate_keys(driver_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n")


def batches(spark, d):
    """Windows of 32 within each source, and the calls they take."""
    docs = ranking.batched(driver_table(spark, d, "documents").select("doc_id", "source"), 32, ["doc_id"], ["source"])
    return docs.groupBy("source").agg(F.count("*").alias("documents"), (F.max("batch") + 1).alias("last_batch"), ranking.planned_calls(F.count("*")).alias("calls"))


def numbered_documents(spark, d):
    """Every document's number in the order of source and id, and its window of 32."""
    docs = driver_table(spark, d, "documents").select("doc_id", "source")
    return numbering.numbered(docs, ["source", "doc_id"], "number").withColumn("batch", F.floor(F.col("number") / 32).cast("long"))


def missing_grid(spark, d):
    """Nations and market segments without a customer above a balance."""
    customers = driver_table(spark, d, "customer")
    present = customers.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    nations = driver_table(spark, d, "nation").select("n_nationkey")
    return verify.missing_of_grid(nations, customers.select(F.col("c_mktsegment").alias("segment")).distinct(), present, ["n_nationkey", "segment"])


def grid_audit(spark, d):
    return verify.grid_audit(driver_table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1)), ["host"], "url")


# ---------------------------------------------------------------- registry and review


def pin_resolution(spark, d):
    """Sources with no, one and many versions, and pointers that hold, dangle or point elsewhere."""
    docs = driver_table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("-"), "lang").alias("source"), "text")
    versions = docs.where(F.col("doc_id") % 17 == 3).select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 5 != 0, T.content_hash(F.col("text"))).otherwise(F.lit("")).alias("content_hash"))
    least = docs.groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("k"), F.min(F.when(F.col("doc_id") % 17 == 3, F.col("doc_id"))).alias("own"))
    pointer = F.when(F.col("k") % 4 == 0, F.concat(F.lit("v"), F.col("own").cast("string"))).when(F.col("k") % 4 == 1, F.lit("v3")).when(F.col("k") % 4 == 2, F.lit("v-none"))
    return registry.resolve_pins(least.select("id", pointer.alias("current_version")), versions).select("id", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("reason", F.lit("")).alias("reason"))


def _refs(spark, d):
    """Line items as references of orders to parts; every seventh part is unknown."""
    lines = driver_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    chunk = F.concat(F.lit("c"), F.col("l_partkey").cast("string"))
    parts = driver_table(spark, d, "part").where(F.col("p_partkey") % 7 != 0)
    chunks = parts.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.col("p_brand").alias("source_id"), F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string")).alias("source_version"), (F.col("p_size") % 4 != 0).alias("verified"))
    return lines.withColumn("chunk_id", chunk), chunks


def attribution(spark, d):
    lines, chunks = _refs(spark, d)
    brands = driver_table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct()
    sources = brands.select("id", F.when(F.endswith("id", F.lit("3")), "unverified").otherwise("verified").alias("verification_status"), F.lit("cleared").alias("licensing_status"))
    pins = brands.select("id", F.lit("v1").alias("version"))
    refs = lines.select(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") - 1).cast("long").alias("pos"), "chunk_id")
    done = registry.attribution(refs, chunks.drop("verified"), sources, pins)
    return done.withColumn("problem", F.coalesce("problem", F.lit("")))


def review_queue(spark, d):
    lines, chunks = _refs(spark, d)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "chunk_id"))), lambda x: x["chunk_id"])
    items = lines.groupBy(F.col("l_orderkey").alias("item_id")).agg(refs.alias("refs"))
    items = items.select("item_id", (F.col("item_id") % 10).alias("group_id"), F.lit(1).alias("start"), "refs", F.when(F.col("item_id") % 2 == 0, "v0+v1+v2").otherwise("v1").alias("snapshot"))
    sources = driver_table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct().select("id", F.concat(F.lit("title of "), "id").alias("title"))
    queue = review.review_queue(items, chunks, sources)
    return queue.select("item_id", "group_id", F.array_join("evidence", ",").alias("evidence"), F.array_join("missing", ",").alias("missing"), "citation", "mismatch")


def cited_problems(spark, d):
    lines, chunks = _refs(spark, d)
    items = lines.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_list("chunk_id").alias("refs"))
    return review.cited_problems(items, chunks).groupBy("problem").agg(F.count("*").alias("n"))


def range_text(spark, d):
    """Turns of each conversation from the first to a derived end, one a line."""
    turns = driver_table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), (F.col("turn") + 1).cast("int").alias("anchor"), "text")
    items = turns.groupBy("group_id").agg(F.max("anchor").alias("n")).select(F.col("group_id").alias("item_id"), "group_id", F.lit(1).alias("start"), F.greatest(F.col("n") - 1, F.lit(1)).alias("end"))
    return review.range_text(items, turns.groupBy("group_id", "anchor").agg(F.min("text").alias("text"))).select("item_id", T.content_hash(F.col("text")).alias("sha"))


def _decisions(spark, d):
    word = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "escalate").when(F.col("event_type") == "click", "edit_approve").otherwise(F.col("event_type"))
    return driver_table(spark, d, "events").select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), word.alias("decision"), F.when(F.col("event_id") % 13 != 0, "r").alias("reviewer"), F.when(F.col("event_id") % 2 == 0, "t").alias("text"))


def decision_fold(spark, d):
    return review.fold_decisions(_decisions(spark, d)).select("item_id", "seq", "decision", "outcome", F.coalesce("status", F.lit("")).alias("status"))


def final_decisions(spark, d):
    return review.final_decisions(_decisions(spark, d)).select("item_id", "status", "seq")


_DECISIONS_SQL = """l AS (SELECT user_id AS item_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'escalate' WHEN 'click' THEN 'edit_approve' ELSE event_type END AS decision, event_id % 13 = 0 AS anonymous, event_id % 2 <> 0 AS no_text FROM events),
s AS (SELECT *, CASE decision WHEN 'approve' THEN 'published' WHEN 'edit_approve' THEN 'published' WHEN 'reject' THEN 'rejected' WHEN 'escalate' THEN 'pending' END AS status FROM l),
e AS (SELECT *, anonymous OR status IS NULL OR (decision = 'edit_approve' AND no_text) AS bad FROM s)"""


def introduction_state(spark, d):
    rows = driver_table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("group_id"), F.substring("o_orderpriority", 1, 1).alias("style"), F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderkey") % 50 == 0, "pending").otherwise("rejected").alias("review_status"))
    return review.introduction_state(rows)


def rerun_policy(spark, d):
    orders = driver_table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderkey") % 4 != 0, "pending")
    action = rules.rerun_action(status, F.col("o_orderkey") % 3, F.col("o_custkey") % 2, F.lit(1), F.lit(0))
    return orders.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def attempt_outcomes(spark, d):
    o = driver_table(spark, d, "orders")
    flag = lambda n, r=0: F.col("o_orderkey") % n != r
    outcome = rules.attempt_outcome(flag(5), flag(7), flag(11), ~flag(13), flag(17), F.when(F.col("o_orderkey") % 19 == 0, "empty"), flag(23))
    return o.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def cross_source_verify(spark, d):
    """Names from a primary and two more sources with planted differences."""
    names = driver_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text"))
    stored = names.where(F.col("key") % 40 != 1).select("key", F.when(F.col("key") % 41 == 2, "other").otherwise(F.col("text")).alias("text"), F.when(F.col("key") % 43 == 3, "bad").otherwise(T.content_hash(F.col("text"))).alias("content_hash"))
    second = names.where(F.col("key") % 47 != 4).select("key", F.when(F.col("key") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.replace("text", F.lit(" "), F.lit(""))).alias("text"))
    third = names.where(F.col("key") % 3 != 0).select("key", F.when(F.col("key") % 7 == 0, F.concat("text", F.lit("y"))).otherwise(F.col("text")).alias("text"))
    return verify.cross_verify(stored, names, second, third)


def verification_tally(spark, d):
    return verify.verification_tally(cross_source_verify(spark, d))


def verification_summary(spark, d):
    """Documents against two other sources that differ by language, with lost and surplus rows: all counts, zeros too."""
    docs = driver_table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    primary = docs.select("key", "text")
    stored = docs.where(~F.coalesce(F.col("source") == "src3", F.lit(False))).select("key", F.when(F.col("lang") == "es", F.concat("text", F.lit("z"))).otherwise(F.col("text")).alias("text"), T.content_hash(F.col("text")).alias("content_hash"))
    surplus = docs.where("source = 'src4'").select((-F.col("key") - 1).alias("key"), "text", T.content_hash(F.col("text")).alias("content_hash"))
    second = docs.where("lang is not null and lang <> 'de'").select("key", F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.replace("text", F.lit(" "), F.lit(""))).alias("text"))
    third = docs.where("source <> 'src1'").select("key", F.when(F.col("source") == "src2", F.concat("text", F.lit("y"))).otherwise(F.col("text")).alias("text"))
    stored = stored.unionByName(surplus)
    return verify.verification_summary(verify.cross_verify(stored, primary, second, third), primary, second, stored)


def reader_page(spark, d):
    """Anchors with the latest explanation and media of each."""
    lines = driver_table(spark, d, "lineitem")
    anchors = driver_table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.lit(1).alias("anchor"))
    seq = F.struct("l_partkey", "l_suppkey", "l_extendedprice")
    text = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("group_id"), F.lit(1).alias("start"), F.col("l_partkey").cast("string").alias("text"), seq.alias("seq"))
    media = lines.where("l_linenumber = 1 and l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("group_id"), F.lit(1).alias("anchor"), F.col("l_suppkey").cast("string").alias("url"), seq.alias("seq"))
    return review.reader_page(anchors, text, media).select("group_id", F.coalesce("explanation", F.lit("")).alias("explanation"), F.coalesce("url", F.lit("")).alias("url"))


_NAMES = (
    "group_scan point_lookup ordered_list narrowed delta_plan upsert_prune vector_upsert undecided_upsert approval_gate latest_status duplicate_keys batches numbered_documents missing_grid grid_audit "
    "pin_resolution attribution review_queue cited_problems range_text decision_fold final_decisions introduction_state rerun_policy attempt_outcomes cross_source_verify verification_tally verification_summary reader_page"
)
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_OLD_NEW = """docs AS (SELECT doc_id AS id, source, sha256(text) AS hash FROM documents),
old AS (SELECT id, source, CASE WHEN id % 6 = 0 THEN 'stale' ELSE hash END AS hash, CASE WHEN id % 10 = 4 THEN 'm0' ELSE 'm1' END AS model FROM docs WHERE id % 2 = 0),
new AS (SELECT id, source, hash, 'm1' AS model FROM docs WHERE id % 9 <> 5)"""
_REFS_SQL = """refs AS (SELECT l_orderkey AS item_id, l_linenumber AS n, 'c' || l_partkey AS chunk_id FROM lineitem),
c AS (SELECT 'c' || p_partkey AS chunk_id, p_brand AS source_id, 'v' || (p_size % 3) AS source_version, p_size % 4 <> 0 AS verified FROM part WHERE p_partkey % 7 <> 0)"""
_VERIFY_SQL = f"""n AS (SELECT c_custkey AS key, c_name AS text FROM customer),
s AS (SELECT key, CASE WHEN key % 41 = 2 THEN 'other' ELSE text END AS text, CASE WHEN key % 43 = 3 THEN 'bad' ELSE sha256(text) END AS h FROM n WHERE key % 40 <> 1),
b AS (SELECT key, CASE WHEN key % 5 = 0 THEN text || 'x' ELSE replace(text, ' ', '') END AS text FROM n WHERE key % 47 <> 4),
t AS (SELECT key, CASE WHEN key % 7 = 0 THEN text || 'y' ELSE text END AS text FROM n WHERE key % 3 <> 0),
j AS (SELECT n.key, coalesce(s.text = n.text, false) AS stored_ok, coalesce(s.h = sha256(s.text), false) AS hash_ok, s.text IS NULL AS lost, b.text IS NOT NULL AND {letter_key_sql('b.text')} <> {letter_key_sql('n.text')} AS bb, t.text IS NOT NULL AND {letter_key_sql('t.text')} <> {letter_key_sql('n.text')} AS tb, t.text IS NULL AS no_third
  FROM n LEFT JOIN s USING (key) LEFT JOIN b USING (key) LEFT JOIN t USING (key)),
v AS (SELECT key, stored_ok, hash_ok, CASE WHEN lost THEN 'not_stored' WHEN NOT stored_ok THEN 'differs' WHEN NOT hash_ok THEN 'bad_hash' WHEN bb THEN CASE WHEN no_third THEN 'unsettled' WHEN tb THEN 'disputed' ELSE 'confirmed' END ELSE 'ok' END AS verdict, tb AND NOT bb AS third_only FROM j)"""

ORACLES = {
    "group_scan": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'",
    "point_lookup": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7",
    "ordered_list": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "narrowed": "SELECT count(*) FILTER (WHERE value > 1 AND event_type <> 'error') AS kept, count(*) FILTER (WHERE NOT coalesce(value > 1 AND event_type <> 'error', false)) AS rejected FROM events",
    "delta_plan": f"WITH {_OLD_NEW}, p AS (SELECT CASE WHEN old.model = new.model THEN 'reuse' ELSE 'embed' END AS state FROM new LEFT JOIN old USING (id)) SELECT count(*) AS total, count(*) FILTER (WHERE state = 'reuse') AS reused, count(*) FILTER (WHERE state = 'embed') AS pending, CAST(ceil(count(*) FILTER (WHERE state = 'embed') / 32.0) AS BIGINT) AS calls FROM p",
    "upsert_prune": f"WITH {_OLD_NEW}, u AS (SELECT coalesce(new.id, old.id) AS id, coalesce(new.source, old.source) AS source, coalesce(new.hash, old.hash) AS hash, coalesce(new.model, old.model) AS model, old.id IS NULL AS created_now, new.id IS NOT NULL AS updated_now FROM old FULL OUTER JOIN new ON old.id = new.id) SELECT * FROM u WHERE source <> 'src4' OR updated_now",
    "vector_upsert": "SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN 'new' ELSE 'old' END AS state, vec_id % 6 = 0 OR vec_id % 3 <> 0 AS has_vector FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, 'missing', false FROM embeddings WHERE vec_id % 6 = 0 AND vec_id % 4 = 0",
    "undecided_upsert": "WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS st, o_orderkey % 3 <> 0 AS stored, o_orderkey % 2 = 0 AS draft FROM orders), r AS (SELECT CASE WHEN draft AND NOT (stored AND st <> 'pending') THEN 'pending' ELSE st END AS review_status, CASE WHEN draft AND NOT (stored AND st <> 'pending') THEN 'new' ELSE 'old' END AS text, NOT (stored AND draft AND st = 'pending') AS untouched FROM o WHERE stored OR draft) SELECT review_status, text, untouched, count(*) AS n FROM r GROUP BY ALL",
    "approval_gate": "SELECT doc_id, coalesce(quality = 1 AND toxic = 0, false) AS usable, (doc_id % 3 = 0) <> coalesce(quality = 1 AND toxic = 0, false) OR quality IS NULL AS changed FROM documents LEFT JOIN labels USING (doc_id)",
    "latest_status": "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "batches": "SELECT source, count(*) AS documents, CAST(floor((count(*) - 1) / 32) + 1 AS BIGINT) AS last_batch, CAST(ceil(count(*) / 32.0) AS BIGINT) AS calls FROM documents GROUP BY source",
    "numbered_documents": "SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) - 1 AS number, CAST(floor((row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) - 1) / 32) AS BIGINT) AS batch FROM documents",
    "missing_grid": "SELECT n_nationkey, segment FROM nation, (SELECT DISTINCT c_mktsegment AS segment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000",
    "grid_audit": "WITH h AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, count(*) AS n, count(*) FILTER (WHERE contains(lower(url), 'example.com') OR contains(lower(url), 'placeholder') OR contains(lower(url), 'localhost')) AS p FROM pages GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(p) AS BIGINT) AS placeholders FROM h",
    "pin_resolution": """WITH docs AS (SELECT doc_id, source || '-' || lang AS source, text FROM documents), v AS (SELECT 'v' || doc_id AS id, source, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) ELSE '' END AS h FROM docs WHERE doc_id % 17 = 3),
g AS (SELECT source AS id, min(doc_id) AS k, min(doc_id) FILTER (WHERE doc_id % 17 = 3) AS own FROM docs GROUP BY source),
s AS (SELECT id, CASE k % 4 WHEN 0 THEN 'v' || own WHEN 1 THEN 'v3' WHEN 2 THEN 'v-none' END AS ptr FROM g), o AS (SELECT source AS id, count(*) AS n, min(id) AS only_v, min(h) AS only_h FROM v GROUP BY source),
r AS (SELECT s.id, ptr, only_v, CASE WHEN coalesce(ptr, '') <> '' THEN CASE WHEN p.id IS NULL THEN 'dangling_pointer' WHEN p.source <> s.id THEN 'wrong_owner' WHEN p.h = '' THEN 'no_hash' ELSE '' END WHEN coalesce(o.n, 0) = 0 THEN 'none' WHEN o.n > 1 THEN 'ambiguous' WHEN only_h = '' THEN 'no_hash' ELSE '' END AS reason FROM s LEFT JOIN v p ON p.id = s.ptr LEFT JOIN o ON o.id = s.id)
SELECT id, CASE WHEN reason <> '' THEN '' WHEN coalesce(ptr, '') <> '' THEN ptr ELSE only_v END AS version, reason FROM r""",
    "attribution": f"""WITH {_REFS_SQL}, j AS (SELECT item_id, n - 1 AS pos, coalesce(source_id, '') AS source_id, source_version, CASE WHEN source_id IS NULL THEN 'missing_chunk' WHEN source_id LIKE '%3' THEN 'unusable_source' WHEN source_version <> 'v1' THEN 'version_mismatch' END AS problem FROM refs LEFT JOIN c USING (chunk_id))
SELECT item_id, source_id, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS citations, coalesce(string_agg(DISTINCT source_version, '+' ORDER BY source_version), '') AS snapshot, coalesce(max(problem), '') AS problem FROM j GROUP BY item_id, source_id""",
    "review_queue": f"""WITH {_REFS_SQL}, j AS (SELECT item_id, n, refs.chunk_id, source_id, source_version FROM refs LEFT JOIN c USING (chunk_id)),
g AS (SELECT item_id, coalesce(string_agg(chunk_id, ',' ORDER BY n, chunk_id) FILTER (WHERE source_id IS NOT NULL), '') AS evidence, coalesce(string_agg(chunk_id, ',' ORDER BY n, chunk_id) FILTER (WHERE source_id IS NULL), '') AS missing, coalesce('title of ' || first(source_id ORDER BY n, chunk_id) FILTER (WHERE source_id IS NOT NULL), '') AS citation, string_agg(DISTINCT source_version, '+' ORDER BY source_version) AS snap FROM j GROUP BY item_id)
SELECT item_id, item_id % 10 AS group_id, evidence, missing, citation, evidence <> '' AND snap <> CASE WHEN item_id % 2 = 0 THEN 'v0+v1+v2' ELSE 'v1' END AS mismatch FROM g""",
    "cited_problems": f"WITH {_REFS_SQL} SELECT CASE WHEN verified IS NULL THEN 'missing' ELSE 'unverified' END AS problem, count(*) AS n FROM refs LEFT JOIN c USING (chunk_id) WHERE verified IS NULL OR NOT verified GROUP BY 1",
    "range_text": "WITH t AS (SELECT conv_id, turn + 1 AS anchor, min(text) AS text FROM conversations GROUP BY ALL), n AS (SELECT conv_id, greatest(max(anchor) - 1, 1) AS e FROM t GROUP BY conv_id) SELECT n.conv_id AS item_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY anchor) FILTER (WHERE trim(text) <> ''), '')) AS sha FROM n LEFT JOIN t ON t.conv_id = n.conv_id AND anchor BETWEEN 1 AND e GROUP BY n.conv_id",
    "decision_fold": f"WITH {_DECISIONS_SQL}, f AS (SELECT *, coalesce(max(CASE WHEN NOT bad AND status IN ('published', 'rejected') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS closed FROM e) SELECT item_id, seq, decision, CASE WHEN closed THEN 'not_pending' WHEN bad THEN 'error' ELSE 'applied' END AS outcome, coalesce(status, '') AS status FROM f",
    "final_decisions": f"WITH {_DECISIONS_SQL} SELECT item_id, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts, seq) AS r FROM e WHERE NOT bad AND status IN ('published', 'rejected')) WHERE r = 1",
    "introduction_state": "WITH r AS (SELECT o_custkey % 200 AS group_id, left(o_orderpriority, 1) AS style, CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderkey % 50 = 0 THEN 'pending' ELSE 'rejected' END AS st FROM orders) SELECT group_id, style, CASE WHEN bool_or(st = 'published') THEN 'published' WHEN bool_or(st = 'pending') THEN 'processing' ELSE 'unavailable' END AS state FROM r GROUP BY ALL",
    "rerun_policy": "WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'P' THEN 'rejected' WHEN o_orderkey % 4 <> 0 THEN 'pending' END AS st FROM orders) SELECT CASE WHEN st IS NULL THEN 'generate' WHEN st <> 'pending' THEN 'skip_decided' WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN 'skip_same' ELSE 'regenerate' END AS action, count(*) AS n FROM r GROUP BY 1",
    "attempt_outcomes": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'insufficient_evidence' WHEN o_orderkey % 7 = 0 THEN 'invalid_grounding' WHEN o_orderkey % 11 = 0 THEN 'corpus_mismatch' WHEN o_orderkey % 13 = 0 THEN 'dry_run' WHEN o_orderkey % 17 = 0 THEN 'provider_error' WHEN o_orderkey % 19 = 0 THEN 'validation_failed' WHEN o_orderkey % 23 = 0 THEN 'write_failed' ELSE 'pending' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "cross_source_verify": f"WITH {_VERIFY_SQL} SELECT key, stored_ok, hash_ok, verdict, third_only FROM v",
    "verification_tally": f"WITH {_VERIFY_SQL} SELECT verdict, count(*) AS n FROM v GROUP BY verdict",
    "verification_summary": f"""WITH d AS (SELECT doc_id AS key, coalesce(text, '') AS text, lang, source FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT key, CASE WHEN lang = 'es' THEN text || 'z' ELSE text END AS text, sha256(text) AS h FROM d WHERE NOT coalesce(source = 'src3', false) UNION ALL SELECT -key - 1, text, sha256(text) FROM d WHERE source = 'src4'),
b AS (SELECT key, CASE WHEN lang = 'fr' THEN text || 'x' ELSE replace(text, ' ', '') END AS text FROM d WHERE lang IS NOT NULL AND lang <> 'de'), t AS (SELECT key, CASE WHEN source = 'src2' THEN text || 'y' ELSE text END AS text FROM d WHERE source <> 'src1'),
j AS (SELECT d.key, coalesce(s.text = d.text, false) AS stored_ok, coalesce(s.h = sha256(s.text), false) AS hash_ok, s.text IS NULL AS lost, b.text IS NOT NULL AND {letter_key_sql('b.text')} <> {letter_key_sql('d.text')} AS bb, t.text IS NOT NULL AND {letter_key_sql('t.text')} <> {letter_key_sql('d.text')} AS tb, t.text IS NULL AS no_third
  FROM d LEFT JOIN s USING (key) LEFT JOIN b USING (key) LEFT JOIN t USING (key)),
v AS (SELECT CASE WHEN lost THEN 'not_stored' WHEN NOT stored_ok THEN 'differs' WHEN NOT hash_ok THEN 'bad_hash' WHEN bb THEN CASE WHEN no_third THEN 'unsettled' WHEN tb THEN 'disputed' ELSE 'confirmed' END ELSE 'ok' END AS verdict, tb AND NOT bb AS third_only FROM j)
SELECT what, (SELECT count(*) FROM v WHERE verdict = what) AS n FROM (VALUES ('ok'), ('confirmed'), ('disputed'), ('unsettled'), ('not_stored'), ('differs'), ('bad_hash')) l(what)
UNION ALL SELECT 'skipped', count(*) FROM d WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'extras', count(*) FROM s WHERE key NOT IN (SELECT key FROM d)
UNION ALL SELECT 'third_only', count(*) FILTER (WHERE third_only) FROM v UNION ALL SELECT 'total', count(*) FROM v""",
    "reader_page": "WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS m FROM lineitem WHERE l_linenumber = 1) SELECT o_orderkey AS group_id, coalesce(CAST(a.l_partkey AS VARCHAR), '') AS explanation, coalesce(CAST(b.l_suppkey AS VARCHAR), '') AS url FROM orders LEFT JOIN x a ON a.l_orderkey = o_orderkey AND a.r = 1 LEFT JOIN x b ON b.l_orderkey = o_orderkey AND b.m = 1 AND b.l_suppkey % 2 = 0",
}
