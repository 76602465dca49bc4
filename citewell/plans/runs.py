"""Queries over whole runs: increments by bucket, committed ingests, batches of embedding."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.operators import contract, embedding, introduction, rules
from citewell.operators import ingest as ingest_run
from citewell.plans import maintenance
from citewell.plans.common import clean_html_sql, clean_page, lexical_sql, paragraphs_sql
from citewell.plans.texts import CAP, _pack_sql
from citewell.sources import commits as K
from citewell.sources.shared import folder, keep, scratch
from citewell.sources.tables import driver_table, text_table

T0, T1 = "2024-01-01 00:00:00", maintenance.NOW
WIDTH = 8
STORED = "id long, source string, hash string, model string, created_at timestamp, updated_at timestamp"


def at(moment: str):
    return F.lit(moment).cast("timestamp")


def bucket_upsert(spark, d):
    """upsert_prune by buckets: the stored table, an increment and a prune of one source, each made visible by a commit."""
    old, new = maintenance._old_new(spark, d)
    log = K.Commits(spark, folder(spark, "store"))
    log.commit(0, [K.upsert(log, "chunks", old, ["id"], at(T0), STORED, 16)])
    stage = K.upsert(log, "chunks", new, ["id"], at(T1), STORED, 16)
    stage = K.prune(log, "chunks", new.select("id"), {"source": "src4"}, ["id"], staged=stage)
    log.commit(1, [stage])
    now = at(T1)
    return log.read("chunks").select("id", "source", "hash", "model", (F.col("created_at") == now).alias("created_now"), (F.col("updated_at") == now).alias("updated_now"))


# ---------------------------------------------------------------- ingest


def unit_vectors(texts: list[str]) -> list[list[float]]:
    """A deterministic embedder: the unit vector along the axis that the text's length picks."""
    return [[1.0 if i == len(t) % WIDTH else 0.0 for i in range(WIDTH)] for t in texts]


def _documents(pages, first: bool):
    """Clean pages as documents of four sources; the first run lacks every third page and has other texts of every tenth."""
    text = F.col("text")
    if first:
        pages = pages.where("page_id % 3 <> 0")
        text = F.when(F.col("page_id") % 10 == 1, F.concat(text, F.lit(" before"))).otherwise(text)
    section = F.struct(F.lit(0).alias("ordinal"), F.lit(0).alias("group_id"), F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("single_ayah").alias("mapping_type"), text.alias("text"))
    source = F.format_string("web%d", F.col("page_id") % 4)
    return pages.where(~T.is_blank(text)).select(F.col("page_id").cast("string").alias("id"), source.alias("source_id"), F.lit("").alias("source_version"), F.lit("").alias("language"), F.lit("").alias("content_type"), F.lit(1).alias("group_id"), F.array(section).alias("sections"))


def _ingested(spark, d):
    sources = spark.range(4).select(F.format_string("web%d", "id").alias("id"), F.lit("verified").alias("verification_status"), F.lit("cleared").alias("licensing_status"), F.lit("v1").alias("version_id"), F.lit("h").alias("version_hash"), F.lit("en").alias("language"), F.lit(1).alias("authority_tier"))
    log = K.Commits(spark, folder(spark, "store"))
    with scratch("ingested"):
        pages = keep(text_table(spark, d, "pages", "page_id", "html").select("page_id", clean_page(F.col("html")).alias("text")), "pages", "zstd")  # cleaned once for both runs
        run = lambda first, moment: ingest_run.ingest(log, _documents(pages, first), sources, unit_vectors, "m1", WIDTH, at(moment), CAP, buckets=16)
        run(True, T0)
        return log, run(False, T1)


def ingest_report(spark, d):
    """Two committed ingests of all pages: what the second reused, embedded and dropped, and what the tables hold then."""
    log, report = _ingested(spark, d)
    chunks, maps, status = log.read("chunks"), log.read("mappings"), log.read("status")
    stored = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("ids"), F.count("embedding").alias("vectors"), F.count_if(F.col("created_at") == at(T1)).alias("created_now"), F.count_if(F.element_at("embedding", (F.length("text") % WIDTH + 1).cast("int")) == 1).alias("own_vectors"))
    counts = [F.lit(report[k]).cast("long").alias(k) for k in ("total", "reused", "pending", "calls", "written", "mapped", "deleted", "deleted_mappings")]
    orphans = maps.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").agg(F.count("*").alias("orphans"))
    done = status.agg(F.count_if(F.col("status") == "ingested").alias("sources"))
    return stored.select(*counts, "*").crossJoin(orphans).crossJoin(done)  # tables of one row


def _chunks_sql(name: str, text: str, where: str) -> str:
    pack, nul = _pack_sql("paragraph"), "chr(0)"
    key = f"source || {nul} || 'v1' || {nul} || page_id || {nul} || '1' || {nul} || '1' || {nul} || 'single_ayah' || {nul}"
    return f"""
{name}0 AS (SELECT page_id, 'web' || page_id % 4 AS source, {text} AS text FROM (SELECT page_id, {clean_html_sql('html')} AS t FROM pages WHERE {where})),
{name}1 AS (SELECT page_id, source, unnest({paragraphs_sql('text')}) AS paragraph, generate_subscripts({paragraphs_sql('text')}, 1) AS p FROM {name}0),
{name}2 AS (SELECT page_id, source, p, unnest({pack}) AS piece, generate_subscripts({pack}, 1) AS r FROM {name}1),
{name}3 AS (SELECT *, sha256(piece) AS h, row_number() OVER (PARTITION BY page_id, sha256(piece) ORDER BY p, r) - 1 AS dup FROM {name}2),
{name} AS (SELECT source, piece, sha256({key} || h || {nul} || dup || {nul}) AS id FROM {name}3)"""


def _ingest_sql() -> str:
    return f"""
WITH {_chunks_sql('a', "CASE WHEN page_id % 10 = 1 THEN t || ' before' ELSE t END", 'page_id % 3 <> 0')}, {_chunks_sql('b', 't', 'true')},
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE id IN (SELECT id FROM a)) AS reused, count(DISTINCT id) AS ids FROM b),
g AS (SELECT count(*) AS gone FROM (SELECT DISTINCT id FROM a WHERE id NOT IN (SELECT id FROM b)))
SELECT total, reused, total - reused AS pending, CAST(ceil((total - reused) / 32.0) AS BIGINT) AS calls, total - reused AS written, total - reused AS mapped, gone AS deleted, gone AS deleted_mappings, ids AS chunks, ids, ids AS vectors, total - reused AS created_now, ids AS own_vectors, CAST(0 AS BIGINT) AS orphans, (SELECT count(DISTINCT source) FROM b) AS sources FROM n, g"""


# ---------------------------------------------------------------- batches


def faulty_vectors(texts: list[str]) -> list[list[float]]:
    """unit_vectors, with a fault for texts of some lengths: not finite, zero, unnormalised, too wide; or no vector at all."""
    out = []
    for text, v in zip(texts, unit_vectors(texts), strict=True):
        n = len(text) % 97
        out.append({1: [float("nan")] * WIDTH, 2: [0.0] * WIDTH, 3: [2 * x for x in v], 4: [*v, 0.0]}.get(n, v))
    return out[:-1] if len(texts[0]) % 31 == 5 else out


def batch_checks(spark, d):
    """Batches of 32 documents in order of their id: the range, and what an embedder's answer has wrong first."""
    docs = driver_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = embedding.embedded_rows(docs, faulty_vectors, WIDTH, ["id"])
    return rows.groupBy("batch").agg(F.min("n").alias("start"), (F.max("n") + 1).alias("end"), F.max("attempts").cast("long").alias("attempts"), F.count("embedding").alias("vectors"), F.coalesce(F.max("error"), F.lit("")).alias("error"))


_BATCH_SQL = f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS l, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
f AS (SELECT *, n // 32 AS batch, CASE l % 97 WHEN 1 THEN 'contains NaN or Inf' WHEN 2 THEN 'zero vector' WHEN 3 THEN 'not normalized (norm 2.0000)' WHEN 4 THEN 'expected {WIDTH} dimensions, got {WIDTH + 1}' END AS fault FROM n),
b AS (SELECT batch, min(n) AS s, max(n) + 1 AS e, count(*) AS c, arg_min(l, n) % 31 = 5 AS short, min(n) FILTER (WHERE fault IS NOT NULL) AS k FROM f GROUP BY batch)
SELECT b.batch, s AS start, e AS "end", CAST(1 AS BIGINT) AS attempts, CAST(CASE WHEN short OR k IS NOT NULL THEN 0 ELSE c END AS BIGINT) AS vectors, CASE WHEN short THEN 'got ' || (c - 1) || ' vectors for ' || c || ' texts' WHEN k IS NOT NULL THEN doc_id || ': ' || fault ELSE '' END AS error FROM b LEFT JOIN f ON f.n = k"""

# ---------------------------------------------------------------- introductions


def write_introduction(request: str) -> str:
    """A deterministic generator: what it answers follows from the number of evidence lines of the request."""
    lines = json.loads(json.loads(request)["body"])["evidence"].split("\n")
    n = len(lines)
    if n % 5 == 3:
        return "[]"
    claims = [{"text": "claim one", "source_refs": ["1"]}, {"text": "claim two", "source_refs": [str(n), "9"] if n % 5 == 2 else [str(n)]}]
    out = {"sections": [{"type": "context", "title": "t", "claims": claims}], "differing_reports": [{"text": "other", "source_refs": ["2"]}] if n > 1 else [], "requires_review": n % 5 != 4}
    return json.dumps(out)


def introduction_run(spark, d):
    """Two runs over the good documents of each hundred as evidence: outcomes, drafts, and what the second run asked."""
    docs = driver_table(spark, d, "documents").join(driver_table(spark, d, "labels"), "doc_id", "left")
    line = T.lexical_form(F.coalesce("text", F.lit("")))
    chunks = docs.where(line != "").select(F.col("doc_id").cast("string").alias("id"), F.floor(F.col("doc_id") / 100).alias("group_id"), F.col("doc_id").alias("start"), "source", line.alias("text"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("verified"))
    chunks = chunks.withColumnRenamed("source", "source_id").withColumn("source_version", F.concat(F.lit("v-"), F.col("source_id")))
    sources = docs.select("source").where("source is not null").distinct().select(F.col("source").alias("id"), F.concat(F.lit("v-"), F.col("source")).alias("version_id"), F.lit(True).alias("usable"))
    groups = docs.where("doc_id is not null").select(F.floor(F.col("doc_id") / 100).alias("group_id")).distinct()
    evidence = groups.join(introduction.load_evidence(chunks, sources), "group_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<id:string,source_id:string,source_version:string,text:string>>")))
    evidence = keep(evidence, "evidence")  # both runs read it
    log = K.Commits(spark, folder(spark, "store"))
    decided = docs.where("toxic = 1").select(F.floor(F.col("doc_id") / 100).alias("group_id")).distinct()  # a toxic document: somebody has decided
    values = [c for c in introduction.INTRODUCTIONS.replace(introduction.SECTIONS, "S").replace(introduction.CLAIMS, "C").split(", ")]
    blank = {c.split()[0]: F.lit(None).cast({"S": introduction.SECTIONS, "C": introduction.CLAIMS}.get(c.split()[1], c.split()[1])) for c in values if c.split()[0] not in ("group_id", "created_at", "updated_at")}
    planted = decided.select("group_id", *[v.alias(k) for k, v in (blank | {"style": F.lit("en"), "review_status": F.lit("published")}).items()])
    log.commit(0, [K.upsert(log, "introductions", planted, introduction.KEY, at(T0), introduction.INTRODUCTIONS, 8)])
    run = lambda moment: introduction.run(log, evidence, "en", "beginner", "brief", write_introduction, "m", at(moment), 8)
    done, _ = run(T1)
    again, counts = run(T1)
    drafts = log.read("introductions").select("group_id", "review_status", F.size("sections").alias("n_sections"), F.col("sections")[0]["content"].alias("content"), F.array_join("source_refs", ",").alias("refs"), F.col("source_version_snapshot").alias("snapshot"))
    joined = done.join(again.select("group_id", F.col("outcome").alias("outcome_again")), "group_id").join(drafts, "group_id", "left")
    return joined.select(
        "group_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"), "outcome_again", F.lit(counts["calls"]).cast("long").alias("calls_again"), F.coalesce("review_status", F.lit("")).alias("status"),
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("refs", F.lit("")).alias("refs"), F.coalesce("snapshot", F.lit("")).alias("snapshot"),
    )


def _introduction_sql() -> str:
    text = lexical_sql("coalesce(text, '')")
    return f"""
WITH x AS (SELECT doc_id, CAST(floor(doc_id / 100) AS BIGINT) AS group_id, source, {text} AS t, coalesce(quality = 1 AND toxic = 0, false) AS ok, toxic FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT group_id, coalesce(bool_or(toxic = 1), false) AS decided FROM x WHERE doc_id IS NOT NULL GROUP BY group_id),
e AS (SELECT group_id, doc_id, source, row_number() OVER (PARTITION BY group_id ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM x WHERE ok AND t <> '' AND source IS NOT NULL),
n AS (SELECT g.group_id, decided, coalesce(max(n), 0) AS n FROM g LEFT JOIN e USING (group_id) GROUP BY ALL),
o AS (SELECT *, CASE WHEN n = 0 THEN 'insufficient_evidence' WHEN n % 5 = 3 THEN 'invalid_output' WHEN n % 5 = 4 OR n % 5 = 2 AND n < 9 OR n = 9 AND n % 5 = 2 THEN 'invalid_draft' WHEN decided THEN 'decided' ELSE 'pending' END AS outcome FROM n),
cited AS (SELECT o.group_id, e.doc_id, source, CASE WHEN k = 1 THEN 1 WHEN k = n2.n THEN 2 WHEN k = 9 AND n2.n % 5 = 2 THEN 3 ELSE 4 END AS pos FROM o JOIN n n2 USING (group_id) JOIN e USING (group_id) WHERE k = 1 OR k = n2.n OR k = 9 AND n2.n % 5 = 2 OR k = 2 AND n2.n > 1),
r AS (SELECT group_id, string_agg(doc_id, ',' ORDER BY pos) AS refs, string_agg(DISTINCT 'v-' || source, '+' ORDER BY 'v-' || source) AS snapshot FROM cited GROUP BY group_id)
SELECT o.group_id, outcome, CASE WHEN outcome = 'invalid_output' THEN 'malformed' WHEN n % 5 = 4 THEN 'review not required' WHEN outcome = 'invalid_draft' THEN 'section 0 claim 1: source_ref does not resolve' ELSE '' END AS reason, outcome AS outcome_again, CAST(0 AS BIGINT) AS calls_again,
  CASE WHEN decided THEN 'published' WHEN outcome = 'pending' THEN 'pending' ELSE '' END AS status, CASE WHEN outcome = 'pending' THEN 'claim one claim two' ELSE '' END AS content, CASE WHEN outcome = 'pending' THEN refs ELSE '' END AS refs, CASE WHEN outcome = 'pending' THEN snapshot ELSE '' END AS snapshot FROM o LEFT JOIN r USING (group_id)"""


# ---------------------------------------------------------------- contracts and answers


_CONTRACT = {
    ("getConversation", 200): {
        "type": "object", "required": ["id", "turns"], "additionalProperties": False,
        "properties": {
            "id": {"type": "integer", "minimum": 1},
            "turns": {
                "type": "array", "maxItems": 6,
                "items": {
                    "type": "object", "required": ["turn", "role", "text"], "additionalProperties": False,
                    "properties": {"turn": {"type": "integer", "maximum": 5}, "role": {"type": "string", "enum": ["user", "assistant"]}, "text": {"type": "string", "minLength": 1, "maxLength": 1500}},
                },
            },
        },
    },
    ("getConversation", 404): {"type": "object", "required": ["error"], "properties": {"error": {"type": "string", "minLength": 1}}},
}


def contract_problems(spark, d):
    """Conversations rendered as JSON answers of an operation and status, held against a contract: problems by place."""
    talk = driver_table(spark, d, "conversations").where("conv_id is not null and turn is not null and role is not null and text is not null")
    turns = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.length("text")).alias("chars"))
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), "turns"))
    body = F.when(F.col("chars") > 5000, F.left(body, F.lit(4000))).otherwise(body)  # one that ends early
    status = F.when(F.size("turns") > 7, 500).when(F.col("answers") == 0, 404).otherwise(200)
    rows = turns.select(body.alias("body"), F.lit("getConversation").alias("operation"), status.alias("status"))
    found = contract.check_answers(rows, _CONTRACT).select(F.explode("problems").alias("p"))
    return found.groupBy(F.regexp_replace("p", r"\[\d+\]", "[]").alias("problem")).agg(F.count("*").alias("n"))


_CONTRACT_SQL = """
WITH t AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS answers, sum(length(text)) AS chars FROM t GROUP BY conv_id),
s AS (SELECT *, CASE WHEN n > 7 THEN 500 WHEN answers = 0 THEN 404 ELSE 200 END AS code, chars > 5000 AS cut FROM c), good AS (SELECT * FROM s WHERE code = 200 AND NOT cut), l AS (SELECT t.* FROM t JOIN good USING (conv_id)),
p AS (SELECT 'no contract for getConversation 500' AS problem FROM s WHERE code = 500
UNION ALL SELECT '$: not valid JSON' FROM s WHERE code <> 500 AND cut
UNION ALL SELECT '$.error: missing' FROM s WHERE code = 404 AND NOT cut
UNION ALL SELECT '$.id: below 1' FROM good WHERE conv_id < 1
UNION ALL SELECT '$.turns: more than 6 items' FROM good WHERE n > 6
UNION ALL SELECT '$.turns[].turn: above 5' FROM l WHERE turn > 5
UNION ALL SELECT '$.turns[].role: not one of the values, ' || role FROM l WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT '$.turns[].text: shorter than 1' FROM l WHERE text = ''
UNION ALL SELECT '$.turns[].text: longer than 1500' FROM l WHERE length(text) > 1500)
SELECT problem, count(*) AS n FROM p GROUP BY problem"""


def decoded_answers(spark, d):
    """Assistant turns as a provider's answers, whole and broken by the length of the text: the error of each, and the content."""
    talk = driver_table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text") % 13
    inner = F.to_json(F.struct(F.col("text").alias("content"), F.array(F.lit("1")).alias("source_refs")))
    inner = F.when(n == 1, F.lit("[]")).when(n == 2, F.lit('"x"')).when(n == 3, F.concat(inner, F.lit(" and more"))).when(n == 4, F.lit('{"content":""}')).when(n == 5, F.lit('{"content":7}')).otherwise(inner)
    part = F.struct(F.array(F.struct(inner.alias("text"))).alias("parts"))
    body = F.to_json(F.struct(F.array(F.struct(part.alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates")))
    body = F.when(n == 6, F.lit('{"candidates":[]}')).when(n == 7, F.lit('{"candidates":[{"content":{"parts":[]}}]}')).when(n == 8, F.lit('{"promptFeedback":{"blockReason":"SAFETY"}}')).when(n == 9, F.lit('{"error":{"message":"quota"}}')).when(n == 10, F.left(body, F.lit(30))).otherwise(body)
    out = talk.withColumn("a", rules.decode_answer(body, "content string, source_refs array<string>"))
    return out.select("conv_id", "turn", F.coalesce("a.error", F.lit("")).alias("error"), F.coalesce("a.finish", F.lit("")).alias("finish"), F.sha2(F.coalesce("a.value.content", F.lit("")), 256).alias("content"))


_DECODED_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) % 13 AS n FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, CASE WHEN n IN (1, 2, 3, 5) THEN 'malformed_output' WHEN n = 4 THEN 'empty_content' WHEN n = 6 THEN 'no_candidates' WHEN n = 7 THEN 'no_parts' WHEN n = 8 THEN 'blocked: SAFETY' WHEN n = 9 THEN 'error: quota' WHEN n = 10 THEN 'malformed' WHEN text = '' THEN 'empty_content' ELSE '' END AS error FROM t)
SELECT conv_id, turn, error, CASE WHEN n BETWEEN 6 AND 10 THEN '' ELSE 'STOP' END AS finish, sha256(CASE WHEN error = '' THEN text ELSE '' END) AS content FROM e"""

QUERIES = {f.__name__: f for f in (bucket_upsert, ingest_report, batch_checks, introduction_run, contract_problems, decoded_answers)}
ORACLES = {
    "bucket_upsert": maintenance.ORACLES["upsert_prune"], "ingest_report": _ingest_sql(), "batch_checks": _BATCH_SQL, "introduction_run": _introduction_sql(), "contract_problems": _CONTRACT_SQL, "decoded_answers": _DECODED_SQL,
}
