"""Queries over range-anchored retrieval, similarity, coverage and overlap.

Stand-ins: an order is a group and its line numbers are anchors; embeddings are chunk vectors, their label a group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell.functions import overlap
from citewell.functions.vectors import embedding_hash_udf
from citewell.operators import coverage as C
from citewell.operators import retrieval as R
from citewell.operators import shared_runs, verify
from citewell.plans.common import match_sql
from citewell.sources.tables import driver_table, text_table

K = 5


def _group_sizes(spark, d):
    return driver_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.max("l_linenumber").alias("n"))


def _mappings(spark, d):
    """A range mapping for each line item: start is its number, the length depends on its part; some are unanchored."""
    unanchored = F.col("l_suppkey") % 13 == 0
    end = F.col("l_linenumber") + (F.col("l_partkey") % 4).cast("int")
    rows = driver_table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("chunk_id"),
        F.col("l_orderkey").alias("group_id"),
        F.when(unanchored, 0).otherwise(F.col("l_linenumber")).alias("start"),
        F.when(unanchored, 0).otherwise(end).alias("end"),
        F.when(unanchored, "thematic").when(end > F.col("l_linenumber"), "multi_ayah").otherwise("single_ayah").alias("mapping_type"),
        (F.col("l_suppkey") % 5 != 0).alias("verified"),
        "l_partkey",
        "l_suppkey",
    )
    return rows.dropDuplicates(["chunk_id"])


_MAPPINGS_SQL = """m AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chunk_id, l_orderkey AS group_id, CASE WHEN l_suppkey % 13 = 0 THEN 0 ELSE l_linenumber END AS "start",
  CASE WHEN l_suppkey % 13 = 0 THEN 0 ELSE l_linenumber + l_partkey % 4 END AS "end", CASE WHEN l_suppkey % 13 = 0 THEN 'thematic' WHEN l_partkey % 4 > 0 THEN 'multi_ayah' ELSE 'single_ayah' END AS mapping_type, l_suppkey % 5 <> 0 AS verified, l_partkey, l_suppkey FROM lineitem),
g AS (SELECT l_orderkey AS group_id, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey),
grid AS (SELECT group_id, unnest(range(1, n + 1)) AS anchor FROM g)"""


def range_lookup(spark, d):
    """Verified chunks over every anchor of every group."""
    sizes = _group_sizes(spark, d)
    anchors = sizes.select("group_id", F.explode(F.sequence(F.lit(1), "n")).alias("anchor"))
    hits = R.exact_hits(anchors, _mappings(spark, d), sizes)
    return hits.groupBy("group_id", F.col("anchor").cast("long").alias("anchor")).agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunks"))


def _chunks(mappings):
    """Chunks of the mappings: some mappings are orphans, some chunks share a parent."""
    own = mappings.where(F.col("l_partkey") % 17 != 0)
    return own.select("chunk_id", "verified", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("g"), F.col("group_id").cast("string"))).alias("parent_id"))


_CHUNKS_SQL = "c AS (SELECT chunk_id, verified, CASE WHEN l_partkey % 3 = 0 THEN 'g' || group_id END AS parent_id FROM m WHERE l_partkey % 17 <> 0)"


def coverage_by_start(spark, d):
    m = _mappings(spark, d)
    found = C.coverage_by_start(m.drop("verified"), _chunks(m), _group_sizes(spark, d))
    return found.withColumn("anchor", F.col("anchor").cast("long"))


def coverage_by_range(spark, d):
    m = _mappings(spark, d)
    found = C.coverage_by_range(m.drop("verified"), _chunks(m), _group_sizes(spark, d))
    return found.withColumn("anchor", F.col("anchor").cast("long"))


def coverage_report(spark, d):
    m = _mappings(spark, d)
    return C.coverage_report(C.coverage_by_range(m.drop("verified"), _chunks(m), _group_sizes(spark, d)))


_COVERED = "count(*) AS chunks, count(*) FILTER (WHERE coalesce(verified, false)) AS usable, count(DISTINCT coalesce(parent_id, x.chunk_id)) AS parents, string_agg(DISTINCT mapping_type, ',' ORDER BY mapping_type) AS types"
_FILLED = "SELECT grid.group_id, grid.anchor, coalesce(chunks, 0) AS chunks, coalesce(usable, 0) AS usable, coalesce(parents, 0) AS parents, coalesce(types, '') AS types FROM grid LEFT JOIN agg ON agg.group_id = grid.group_id AND agg.anchor = grid.anchor"
_BY_RANGE = f"x AS (SELECT chunk_id, m.group_id, mapping_type, unnest(range(\"start\", \"end\" + 1)) AS anchor FROM m JOIN g USING (group_id) WHERE \"start\" >= 1 AND \"end\" <= n), agg AS (SELECT x.group_id, x.anchor, {_COVERED} FROM x LEFT JOIN c ON c.chunk_id = x.chunk_id GROUP BY x.group_id, x.anchor)"


def mapping_drift(spark, d):
    """Chunks and mappings of the same lines, some dropped on either side and some widened."""
    m = _mappings(spark, d)
    chunks = m.where(F.col("l_partkey") % 29 != 0)
    kept = m.where(F.col("l_partkey") % 31 != 0).withColumn("end", F.when(F.col("l_suppkey") % 37 == 0, F.col("end") + 1).otherwise(F.col("end")))
    return C.mapping_drift(kept, chunks)


def passages(spark, d):
    """Text of each anchor's pieces in order, as hashes."""
    from citewell.functions.text import content_hash

    pieces = driver_table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), (F.col("turn") % 2).alias("anchor"), F.col("turn").alias("ordinal"), F.col("role").alias("chunk_id"), "text")
    return C.passage_text(pieces).select("group_id", "anchor", content_hash(F.col("passage")).alias("sha"))


def cosine_topk(spark, d):
    """The five nearest of the same label for every vector whose id 100 divides, itself among them."""
    e = driver_table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group_id"), F.col("embedding").alias("v"))
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "group_id", "v")
    found = R.topk_in_group(queries, e.select(F.col("vec_id").alias("chunk_id"), "group_id", "v"), K)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _chain(spark, d):
    """The table has no roles: ids that 3 divides are mapped, every other vector is a thematic chunk; both have a verified flag."""
    e = driver_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    anchors = e.select(F.col("label").alias("group_id"), F.col("vec_id").cast("int").alias("anchor"), F.when(F.col("vec_id") % 41 != 0, F.col("v")).alias("v"))
    sizes = e.groupBy(F.col("label").alias("group_id")).agg((F.max("vec_id") + 2).alias("n"))
    mapped = (F.col("vec_id") % 3 == 0) & (F.col("vec_id") > 0)
    own = e.where(mapped)
    mappings = own.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("group_id"), F.col("vec_id").cast("int").alias("start"), (F.col("vec_id") + 1).cast("int").alias("end"), (F.col("vec_id") % 5 != 0).alias("verified"))
    thematic = e.where(~mapped).select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("group_id"), "v", (F.col("vec_id") % 4 != 1).alias("verified"))
    return R.evidence_chain(anchors, mappings, sizes, thematic, K)


def evidence_chain(spark, d):
    found = _chain(spark, d)
    return found.select("group_id", F.col("anchor").cast("long").alias("anchor"), "tier", F.col("rank").cast("long").alias("rank"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.coalesce(F.round("score", 6), F.lit(-9.0)).alias("score"))


_CHAIN_SQL = f"""WITH {_E},
x AS (SELECT a.label AS group_id, a.vec_id AS anchor, m.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY m.vec_id) AS rank FROM e a JOIN e m ON m.label = a.label AND m.vec_id % 3 = 0 AND m.vec_id > 0 AND m.vec_id % 5 <> 0 AND a.vec_id BETWEEN m.vec_id AND m.vec_id + 1),
gaps AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.group_id = e.label AND x.anchor = e.vec_id)),
s AS (SELECT q.label AS group_id, q.vec_id AS anchor, t.vec_id AS chunk_id, round(list_cosine_similarity(q.v, t.v), 12) AS sc FROM gaps q JOIN e t ON t.label = q.label AND NOT (t.vec_id % 3 = 0 AND t.vec_id > 0) AND t.vec_id % 4 <> 1 WHERE q.vec_id % 41 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id, anchor ORDER BY sc DESC, chunk_id) AS rank FROM s),
chain AS (SELECT group_id, anchor, 'exact' AS tier, rank, chunk_id, -9.0::DOUBLE AS score FROM x
UNION ALL SELECT group_id, anchor, 'thematic', rank, chunk_id, round(sc, 6) FROM k WHERE rank <= {K}
UNION ALL SELECT label, vec_id, 'insufficient', 0, -1, -9.0 FROM gaps WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.group_id = gaps.label AND k.anchor = gaps.vec_id))"""


def retrieval_verdicts(spark, d):
    failed = driver_table(spark, d, "embeddings").where("vec_id < 0").select(F.col("label").alias("group_id"), F.col("vec_id").alias("anchor"))
    return R.retrieval_verdicts(_chain(spark, d), failed)


def _audited(spark, d):
    e = driver_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = F.when(F.col("vec_id") % 11 == 1, F.lit(None)).when(F.col("vec_id") % 13 == 2, F.slice("v", 1, 63)).when(F.col("vec_id") % 17 == 3, F.transform("v", lambda x: x * 2)).when(F.col("vec_id") % 19 == 4, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    rows = e.select(F.col("vec_id").alias("id"), v.alias("v"), F.when(F.col("vec_id") % 23 == 5, "other").otherwise("m").alias("model"), (F.col("vec_id") % 29 != 6).alias("normalized"))
    rows = rows.withColumn("hash", F.when(F.col("id") % 31 != 7, embedding_hash_udf()(F.col("model"), F.col("v"))))
    return verify.vector_audit(rows, "m", 64, rehash=True)


def vector_audit(spark, d):
    return _audited(spark, d).select(F.col("id").alias("vec_id"), F.array_join("defects", ",").alias("defects"))


def vector_audit_tally(spark, d):
    return verify.defect_tally(_audited(spark, d))


def vector_hash_audit(spark, d):
    """Vectors that changed after they were hashed (some keep their width and length), and hashes of another model."""
    e = driver_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    hashed = embedding_hash_udf()(F.when(F.col("id") % 37 == 8, "m0").otherwise("m"), F.col("v"))
    now = F.when(F.col("id") % 7 == 1, F.transform("v", lambda x: -x)).when(F.col("id") % 13 == 2, F.slice("v", 1, 63)).otherwise(F.col("v"))
    rows = e.select("id", now.alias("v"), F.lit("m").alias("model"), F.lit(True).alias("normalized"), F.when(F.col("id") % 31 != 7, hashed).alias("hash"))
    return verify.vector_audit(rows, "m", 64, rehash=True).select(F.col("id").alias("vec_id"), F.array_join("defects", ",").alias("defects"))


_AUDIT_SQL = """a AS (SELECT vec_id, CASE WHEN vec_id % 11 = 1 THEN 'missing' ELSE array_to_string(list_filter([
  CASE WHEN vec_id % 13 = 2 THEN 'wrong_width' END,
  CASE WHEN vec_id % 13 <> 2 AND vec_id % 17 <> 3 AND vec_id % 19 = 4 THEN 'zero_norm' END,
  CASE WHEN (vec_id % 13 <> 2 AND vec_id % 17 = 3) OR (vec_id % 13 = 2 AND abs(sqrt(list_inner_product(v[:63], v[:63])) - 1) > 0.01) THEN 'not_normalized' END,
  CASE WHEN vec_id % 23 = 5 THEN 'foreign_model' END, CASE WHEN vec_id % 29 = 6 THEN 'not_marked_normalized' END, CASE WHEN vec_id % 31 = 7 THEN 'no_hash' END], lambda x: x IS NOT NULL), ',') END AS defects FROM e)"""



def _hash_sql(model: str, v: str) -> str:
    parts = f"list_transform({v}, lambda x: regexp_replace(CAST(x AS VARCHAR), '\\.0$', '') || chr(0))"
    return f"sha256({model} || chr(0) || array_to_string({parts}, '') || chr(1))"


_HASH_AUDIT_SQL = f"""h AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 1 THEN list_transform(v, lambda x: -x) WHEN vec_id % 13 = 2 THEN v[:63] ELSE v END AS now, CASE WHEN vec_id % 37 = 8 THEN 'm0' ELSE 'm' END AS model FROM e),
ha AS (SELECT vec_id, array_to_string(list_filter([CASE WHEN len(now) <> 64 THEN 'wrong_width' END, CASE WHEN abs(sqrt(list_inner_product(now, now)) - 1) > 0.01 THEN 'not_normalized' END,
  CASE WHEN vec_id % 31 = 7 THEN 'no_hash' WHEN {_hash_sql('model', 'v')} <> {_hash_sql("'m'", 'now')} THEN 'hash_mismatch' END], lambda x: x IS NOT NULL), ',') AS defects FROM h)"""


# ---------------------------------------------------------------- overlap


def _texts(spark, d):
    verses = driver_table(spark, d, "benchmark").select(F.col("item_id").alias("verse_id"), "text")
    return verses, text_table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "passage_id")


def quote_coverage(spark, d, **parameters):
    """Pairs of a benchmark item and a document that quotes at least half of it."""
    found = overlap.coverage_pairs_indexed(*_texts(spark, d), least=overlap.QUOTED, **parameters)
    return found.select(F.col("verse_id").alias("item_id"), F.col("passage_id").alias("doc_id"), "windows", "found", F.round("coverage", 6).alias("coverage"))


def quoted_run(spark, d, **parameters):
    """The longest run of words that each of these pairs shares."""
    found = overlap.scored_pairs(*_texts(spark, d), least=overlap.QUOTED, **parameters)
    return found.select(F.col("verse_id").alias("item_id"), F.col("passage_id").alias("doc_id"), "run")


def corroboration_queue(spark, d, **parameters):
    """Every benchmark item with the document that quotes it best and a verdict; weakest first.

    Only the document of best coverage is judged, and only at a coverage of 0.05 or more: below it the item is a gap
    even where a run of MIN_RUN words occurs, and runs in other documents are not looked at. The oracle does the same.
    """
    verses, passages = _texts(spark, d)
    scored = overlap.scored_pairs(verses, passages, least=0.05, best=True, **parameters)
    rows = verses.select("verse_id").join(scored, "verse_id", "left")
    word = overlap.verdict(F.col("run"), F.col("introduced"), F.col("coverage") >= overlap.QUOTED, has_passage=F.col("passage_id").isNotNull())
    return rows.select(F.col("verse_id").alias("item_id"), F.coalesce("passage_id", F.lit(-1)).alias("doc_id"), F.coalesce("run", F.lit(0).cast("long")).alias("run"), F.coalesce(F.round("coverage", 6), F.lit(0.0)).alias("coverage"), word.alias("verdict")).orderBy("run", "item_id")


def corroborated_items(spark, d):
    """Every benchmark item: the longest run of words that it shares with any document, which document, and the verdict.

    A run of MIN_RUN words in any document, or a document that quotes half of the item, corroborates it.
    """
    verses, passages = _texts(spark, d)
    runs = shared_runs.longest_runs(verses, passages)
    quoted = overlap.coverage_pairs_indexed(verses, passages, least=overlap.QUOTED).select("verse_id").distinct().withColumn("quoted", F.lit(True))
    rows = runs.join(quoted, "verse_id", "left").withColumn("quoted", F.coalesce("quoted", F.lit(False)))
    return rows.select(F.col("verse_id").alias("item_id"), F.coalesce("passage_id", F.lit(-1)).alias("doc_id"), "run", "quoted", overlap.verdict(F.col("run"), F.lit(False), F.col("quoted")).alias("verdict")).orderBy("run", "item_id")


_OVERLAP_SQL = f"""b AS (SELECT item_id, {match_sql('text')} AS v FROM benchmark), dd AS (SELECT doc_id, {match_sql('text')} AS p FROM documents),
w AS (SELECT item_id, unnest(list_transform(range(1, length(v) - 6), lambda i: substring(v, i, 8))) AS w FROM b WHERE length(v) >= 8 UNION ALL SELECT item_id, v FROM b WHERE length(v) BETWEEN 1 AND 7),
wd AS (SELECT item_id, w, count(*) AS times FROM w GROUP BY ALL), tot AS (SELECT item_id, sum(times) AS windows FROM wd GROUP BY item_id),
pairs AS (SELECT item_id, doc_id, CAST(any_value(windows) AS BIGINT) AS windows, CAST(sum(times) AS BIGINT) AS found FROM wd JOIN dd ON contains(p, w) JOIN tot USING (item_id) GROUP BY item_id, doc_id)"""
_RUN_SQL = """ws AS (SELECT item_id, doc_id, p, list_filter(string_split(v, ' '), lambda x: x <> '') AS words FROM {pairs} JOIN b USING (item_id) JOIN dd USING (doc_id)),
i AS (SELECT *, unnest(range(1, len(words) + 1)) AS lo FROM ws), ij AS (SELECT *, unnest(range(lo, len(words) + 1)) AS hi FROM i),
runs AS (SELECT item_id, doc_id, coalesce(max(hi - lo + 1) FILTER (WHERE contains(p, array_to_string(words[lo:hi], ' '))), 0) AS run FROM ij GROUP BY item_id, doc_id)"""


def readiness(spark, d):
    """State of each source and language: labelled good documents make it available, others processing."""
    docs = driver_table(spark, d, "documents").select("doc_id", "source", "lang")
    labels = driver_table(spark, d, "labels").select("doc_id", "quality", "toxic")
    flags = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(F.max(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("p"), F.max(F.col("quality").isNotNull().cast("int")).alias("u"), F.count("*").alias("documents"))
    return flags.select("source", "lang", F.when(F.col("p") == 1, "available").when(F.col("u") == 1, "processing").otherwise("unavailable").alias("state"), "documents")


_NAMES = "range_lookup coverage_by_start coverage_by_range coverage_report mapping_drift passages cosine_topk evidence_chain retrieval_verdicts vector_audit vector_audit_tally vector_hash_audit quote_coverage quoted_run corroboration_queue corroborated_items readiness"
QUERIES = {n: globals()[n] for n in _NAMES.split()}
_LIST = "string_agg(CAST(anchor AS VARCHAR), ',' ORDER BY anchor) FILTER (WHERE {})"
ORACLES = {
    "range_lookup": f"WITH {_MAPPINGS_SQL} SELECT grid.group_id, anchor, count(*) AS hits, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM grid JOIN g USING (group_id) JOIN m ON m.group_id = grid.group_id AND verified AND \"start\" >= 1 AND \"end\" <= n AND anchor BETWEEN \"start\" AND \"end\" GROUP BY ALL",
    "coverage_by_start": f"WITH {_MAPPINGS_SQL}, {_CHUNKS_SQL}, agg AS (SELECT x.group_id, \"start\" AS anchor, {_COVERED.replace('verified', 'c.verified')} FROM m x LEFT JOIN c ON c.chunk_id = x.chunk_id WHERE \"start\" > 0 GROUP BY x.group_id, \"start\") {_FILLED}",
    "coverage_by_range": f"WITH {_MAPPINGS_SQL}, {_CHUNKS_SQL}, {_BY_RANGE} {_FILLED}",
    "coverage_report": f"WITH {_MAPPINGS_SQL}, {_CHUNKS_SQL}, {_BY_RANGE}, f AS ({_FILLED}) SELECT group_id, count(*) AS anchors, count(*) FILTER (WHERE chunks > 0) AS covered, coalesce({_LIST.format('chunks = 0')}, '') AS gaps, coalesce({_LIST.format('chunks > 0 AND usable = 0')}, '') AS unusable, CAST(sum(chunks) AS BIGINT) AS chunks, CASE WHEN count(*) = count(*) FILTER (WHERE chunks > 0) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f GROUP BY group_id",
    "mapping_drift": f"""WITH {_MAPPINGS_SQL}, cc AS (SELECT * FROM m WHERE l_partkey % 29 <> 0), mm AS (SELECT * REPLACE (CASE WHEN l_suppkey % 37 = 0 THEN "end" + 1 ELSE "end" END AS "end") FROM m WHERE l_partkey % 31 <> 0)
SELECT * FROM (SELECT coalesce(cc.chunk_id, mm.chunk_id) AS chunk_id, CASE WHEN mm.chunk_id IS NULL THEN 'chunk_only' WHEN cc.chunk_id IS NULL THEN 'mapping_only' WHEN cc."end" <> mm."end" THEN 'mismatch' END AS shape FROM cc FULL OUTER JOIN mm ON cc.chunk_id = mm.chunk_id) WHERE shape IS NOT NULL""",
    "passages": "SELECT conv_id AS group_id, turn % 2 AS anchor, sha256(string_agg(' ' || text, '' ORDER BY turn, role, text)) AS sha FROM conversations GROUP BY conv_id, turn % 2",
    "cosine_topk": f"WITH {_E}, s AS (SELECT q.vec_id AS query_id, t.vec_id AS chunk_id, round(list_cosine_similarity(q.v, t.v), 12) AS sc FROM e q JOIN e t ON t.label = q.label WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS rank FROM s) SELECT query_id, rank, chunk_id, round(sc, 6) AS score FROM r WHERE rank <= {K}",
    "evidence_chain": f"{_CHAIN_SQL} SELECT * FROM chain",
    "retrieval_verdicts": f"{_CHAIN_SQL}, v AS (SELECT group_id, anchor, max(CASE tier WHEN 'exact' THEN 3 WHEN 'thematic' THEN 2 ELSE 1 END) AS t FROM chain GROUP BY group_id, anchor) SELECT verdict, n FROM (VALUES ('PASS_EXACT', 3), ('NEEDS_REVIEW_THEMATIC', 2), ('GAP_INSUFFICIENT_EVIDENCE', 1), ('ERROR', 9)) l(verdict, k), LATERAL (SELECT count(*) AS n FROM v WHERE t = k) UNION ALL SELECT 'TOTAL', count(*) FROM v",
    "vector_audit": f"WITH {_E}, {_AUDIT_SQL} SELECT vec_id, defects FROM a",
    "vector_audit_tally": f"WITH {_E}, {_AUDIT_SQL}, u AS (SELECT unnest(string_split(defects, ',')) AS defect FROM a WHERE defects <> '') SELECT defect, count(*) AS n FROM u GROUP BY defect UNION ALL SELECT 'VERDICT', CAST(count(*) > 0 AND count(*) FILTER (WHERE defects <> '') = 0 AS BIGINT) FROM a",
    "vector_hash_audit": f"WITH {_E}, {_HASH_AUDIT_SQL} SELECT vec_id, defects FROM ha",
    "quote_coverage": f"WITH {_OVERLAP_SQL} SELECT item_id, doc_id, windows, found, round(found / windows, 6) AS coverage FROM pairs WHERE found / windows >= {overlap.QUOTED}",
    "quoted_run": f"WITH {_OVERLAP_SQL}, {_RUN_SQL.format(pairs=f'(SELECT item_id, doc_id FROM pairs WHERE found / windows >= {overlap.QUOTED})')} SELECT * FROM runs",
    "corroboration_queue": f"""WITH {_OVERLAP_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY found / windows DESC, doc_id) AS r FROM pairs WHERE found / windows >= 0.05) WHERE r = 1), {_RUN_SQL.format(pairs='best')}
SELECT b.item_id, coalesce(best.doc_id, -1) AS doc_id, coalesce(run, 0) AS run, coalesce(round(found / windows, 6), 0.0) AS coverage,
  CASE WHEN best.doc_id IS NULL THEN 'gap' WHEN run >= {overlap.MIN_RUN} OR found / windows >= {overlap.QUOTED} OR contains(p, 'يخبر تعالي') OR contains(p, 'يقول تعالي') OR contains(p, 'قال تعالي') THEN 'corroborated' ELSE 'uncorroborated' END AS verdict
FROM b LEFT JOIN best ON best.item_id = b.item_id LEFT JOIN runs ON runs.item_id = b.item_id LEFT JOIN dd ON dd.doc_id = best.doc_id""",
    "corroborated_items": f"""WITH {_OVERLAP_SQL}, bw AS (SELECT item_id, list_filter(string_split(v, ' '), lambda x: x <> '') AS words FROM b), dw AS (SELECT doc_id, list_filter(string_split(p, ' '), lambda x: x <> '') AS words FROM dd),
gb AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(words) - {overlap.MIN_RUN - 2}), lambda i: array_to_string(words[i:i + {overlap.MIN_RUN - 1}], ' '))) AS g FROM bw WHERE len(words) >= {overlap.MIN_RUN}),
gd AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(words) - {overlap.MIN_RUN - 2}), lambda i: array_to_string(words[i:i + {overlap.MIN_RUN - 1}], ' '))) AS g FROM dw WHERE len(words) >= {overlap.MIN_RUN}),
near AS (SELECT DISTINCT item_id, doc_id FROM gb JOIN gd USING (g)), spaced AS (SELECT doc_id, ' ' || array_to_string(words, ' ') || ' ' AS t FROM dw),
lo AS (SELECT item_id, words, unnest(range(1, len(words) + 1)) AS lo FROM bw), stretch AS (SELECT item_id, lo, unnest(range(lo + {overlap.MIN_RUN - 1}, len(words) + 1)) AS hi, words FROM lo),
joined AS (SELECT item_id, hi - lo + 1 AS run, ' ' || array_to_string(words[lo:hi], ' ') || ' ' AS s FROM stretch),
hit AS (SELECT j.item_id, near.doc_id, max(run) AS run FROM joined j JOIN near USING (item_id) JOIN spaced USING (doc_id) WHERE contains(t, s) GROUP BY ALL),
top AS (SELECT item_id, doc_id, run FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY run DESC, doc_id) AS r FROM hit) WHERE r = 1),
quoted AS (SELECT DISTINCT item_id FROM pairs WHERE found / windows >= {overlap.QUOTED})
SELECT b.item_id, coalesce(doc_id, -1) AS doc_id, coalesce(run, 0) AS run, quoted.item_id IS NOT NULL AS quoted, CASE WHEN run >= {overlap.MIN_RUN} OR quoted.item_id IS NOT NULL THEN 'corroborated' ELSE 'uncorroborated' END AS verdict FROM b LEFT JOIN top ON top.item_id = b.item_id LEFT JOIN quoted ON quoted.item_id = b.item_id""",
    "readiness": "SELECT source, lang, CASE WHEN max(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) = 1 THEN 'available' WHEN max(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'processing' ELSE 'unavailable' END AS state, count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang",
}
