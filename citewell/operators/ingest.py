"""A whole ingest as one commit: gate, documents, chunks, checks, vectors, mappings, pruning, status and report.

Nothing is visible before the commit. Documents and chunks are checked in full before anything is embedded; what is
pending is embedded once and kept before it is used; chunks, mappings and the status of sources are staged in the
buckets that they touch and become visible together. A run that fails leaves the tables as they were, but for the
status of its sources, which a commit of its own sets to failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.functions.vectors import embedding_hash_udf
from citewell.operators import chunking, embedding
from citewell.operators.incremental import usable
from citewell.sources import commits as K
from citewell.sources.shared import keep, scratch

CHUNKS = (
    "id string, document_id string, parent_chunk_id string, source_id string, source_version string, source_version_hash string, language string, content_type string, authority_tier int, review_status string, "
    "group_id int, start int, end int, mapping_type string, text string, text_normalized string, content_hash string, dup int, model string, embedding array<double>, embedding_hash string, created_at timestamp, updated_at timestamp"
)
MAPPINGS = "chunk_id string, source_id string, source_version string, group_id int, start int, end int, mapping_type string, created_at timestamp, updated_at timestamp"
STATUS = "source_id string, source_version string, status string, created_at timestamp, updated_at timestamp"
ORDER = ["document_id", "ordinal", "paragraph", "part", "id"]


class Refused(ValueError):
    """A source that is not approved; its content may not be ingested."""


def complete_chunk_violations() -> Column:
    """chunking.chunk_violations, and the other required fields and the group."""
    more = [F.when(T.is_blank(F.col(c)), f"{c} missing") for c in ("document_id", "language", "mapping_type", "content_hash", "review_status")]
    more.append(F.when(T.is_blank_lexical(F.col("text")), "text_normalized missing"))
    more.append(F.when(F.coalesce("group_id", F.lit(0)) < 1, "group_id below 1"))
    return F.concat(chunking.chunk_violations(), F.array_compact(F.array(*more)))


def pinned(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with what their source gives: version and its hash, language and content type where they have none.

    A document that pins another version than its source's has the violation `version`.
    """
    own = sources.select(F.col("id").alias("source_id"), F.col("version_id").alias("_version"), F.col("version_hash").alias("source_version_hash"), F.col("language").alias("_language"), F.col("authority_tier"), usable().alias("_usable"))
    either = lambda a, b: F.when(T.is_blank(F.col(a)), b).otherwise(F.col(a))
    return documents.join(own, "source_id", "left").select(
        *[c for c in documents.columns if c not in ("source_version", "language", "content_type")],
        either("source_version", F.col("_version")).alias("source_version"), either("language", F.col("_language")).alias("language"), either("content_type", F.lit("tafsir")).alias("content_type"),
        "source_version_hash", "authority_tier", F.coalesce("_usable", F.lit(False)).alias("usable"), F.coalesce(~T.is_blank(F.col("source_version")) & (F.col("source_version") != F.col("_version")), F.lit(False)).alias("_other"),
    )


def document_facts(documents: DataFrame) -> DataFrame:
    """document_id, source_id, source_version, usable, violations of pinned documents: their own rules, the pin, a group."""
    more = F.array_compact(F.array(F.when(F.col("_other"), "source_version is not the pinned one"), F.when(F.coalesce("group_id", F.lit(0)) < 1, "group_id below 1")))
    own = chunking.document_violations(documents, "source_id", "source_version", "usable", more.alias("_more"))
    return own.select("document_id", "source_id", "source_version", "usable", F.concat("violations", "_more").alias("violations"))


def chunks_of(documents: DataFrame, model: str, cap: int, stored: DataFrame | None = None) -> DataFrame:
    """Chunks of pinned documents, with what a stored chunk carries but its normal form and its vector, and their order; stored: as in build_chunks."""
    also = ["language", "content_type", "authority_tier", "source_version_hash"]
    sections = documents.select(F.col("id").alias("document_id"), F.col("group_id").alias("doc_group_id"), "source_id", "source_version", *also, F.explode("sections").alias("s"))
    sections = sections.select("document_id", "doc_group_id", "source_id", "source_version", *also, "s.*")
    built = chunking.build_chunks(sections, cap, pack=T.pack_words_udf(cap), also=also, stored=stored)
    return built.drop("text_normalized").withColumns({"review_status": F.lit("pending"), "model": F.lit(model)})


def ingest(commits: K.Commits, documents: DataFrame, sources: DataFrame, embedder: embedding.Embedder | None, model: str, width: int, now: Column, cap: int = chunking.CHUNK_CAP, batch: int = 32, buckets: int = 64, prune: bool = True, dry_run: bool = False, preview: bool = False, attempts: int = 3, backoff: float = 0.5) -> dict[str, int]:
    """Runs one ingest and commits it; the report: total, reused, pending, calls, written, mapped, deleted, deleted_mappings, commit.

    documents: id, source_id, source_version, language, content_type, group_id, sections (array of ordinal, group_id,
    start, end, mapping_type, text); sources: id, verification_status, licensing_status, version_id, version_hash, language,
    authority_tier. A document of a source that is not approved is an error (Refused); a dry run may preview it. A
    dry run writes no table and calls no embedder. No documents: nothing is done.
    """
    base = commits.state()[0]
    with scratch("ingest"), scratch("ingest", "zstd") as lasting:
        known = pinned(documents, sources)
        facts = keep(document_facts(known), "facts")  # no texts
        refused = [r[0] for r in facts.where("not usable").select("source_id").distinct().orderBy("source_id").limit(5).collect()]
        if refused and not (preview and dry_run):
            raise Refused(f"sources not approved: {', '.join(map(str, refused))}")
        chunking.enforce(facts.select("document_id", "violations"), "documents")
        own = facts.select("source_id", "source_version").distinct()
        planned, report = _planned(commits, known, model, cap, batch, base)
        chunking.enforce(planned.select("id", "violations"), "chunks")
        if dry_run or not report["total"]:
            return report
        maps = planned.select(F.col("id").alias("chunk_id"), "source_id", "source_version", "group_id", "start", "end", "mapping_type")
        full = planned.where("state = 'embed'").drop("violations", "state")
        if report["pending"]:
            if embedder is None:
                raise ValueError("no embedder; only a dry run can do without one")
            try:
                full = embedding.embedded(full, embedder, width, ORDER, batch, attempts, backoff, lasting)
            except embedding.BatchError:
                commits.commit(base, [_status(commits, own, "failed", now, base)])
                raise
        else:
            full = full.withColumn("embedding", F.lit(None).cast("array<double>"))
        full = full.drop("ordinal", "paragraph", "part")
        ids = {"keep": planned.select("id"), "scope": own} if prune else {}
        chunks, report["deleted"] = K.upsert(commits, "chunks", full, ["id"], now, CHUNKS, buckets, base, finish=_derived, count=True, **ids)
        changed = maps
        if commits.state(base)[1].get("mappings"):
            changed = keep(maps.exceptAll(commits.read("mappings", MAPPINGS, number=base).select(*maps.columns)), "maps", "zstd")  # one that was lost comes back too
        report |= {"written": report["pending"], "mapped": changed.count()}
        ids = {"keep": maps.select("chunk_id"), "scope": own} if prune else {}
        mapped, report["deleted_mappings"] = K.upsert(commits, "mappings", changed, ["chunk_id"], now, MAPPINGS, buckets, base, count=True, **ids)
        report["commit"] = commits.commit(base, [chunks, mapped, _status(commits, own, "ingested", now, base)])
        return report


def _derived(chunks: DataFrame) -> DataFrame:
    """What a stored chunk's text and vector give; made where chunks are stored, so that it does not travel."""
    hashed = F.when(F.col("embedding").isNotNull(), embedding_hash_udf()(F.col("model"), F.col("embedding")))
    return chunks.withColumns({"text_normalized": T.lexical_form(F.col("text")), "content_hash": T.content_hash(F.col("text")), "embedding_hash": hashed})


def _planned(commits: K.Commits, documents: DataFrame, model: str, cap: int, batch: int, base: int) -> tuple[DataFrame, dict[str, int]]:
    """The chunks with their state (reuse, embed) and violations as a table, and the counts of a report; one job gives both.

    Chunks are checked in full here; what is reused leaves its text, which is stored, behind.
    """
    counts = Observation()
    built = chunks_of(documents, model, cap, commits.read("chunks", CHUNKS, number=base).select("id", "document_id", "model"))
    state = F.when(F.col("stored_model") == F.col("model"), "reuse").otherwise("embed")
    planned = built.withColumns({"state": state, "violations": complete_chunk_violations()}).drop("stored_model", "content_hash")
    planned = planned.withColumns({c: F.when(F.col("state") == "embed", F.col(c)) for c in ("text", "parent_chunk_id")})
    planned = keep(planned.observe(counts, F.count("*").alias("total"), F.count_if(F.col("state") == "reuse").alias("reused")), "planned", "zstd")
    report = {k: int(v) for k, v in counts.get.items()}
    pending = report["total"] - report["reused"]
    return planned, report | {"pending": pending, "calls": -(-pending // batch), "written": 0, "mapped": 0, "deleted": 0, "deleted_mappings": 0, "commit": base}


def _status(commits: K.Commits, own: DataFrame, status: str, now: Column, base: int) -> K.Stage:
    """A row for every source and version: small, one bucket."""
    return K.upsert(commits, "status", own.withColumn("status", F.lit(status)), ["source_id", "source_version"], now, STATUS, 1, base)
