"""Documents to content-addressed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.functions import text as T

CHUNK_CAP = 1200
#: Allowed words of enumerated columns.
MAPPING_TYPES = ("single_ayah", "multi_ayah", "surah_level", "thematic")
CONTENT_TYPES = ("tafsir", "historical_context", "lexical", "thematic")
INGESTION_STATUSES = ("not_started", "in_progress", "ingested", "failed")


def range_valid(mapping_type: Column, start: Column, end: Column) -> Column:
    """single: start = end >= 1; multi: 1 <= start <= end; unanchored types: 0/0; unknown or null type: no."""
    ok = (
        F.when(mapping_type == "single_ayah", (start >= 1) & (start == end))
        .when(mapping_type == "multi_ayah", (start >= 1) & (end >= start))
        .when(mapping_type.isin("surah_level", "thematic"), (start == 0) & (end == 0))
    )
    return F.coalesce(ok, F.lit(False))


def chunk_violations() -> Column:
    """array<string> of what is wrong with a chunk row; empty for a good one."""
    blank = lambda c: T.is_blank(F.col(c))
    return F.array_compact(
        F.array(
            *[F.when(blank(c), f"{c} missing") for c in ("id", "source_id", "source_version", "text")],
            F.when(~F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False)), "content_type unknown"),
            F.when(~F.coalesce(F.col("authority_tier").between(1, 3), F.lit(False)), "authority_tier out of range"),
            F.when(~range_valid(F.col("mapping_type"), F.col("start"), F.col("end")), "range invalid"),
            F.when(~F.col("content_hash").eqNullSafe(T.content_hash(F.col("text"))), "content_hash differs"),
        )
    )


def document_violations(documents: DataFrame, *more) -> DataFrame:
    """document_id, violations (and more columns, if asked for): of documents with an array of sections (ordinal, text, ...).

    An empty section is skipped; one of white space only is an error; a document needs one section with text.
    """
    blank = lambda c: T.is_blank(F.col(c))
    texts = F.coalesce(F.transform("sections", lambda s: F.coalesce(s["text"], F.lit(""))), F.array().cast("array<string>"))
    white = F.exists(texts, lambda t: (t != "") & T.is_blank(t))
    some = F.exists(texts, lambda t: ~T.is_blank(t))
    found = F.array(
        *[F.when(blank(c), f"{c} missing") for c in ("id", "source_version", "language")],
        F.when(~F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False)), "content_type unknown"),
        F.when(white, "section of white space"),
        F.when(~some, "no section with text"),
    )
    return documents.select(F.col("id").alias("document_id"), F.array_compact(found).alias("violations"), *more)


def enforce(violations: DataFrame, what: str) -> None:
    """Raises with the first violations, in order of id; all rows are checked, not only up to the first bad one."""
    bad = violations.where(F.size("violations") > 0)
    first = bad.orderBy(bad.columns[0]).limit(5).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(f"{r[0]}: {', '.join(r['violations'])}" for r in first))


def build_chunks(sections: DataFrame, cap: int = CHUNK_CAP, legacy: bool = False, pack=None, also: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Chunks of sections, one row a piece.

    sections: document_id, group_id (0 or null: doc_group_id counts), doc_group_id, source_id, source_version, ordinal,
    start, end, mapping_type, text. Text is split at blank lines, pieces over the cap are packed by words. Sections
    without pieces vanish. A section that gives several pieces is their parent. Equal pieces at equal anchors are told
    apart by a running number in document order. legacy leaves the document out of the identity. pack: another packer
    (text column -> array column), e.g. text.pack_words_udf(cap) for very long paragraphs. also: columns of sections that
    chunks carry too.

    stored: id, document_id, model of chunks that are stored; chunks get stored_model then, of the stored chunk with their
    id (null: none). An id names its document (not with legacy), so both are dealt by document, once.

    One shuffle, of pieces; no piece carries its section's or paragraph's text.
    """
    packer = pack or (lambda t: T.pack_words(t, cap))
    group = F.when(F.coalesce("group_id", F.lit(0)) > 0, F.col("group_id")).otherwise(F.col("doc_group_id"))
    own = ["document_id", "source_id", "source_version", "ordinal", "start", "end", "mapping_type", *(also or [])]
    split = sections.select(*own, group.alias("group_id"), T.content_hash(F.col("text")).alias("_whole"), T.split_paragraphs(F.col("text")).alias("_ps"))
    own += ["group_id", "_whole"]
    split = split.withColumn("_many", F.size("_ps") > 1)  # before rows are exploded, else each of them carries the array, also to Python
    paragraphs = split.select(*own, "_many", F.posexplode("_ps").alias("_p", "_paragraph"))
    packed = paragraphs.select(*own, "_many", "_p", packer(F.col("_paragraph")).alias("_qs")).withColumn("_many", F.col("_many") | (F.size("_qs") > 1))
    pieces = packed.select(*own, "_many", "_p", F.posexplode("_qs").alias("_q", "piece"))
    if stored is not None:
        known = stored.select("document_id", F.col("id").alias("_id"), F.col("model").alias("_model"), F.lit(True).alias("_old"))
        pieces = pieces.unionByName(known, allowMissingColumns=True).repartition("document_id")
    pieces = pieces.withColumn("content_hash", T.content_hash(F.col("piece")))
    key = ["document_id", "group_id", "start", "end", "mapping_type", "content_hash"]
    numbered = pieces.withColumn("dup", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal", "_p", "_q")) - 1)
    document = None if legacy else F.col("document_id")
    ident = lambda h, dup: T.chunk_id(F.col("source_id"), F.col("source_version"), F.col("start"), F.col("end"), F.col("mapping_type"), h, dup, document)
    parent = F.when(F.col("_many"), ident(F.col("_whole"), F.lit(0)))
    numbered = numbered.withColumn("id", ident(F.col("content_hash"), F.col("dup")))
    if stored is not None:
        numbered = numbered.withColumn("id", F.when(F.col("_old"), F.col("_id")).otherwise(F.col("id")))
        numbered = numbered.withColumn("stored_model", F.max("_model").over(Window.partitionBy("document_id", "id"))).where("_old is null")
        also = [*(also or []), "stored_model"]
    return numbered.select(
        "id", "document_id", parent.alias("parent_chunk_id"), "source_id", "source_version", "group_id", "start", "end", "mapping_type",
        F.col("piece").alias("text"), T.lexical_form(F.col("piece")).alias("text_normalized"), "content_hash", "dup", "ordinal", F.col("_p").alias("paragraph"), F.col("_q").alias("part"), *(also or []),
    )


def chunk_anchor_map(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """The mapping of each chunk: a view over chunks, so it cannot drift. strict: the first invalid range that is met is an error."""
    if strict:
        told = F.raise_error(F.concat(F.lit("invalid range of chunk "), F.coalesce("id", F.lit("?"))))
        valid = range_valid(F.col("mapping_type"), F.col("start"), F.col("end"))
        chunks = chunks.withColumn("mapping_type", F.when(valid, F.col("mapping_type")).otherwise(told.cast("string")))
    return chunks.select("id", F.col("id").alias("chunk_id"), "source_id", "source_version", "group_id", "start", "end", "mapping_type", (~range_valid(F.col("mapping_type"), F.col("start"), F.col("end"))).alias("invalid"))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, default_model: str) -> DataFrame:
    """chunks with vector, model (blank: the default), width, normalized and hash of the vectors given by id."""
    from citewell.functions.vectors import embedding_hash_udf, norm

    model = F.when(T.is_blank(F.col("model")), F.lit(default_model)).otherwise(F.col("model"))
    own = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"), model.alias("embedding_model"))
    own = own.withColumns({"embedding_dimensions": F.size("embedding"), "embedding_normalized": F.abs(norm(F.col("embedding")) - 1) <= 0.01, "embedding_hash": embedding_hash_udf()(F.col("embedding_model"), F.col("embedding"))})
    return chunks.join(own, "id", "left")


def ingest(sections: DataFrame, sources: DataFrame, stored: DataFrame, model: str, cap: int = CHUNK_CAP) -> tuple[DataFrame, DataFrame]:
    """The ingest plan without writes: chunks of usable sources with their state (reuse, embed), and one report row."""
    from citewell.operators.incremental import delta, run_report, usable

    gate = sources.where(usable()).select(F.col("id").alias("source_id"))
    chunks = build_chunks(sections.join(gate, "source_id", "left_semi"), cap)
    planned = delta(stored, chunks.withColumn("model", F.lit(model)))
    stale = stored.join(chunks.select("id"), "id", "left_anti").agg(F.count("*").alias("stale"))
    return planned, run_report(planned).crossJoin(stale)  # two tables of one row


def ingest_all(sections: DataFrame, sources: DataFrame, stored: DataFrame, mappings: DataFrame, embedder, model: str, width: int, now: Column, cap: int = CHUNK_CAP) -> dict[str, DataFrame]:
    """The next snapshots of chunks, mappings and sources, and one report row: all of an ingest but the writes.

    Sections of usable sources become chunks; all are validated before anything is embedded (a violation is an error that
    names them); chunks that are stored with this model keep their vectors, the others are embedded; rows are upserted,
    mappings follow, what the same sources no longer give goes, and the sources are marked as ingested.

    stored: id, source_id, source_version, group_id, start, end, mapping_type, text, content_hash, model, embedding,
    created_at, updated_at; mappings: the columns of chunk_anchor_map.
    """
    from citewell.operators.incremental import upsert

    planned, report = ingest(sections, sources, stored, model, cap)
    bad = F.array_compact(F.array(F.when(T.is_blank(F.col("text")), "no text"), F.when(~range_valid(F.col("mapping_type"), F.col("start"), F.col("end")), "bad range"), F.when(F.col("content_hash") != T.content_hash(F.col("text")), "hash differs")))
    enforce(planned.select("id", bad.alias("violations")), "chunks")
    vectors = embed_batches(planned.where("state = 'embed'"), embedder, model, width).select("id", F.col("embedding").alias("_new"))
    known = stored.select("id", F.col("embedding").alias("_old"))
    full = planned.join(vectors, "id", "left").join(known, "id", "left").withColumn("embedding", F.coalesce("_new", "_old"))
    own = sections.select("source_id", "source_version").distinct().join(sources.where(usable_source()).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    gone = lambda table, key: table.join(own, ["source_id", "source_version"], "left_semi").join(planned.select(F.col("id").alias(key)), key, "left_anti").select(key)
    kept = stored.join(gone(stored, "id"), "id", "left_anti")
    chunks = upsert(kept, full, ["id"], now)
    fresh = chunk_anchor_map(planned)
    old = mappings.join(gone(mappings, "chunk_id"), "chunk_id", "left_anti").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    marked = sources.join(own.select(F.col("source_id").alias("id"), F.lit(True).alias("_done")).distinct(), "id", "left")
    done = marked.withColumns({"ingestion_status": F.when(F.col("_done"), "ingested").otherwise(F.col("ingestion_status")), "ingested_at": F.when(F.col("_done"), now).otherwise(F.col("ingested_at"))}).select(*sources.columns)
    return {"chunks": chunks, "mappings": old.select(*fresh.columns).unionByName(fresh), "sources": done, "report": report}


def usable_source() -> Column:
    from citewell.operators.incremental import usable

    return usable()


def embed_batches(chunks: DataFrame, embedder, model: str, width: int) -> DataFrame:
    """id, embedding, model: texts go to embedder(list of texts) in Arrow batches; all of them or an error.

    A wrong count or width is an error, and so is what the embedder raises; the message names the ids of the batch.
    operators.embedding numbers batches over the whole input and checks every vector.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            span = f"{frame['id'].iat[0]} to {frame['id'].iat[-1]}" if len(frame) else "none"
            try:
                vectors = embedder(frame["text"].tolist())
            except Exception as e:
                raise ValueError(f"embedding failed for ids {span}: {e}") from e
            if len(vectors) != len(frame) or any(len(v) != width for v in vectors):
                raise ValueError(f"embedder returned another number or width of vectors than asked for, ids {span}")
            yield pd.DataFrame({"id": frame["id"], "embedding": [list(map(float, v)) for v in vectors], "model": model})

    return chunks.select("id", "text").mapInPandas(run, "id string, embedding array<double>, model string")
