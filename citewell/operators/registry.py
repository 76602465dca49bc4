"""Sources, their pinned versions, and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.operators.incremental import usable


#: The most rows of a table of sources that is sent to every executor; with more, chunks move to them.
BROADCAST_SOURCES = 500_000


def small(by_source: DataFrame) -> DataFrame:
    """A table of narrow rows, one a source, marked for broadcast where it has BROADCAST_SOURCES at most (counted)."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def resolve_pins(sources: DataFrame, versions: DataFrame) -> DataFrame:
    """id, version, reason of every source: the pointer wins, else the only version; otherwise version is null and
    reason tells why (dangling_pointer, wrong_owner, no_hash, none, ambiguous).

    sources: id, current_version; versions: id, source_id, content_hash.
    """
    pointed = versions.select(F.col("id").alias("current_version"), F.col("source_id").alias("_owner"), F.col("content_hash").alias("_hash"))
    own = versions.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("_n"), F.min("id").alias("_only"), F.min("content_hash").alias("_only_hash"))
    pinned = F.coalesce("current_version", F.lit("")) != ""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = (
        F.when(pinned & F.col("_owner").isNull(), "dangling_pointer")
        .when(pinned & (F.col("_owner") != F.col("id")), "wrong_owner")
        .when(pinned, F.when(empty("_hash"), "no_hash"))
        .when(F.coalesce("_n", F.lit(0)) == 0, "none")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise(F.when(empty("_only_hash"), "no_hash"))
    )
    joined = sources.select("id", "current_version").join(pointed, "current_version", "left").join(own, "id", "left").withColumn("reason", reason)
    return joined.select("id", F.when(F.col("reason").isNull(), F.when(pinned, F.col("current_version")).otherwise(F.col("_only"))).alias("version"), "reason")


def snapshot_of(versions: Column) -> Column:
    """Sorted distinct versions joined by +; nulls left out."""
    return F.array_join(F.sort_array(F.array_distinct(F.array_compact(versions))), "+")


def attribution(refs: DataFrame, chunks: DataFrame, sources: DataFrame, pins: DataFrame) -> DataFrame:
    """item_id, source_id, first_pos, citations, snapshot, problem: sources of an item in the order of first citation.

    refs: item_id, pos, chunk_id; chunks: chunk_id, source_id, source_version; sources: id and statuses; pins: id,
    version. problem is missing_chunk, unusable_source or version_mismatch, else null.
    """
    state = sources.select(F.col("id").alias("source_id"), usable().alias("_usable"))
    pin = pins.select(F.col("id").alias("source_id"), F.col("version").alias("_pin"))
    joined = refs.join(chunks, "chunk_id", "left").join(state, "source_id", "left").join(pin, "source_id", "left")
    problem = (
        F.when(F.col("source_id").isNull(), "missing_chunk").when(~F.coalesce("_usable", F.lit(False)), "unusable_source")
        .when(~F.col("source_version").eqNullSafe(F.col("_pin")), "version_mismatch")
    )
    return (
        joined.withColumn("problem", problem)
        .groupBy("item_id", F.coalesce("source_id", F.lit("")).alias("source_id"))
        .agg(F.min("pos").alias("first_pos"), F.count("*").alias("citations"), snapshot_of(F.collect_set("source_version")).alias("snapshot"), F.max("problem").alias("problem"))
    )


def registry_violations() -> Column:
    """array<string> of what is wrong with a registry record."""
    blank = lambda c: T.is_blank(F.col(c))
    return F.array_compact(
        F.array(
            *[F.when(blank(c), f"{c} missing") for c in ("id", "title", "author", "language", "edition", "raw_text_ref", "licensing_status")],
            F.when(~F.coalesce(F.col("verification_status").isin("verified", "unverified"), F.lit(False)), "verification_status unknown"),
            F.when(~F.coalesce(F.col("authority_tier").between(1, 3), F.lit(False)), "authority_tier out of range"),
            F.when(F.col("ingestion_status").isNotNull() & ~F.col("ingestion_status").isin("not_started", "in_progress", "ingested", "failed"), "ingestion_status unknown"),
        )
    )


def inventory(sources: DataFrame) -> DataFrame:
    """Every source with its gate verdict and ingestion status (not_started by default), ordered by id."""
    return sources.select("id", usable().alias("usable"), F.coalesce("ingestion_status", F.lit("not_started")).alias("ingestion_status")).orderBy("id")


def registry_integrity(registered: DataFrame, sources: DataFrame, versions: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """source_id and problem: rows that a registered record lacks, and stored hashes that differ from the file's.

    registered: source_id, version_id, document_id, raw_text_ref; files: path, content_hash.
    """
    lacks = lambda df, key, what: registered.join(df.select(F.col("id").alias(key)), key, "left_anti").select("source_id", F.lit(what).alias("problem"))
    stored = registered.join(versions.select(F.col("id").alias("version_id"), F.col("content_hash").alias("_stored")), "version_id").join(files.select(F.col("path").alias("raw_text_ref"), F.col("content_hash").alias("_file")), "raw_text_ref", "left")
    differs = stored.where(~F.col("_stored").eqNullSafe(F.col("_file"))).select("source_id", F.lit("hash_differs").alias("problem"))
    return lacks(sources, "source_id", "no_source").unionByName(lacks(versions, "version_id", "no_version")).unionByName(lacks(documents, "document_id", "no_document")).unionByName(differs)


def evidence_with_pin(chunks: DataFrame, pins: DataFrame, versions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """chunks with problem: null, no_pin, version_differs or hash_differs against the pinned version.

    state: source_id and more columns of every source, which chunks get too. Chunks meet one table of sources, once.
    """
    pin = pins.where("version is not null").select(F.col("id").alias("source_id"), F.col("version").alias("_pin")).join(versions.select(F.col("id").alias("_pin"), F.col("content_hash").alias("_hash")), "_pin", "left")
    known = small(pin if state is None else pin.join(state, "source_id", "full"))
    problem = F.when(F.col("_pin").isNull(), "no_pin").when(F.col("source_version") != F.col("_pin"), "version_differs").when(~F.col("source_version_hash").eqNullSafe(F.col("_hash")), "hash_differs")
    return chunks.join(known, "source_id", "left").withColumn("problem", problem).drop("_pin", "_hash")


def apply_record(tables: dict[str, DataFrame], record: DataFrame, file_hash: str, now) -> dict[str, DataFrame]:
    """The next snapshots of sources, source_versions and documents_registry after a registry record is applied.

    record: one row with the columns of `sources` and version_id, document_id, content_type, group_id, anchor_count.
    The three rows replace those of their keys or are added; ingestion starts at not_started.
    """
    source = record.select(*[c for c in tables["sources"].columns if c not in ("ingestion_status", "ingested_at", "current_version")]).withColumns({"ingestion_status": F.lit("not_started"), "ingested_at": F.lit(None).cast("timestamp")})
    source = source.join(record.select("id", F.col("version_id").alias("current_version")), "id")
    version = record.select(F.col("version_id").alias("id"), F.col("id").alias("source_id"), "edition", F.col("edition").alias("version_label"), "raw_text_ref", F.lit(file_hash).alias("content_hash"), now.alias("created_at"))
    document = record.select(F.col("document_id").alias("id"), F.col("version_id").alias("source_version_id"), "raw_text_ref", F.lit("not_started").alias("ingestion_status"), "content_type", "group_id", "anchor_count", now.alias("created_at"))
    new = {"sources": source, "source_versions": version, "documents_registry": document}
    return {name: old.join(new[name].select("id"), "id", "left_anti").select(*old.columns).unionByName(new[name].select(*old.columns)) for name, old in tables.items()}
