"""Coverage of anchors by chunks, with zero-fill, gaps and drift between chunks and their mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.operators.retrieval import anchored


def _measures():
    return [
        F.count("*").alias("chunks"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("usable"),
        F.count_distinct(F.coalesce("parent_id", "chunk_id")).alias("parents"),
        F.array_join(F.sort_array(F.collect_set("mapping_type")), ",").alias("types"),
    ]


def zero_filled(counts: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """A row for every anchor 1..n of every group, zeros where nothing covers it."""
    grid = group_sizes.where("n >= 1").select("group_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("anchor"))
    full = grid.join(counts, ["group_id", "anchor"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select("group_id", "anchor", zero("chunks"), zero("usable"), zero("parents"), F.coalesce("types", F.lit("")).alias("types"))


def coverage_by_start(mappings: DataFrame, chunks: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """Coverage that credits a range to its first anchor only; mappings without a chunk still count.

    mappings: chunk_id, group_id, start, end, mapping_type; chunks: chunk_id, verified, parent_id. Unanchored
    mappings (0/0) are left out.
    """
    own = mappings.where("start > 0").join(chunks.select("chunk_id", "verified", "parent_id"), "chunk_id", "left")
    return zero_filled(own.groupBy("group_id", F.col("start").alias("anchor")).agg(*_measures()), group_sizes)


def coverage_by_range(mappings: DataFrame, chunks: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """Coverage that credits a range to every anchor in it, as retrieval serves it."""
    own = anchored(mappings, group_sizes).join(chunks.select("chunk_id", "verified", "parent_id"), "chunk_id", "left")
    return zero_filled(own.groupBy("group_id", "anchor").agg(*_measures()), group_sizes)


def out_of_range(mappings: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """Anchored mappings that begin or end outside their group, or whose group is unknown."""
    sized = mappings.where("start <> 0 or end <> 0").join(group_sizes, "group_id", "left")
    return sized.where(F.col("n").isNull() | (F.col("start") < 1) | (F.col("end") > F.col("n")) | (F.col("end") < F.col("start")))


def coverage_report(coverage: DataFrame) -> DataFrame:
    """One row a group: anchors, covered, gaps and unusable anchors as lists, chunks, verdict. No anchors: FAIL."""
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.col("anchor")))), lambda x: x.cast("string")), ",")
    rows = coverage.groupBy("group_id").agg(
        F.count("*").alias("anchors"),
        F.count_if(F.col("chunks") > 0).alias("covered"),
        listed(F.col("chunks") == 0).alias("gaps"),
        listed((F.col("chunks") > 0) & (F.col("usable") == 0)).alias("unusable"),
        F.sum("chunks").alias("chunks"),
    )
    return rows.withColumn("verdict", F.when((F.col("anchors") > 0) & (F.col("covered") == F.col("anchors")), "PASS").otherwise("FAIL"))


def mapping_drift(mappings: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id and shape of every disagreement: chunk_only, mapping_only or mismatch (null-safe comparison)."""
    fields = ["group_id", "start", "end", "mapping_type"]
    side = lambda df, s: df.select("chunk_id", F.struct(*fields).alias(s))
    both = side(chunks, "c").join(side(mappings, "m"), "chunk_id", "full_outer")
    shape = F.when(F.col("m").isNull(), "chunk_only").when(F.col("c").isNull(), "mapping_only").when(~F.col("c").eqNullSafe(F.col("m")), "mismatch")
    return both.select("chunk_id", shape.alias("shape")).where("shape is not null")


def no_drift(drift: DataFrame) -> DataFrame:
    """One row: whether chunks and mappings agree, which they do where mapping_drift has no row."""
    return drift.agg((F.count("*") == 0).alias("no_drift"))


def passage_text(pieces: DataFrame) -> DataFrame:
    """group_id, anchor, passage: the texts of an anchor's pieces in order, each after a space."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(" "), x["text"])), "")
    return pieces.groupBy("group_id", "anchor").agg(joined.alias("passage"))


def missing_anchors(present: DataFrame, group_sizes: DataFrame) -> DataFrame:
    grid = group_sizes.where("n >= 1").select("group_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("anchor"))
    return grid.join(present.select("group_id", "anchor"), ["group_id", "anchor"], "left_anti")


def drift_sentence(drift: DataFrame) -> DataFrame:
    """One row: the drift in words, or `none`."""
    n = {k: F.count_if(F.col("shape") == k) for k in ("chunk_only", "mapping_only", "mismatch")}
    words = F.concat_ws(", ", F.concat(n["chunk_only"].cast("string"), F.lit(" unmapped chunks")), F.concat(n["mapping_only"].cast("string"), F.lit(" orphan mappings")), F.concat(n["mismatch"].cast("string"), F.lit(" mismatched")))
    return drift.agg(F.when(F.count("*") == 0, "none").otherwise(words).alias("drift"))


def piece_counts(sections: DataFrame, cap: int) -> DataFrame:
    """sections (id, text) with length and pieces: how many chunks of at most cap characters its paragraphs need, about."""
    own = F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda p: F.ceil(F.length(p) / cap).cast("long"))
    return sections.select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b).alias("pieces"))


def piece_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pieces").agg(F.count("*").alias("sections"))


def chunk_estimate(counts: DataFrame) -> DataFrame:
    """One row: sections, those of several pieces, the longest one (of equals the smallest id), and the chunks to expect."""
    longest = F.max(F.struct("length", (-F.col("id")).alias("neg")))
    return counts.agg(
        F.count("*").alias("sections"), F.count_if(F.col("pieces") > 1).alias("split"), longest["length"].alias("longest"), (-longest["neg"]).alias("longest_id"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("chunks")
    )
