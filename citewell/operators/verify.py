"""Cross-checks between sources, set hashes, offsets and audits of expected grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from citewell.functions import text as T

from citewell.functions.text import content_hash, letter_key
from citewell.operators.rules import is_placeholder


def group_offsets(group_sizes: DataFrame) -> DataFrame:
    """group_id, n, first: the zero-based position of each group's first line in one flat file of all groups."""
    before = Window.orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a group: a constant-size dimension
    return group_sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slice_flat(lines: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """group_id, anchor, text: lines (position from 0, text) of a flat file dealt to their groups.

    Each group lists its positions, and the equi-join takes the lines; surplus lines meet no group.
    """
    places = group_offsets(group_sizes).where("n >= 1").select("group_id", F.posexplode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i", "position"))
    return places.join(lines, "position").select("group_id", (F.col("i") + 1).alias("anchor"), "text")


def cross_verify(stored: DataFrame, primary: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """key, stored_ok, hash_ok, verdict, third_only: stored rows against a primary and two more sources.

    stored: key, text, content_hash; others: key, text. verdict: ok, confirmed (the second disagrees, the third agrees
    with the primary), disputed, unsettled, not_stored, differs or bad_hash; the third also speaks alone in
    third_only. Letter keys are compared, not spellings.
    """
    side = lambda df, c: df.select("key", F.col("text").alias(c))
    rows = side(primary, "p").join(stored.select("key", F.col("text").alias("s"), "content_hash"), "key", "left").join(side(second, "b"), "key", "left").join(side(third, "c"), "key", "left")
    want = letter_key(F.col("p"))
    second_bad = F.col("b").isNotNull() & (letter_key(F.col("b")) != want)
    third_bad = F.col("c").isNotNull() & (letter_key(F.col("c")) != want)
    stored_ok = F.coalesce(F.col("s") == F.col("p"), F.lit(False))
    hash_ok = F.coalesce(F.col("content_hash") == content_hash(F.col("s")), F.lit(False))
    cross = F.when(second_bad, F.when(F.col("c").isNull(), "unsettled").when(third_bad, "disputed").otherwise("confirmed")).otherwise("ok")
    verdict = F.when(F.col("s").isNull(), "not_stored").when(~stored_ok, "differs").when(~hash_ok, "bad_hash").otherwise(cross)
    return rows.select("key", stored_ok.alias("stored_ok"), hash_ok.alias("hash_ok"), verdict.alias("verdict"), (third_bad & ~second_bad).alias("third_only"))


def verification_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


#: Verdicts of cross_verify, as its precedence has them.
VERDICTS = ("ok", "confirmed", "disputed", "unsettled", "not_stored", "differs", "bad_hash")


def verification_summary(verdicts: DataFrame, primary: DataFrame, second: DataFrame, stored: DataFrame) -> DataFrame:
    """what, n: every verdict, with 0 where there is none; skipped (keys that the second source lacks), extras (stored
    keys that the primary lacks) and third_only; and total."""
    spark = verdicts.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in VERDICTS])).alias("_k", "what")).select("what")
    counts = listed.join(verification_tally(verdicts).withColumnRenamed("verdict", "what"), "what", "left").select("what", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    lacking = lambda a, b, what: a.select("key").join(b.select("key"), "key", "left_anti").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    alone = verdicts.agg(F.count_if("third_only").alias("n")).select(F.lit("third_only").alias("what"), "n")
    total = verdicts.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), "n")
    return counts.unionByName(lacking(primary, second, "skipped")).unionByName(lacking(stored, primary, "extras")).unionByName(alone).unionByName(total)


def extras(stored: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """Stored keys outside 1..n of their group, ordered."""
    sized = stored.join(group_sizes, "group_id", "left")
    return sized.where(F.col("n").isNull() | (F.col("anchor") < 1) | (F.col("anchor") > F.col("n"))).select("group_id", "anchor").orderBy("group_id", "anchor")


def set_hash(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, set_hash, n: sha256 over the lines order TAB value NEWLINE, in order. Versions are not looked at.

    Equal orders go by value. A row whose order or value is null gives no line but counts in n; a null key is a key.
    One digest runs over a group's lines, so a group is one task's; its rows are sorted on disk where they are many and
    stream through the digest, so no task holds a group.
    """
    line = F.concat(F.col("_o").cast("string"), F.lit("\t"), F.col("_v").cast("string"), F.lit("\n")).cast("binary")
    dealt = rows.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v")).repartition(*keys).sortWithinPartitions(*keys, "_o", "_v")
    fields = StructType([*rows.select(*keys).schema.fields, StructField("set_hash", StringType()), StructField("n", LongType())])
    return dealt.select(*keys, line.alias("_line")).mapInArrow(_hash_runs, fields)


def _hash_runs(batches):
    """A row for each run of equal keys; the last column of a batch holds the lines."""
    import hashlib

    import pyarrow as pa

    key, digest, n, kinds, names = None, hashlib.sha256(), 0, [], []

    def rows_of(done):
        columns = list(zip(*[(*k, h, c) for k, h, c in done], strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        done, lo = [], 0
        kinds = [*batch.schema.types[:-1], pa.string(), pa.int64()]
        names = [*batch.schema.names[:-1], "set_hash", "n"]
        keys = list(zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True))
        lines = batch.columns[-1].to_pylist()
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if keys[lo] != key:
                if key is not None:
                    done.append((key, digest.hexdigest(), n))
                key, digest, n = keys[lo], hashlib.sha256(), 0
            digest.update(b"".join(x for x in lines[lo:hi] if x is not None))
            n += hi - lo
            lo = hi
        yield rows_of(done)
    if key is not None:
        yield rows_of([(key, digest.hexdigest(), n)])


def versioned_set_hash(rows: DataFrame, keys: list[str], order: str, value: str, version: str) -> DataFrame:
    """set_hash with the version of the rows; keys whose rows have several versions (or none) get an error instead."""
    seen = rows.groupBy(*keys).agg(F.count_distinct(version).alias("_kinds"), F.min(version).alias("version"), F.count_if(F.col(version).isNull()).alias("_none"))
    error = F.when(F.col("_kinds") > 1, "mixed_versions").when((F.col("_kinds") == 0) | (F.col("_none") > 0), "no_version")
    both = set_hash(rows, keys, order, value).join(seen, keys)
    return both.select(*keys, F.when(error.isNull(), F.col("version")).alias("version"), F.when(error.isNull(), F.col("set_hash")).alias("set_hash"), "n", error.alias("error"))


def anchor_integrity(subjects: DataFrame, anchors: DataFrame) -> DataFrame:
    """Subjects (group_id, anchor) whose anchor is not in the corpus or has no text there."""
    own = anchors.select("group_id", "anchor", T.is_blank(F.col("text")).alias("_blank"))
    problem = F.when(F.col("_blank").isNull(), "not_in_corpus").when(F.col("_blank"), "empty_text")
    return subjects.select("group_id", "anchor").distinct().join(own, ["group_id", "anchor"], "left").withColumn("problem", problem).where("problem is not null").drop("_blank")


def missing_of_grid(left: DataFrame, right: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Combinations of two dimension tables that no present row has.

    The grid of the two dimensions is what is asked for, so its size is theirs; present rows are made distinct first.
    """
    return left.crossJoin(right).join(present.select(*on).distinct(), on, "left_anti")


def grid_audit(present: DataFrame, on: list[str], url: str | None = None) -> DataFrame:
    """One row: total, duplicates by key, placeholders."""
    placeholder = F.count_if(is_placeholder(F.col(url))) if url else F.lit(0).cast("long")
    per_key = present.groupBy(*on).agg(F.count("*").alias("n"), placeholder.alias("p"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("p"), F.lit(0)).alias("placeholders"))


def vector_audit(rows: DataFrame, model: str, dims: int, rehash: bool = False) -> DataFrame:
    """id, defects: rows id, v, model, normalized, hash; ordered list of what is wrong.

    rehash: recompute the hash of every vector that is there, and report hash_mismatch where a stored one differs;
    without it only a blank hash is a defect.
    """
    from citewell.functions.vectors import embedding_hash_udf, vector_defects

    there = F.size("v") > 0
    stale = F.when(there & (F.coalesce("hash", F.lit("")) != "") & (F.col("hash") != embedding_hash_udf()(F.col("model"), F.col("v"))), "hash_mismatch")
    checks = [F.when(~F.col("model").eqNullSafe(F.lit(model)), "foreign_model"), F.when(~F.coalesce("normalized", F.lit(False)), "not_marked_normalized"), F.when(F.coalesce("hash", F.lit("")) == "", "no_hash")]
    more = F.array_compact(F.array(*checks, *([stale] if rehash else [])))
    return rows.select("id", F.when(F.col("v").isNull(), F.array(F.lit("missing"))).otherwise(F.concat(vector_defects(F.col("v"), dims), more)).alias("defects"))


def defect_tally(audited: DataFrame) -> DataFrame:
    """defect, n for every defect that occurs, and a row VERDICT: 1 for PASS; an empty corpus fails."""
    each = audited.select(F.explode("defects").alias("defect")).groupBy("defect").agg(F.count("*").alias("n"))
    verdict = audited.agg(((F.count("*") > 0) & (F.count_if(F.size("defects") > 0) == 0)).cast("long").alias("n"))
    return each.unionByName(verdict.select(F.lit("VERDICT").alias("defect"), "n"))


def needs_embedding(audited: DataFrame) -> DataFrame:
    """The rows of a vector audit that have to be embedded anew: those with any defect."""
    return audited.where(F.size("defects") > 0)
