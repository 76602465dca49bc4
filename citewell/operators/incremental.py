"""Incremental maintenance by key: what is pending, upserts with their time stamps, scoped pruning.

Snapshots are values: each function takes the stored table and the new one and returns the next snapshot. Writing
it is one swap (sources.snapshots); an interrupted run leaves the old snapshot in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with column state: reuse where id and model are stored, else embed."""
    known = stored.select("id", F.col("model").alias("_model"))
    state = F.when(F.col("_model").eqNullSafe(F.col("model")) & F.col("_model").isNotNull(), "reuse").otherwise("embed")
    return incoming.join(known, "id", "left").withColumn("state", state).drop("_model")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], now: Column, created="created_at", updated="updated_at") -> DataFrame:
    """The next snapshot: incoming rows replace stored ones of their key; created_at survives, updated_at is now.

    One full outer join. Keys of either side are expected to be unique (see duplicate_keys).
    """
    values = [c for c in stored.columns if c not in (*key, created, updated)]
    new = incoming.select(*key, F.struct(*[F.col(c) for c in values]).alias("_new"))
    both = stored.withColumn("_old", F.struct(*values)).select(*key, "_old", created, updated).join(new, key, "full_outer")
    kept = F.coalesce(F.col("_new"), F.col("_old"))
    return both.select(
        *key,
        *[kept[c].alias(c) for c in values],
        F.when(F.col("_old").isNull(), now).otherwise(F.col(created)).alias(created),
        F.when(F.col("_new").isNull(), F.col(updated)).otherwise(now).alias(updated),
    ).select(*stored.columns)


def prune(stored: DataFrame, keep: DataFrame, scope: dict[str, object], key: str = "id") -> DataFrame:
    """stored without the rows of the scope (equal values) whose key is not in keep; nothing kept clears the scope."""
    inside = F.lit(True)
    for name, value in scope.items():
        inside = inside & F.col(name).eqNullSafe(F.lit(value))
    own = stored.withColumn("_in", inside)
    kept = own.where("_in").join(keep.select(key).distinct(), key, "left_semi")
    return own.where("not _in").unionByName(kept).drop("_in").select(*stored.columns)


def sync_state(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Registry state passed on to chunks: verified and tier anew, and changed where they differ from before.

    sources is broadcast only below the session's threshold (Spark checks its size).
    """
    state = sources.select(F.col("id").alias("source_id"), usable().alias("_verified"), F.col("authority_tier").alias("_tier"))
    joined = chunks.join(state, "source_id", "left")
    now = F.coalesce("_verified", F.lit(False))
    changed = ~(F.col("source_verified").eqNullSafe(now)) | ~(F.col("authority_tier").eqNullSafe(F.col("_tier")))
    return joined.withColumn("changed", changed).withColumn("source_verified", now).withColumn("authority_tier", F.col("_tier")).drop("_verified", "_tier")


def usable(verification="verification_status", licensing="licensing_status") -> Column:
    """The approval gate: verified and cleared; null is not."""
    return F.coalesce((F.col(verification) == "verified") & (F.col(licensing) == "cleared"), F.lit(False))


def set_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks with the vectors and models given for them, and the ids given that no chunk has, ordered."""
    new = vectors.select("id", F.col("embedding").alias("_e"), F.col("model").alias("_m"))
    updated = chunks.join(new, "id", "left")
    updated = updated.withColumn("embedding", F.coalesce("_e", "embedding")).withColumn("model", F.when(F.col("_e").isNotNull(), F.col("_m")).otherwise(F.col("model"))).drop("_e", "_m")
    return updated, vectors.select("id").join(chunks.select("id"), "id", "left_anti").orderBy("id")


def upsert_undecided(stored: DataFrame, drafts: DataFrame, key: list[str], now: Column, decided=("published", "rejected")) -> DataFrame:
    """Drafts replace only rows that nobody has decided on."""
    closed = stored.where(F.col("review_status").isin(*decided)).select(*key)
    return upsert(stored, drafts.join(closed, key, "left_anti"), key, now)


def latest_status(log: DataFrame, key: str = "id") -> DataFrame:
    """The last state of each key in an append-only log (key, at, seq, status)."""
    return log.groupBy(key).agg(F.max_by("status", F.struct("at", "seq")).alias("status"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: what a unique index would refuse."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def beyond_range(rows: DataFrame, number: str, expected: Column | int) -> DataFrame:
    return rows.agg(F.count_if(F.col(number) > expected).alias("beyond"))


def run_report(planned: DataFrame, batch: int = 32) -> DataFrame:
    """One row of counts over a delta: total, reused, pending and the calls that embedding them takes."""
    pending = F.count_if(F.col("state") == "embed")
    return planned.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "reuse").alias("reused"), pending.alias("pending"), F.ceil(pending / batch).cast("long").alias("calls"))
