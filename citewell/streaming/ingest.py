"""Extension: incremental ingest as a stream.

The batch operators of operators.incremental run on each micro-batch, so a stream of manifests keeps the same
snapshot that batch re-runs would. Snapshots are swapped whole, and a batch that is replayed after a failure
reuses what it wrote: chunk ids come from content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citewell.operators import chunking, incremental
from citewell.sources import snapshots

STORED = "id string, document_id string, source_id string, source_version string, group_id int, start int, end int, mapping_type string, text string, content_hash string, model string, created_at timestamp, updated_at timestamp"


def ingest_batch(sections: DataFrame, path: str, model: str, cap: int = chunking.CHUNK_CAP) -> dict[str, int]:
    """One increment: chunks of the sections are upserted, superseded chunks of the same documents are pruned."""
    spark = sections.sparkSession
    stored = snapshots.read(spark, path, STORED)
    values = [c for c in stored.columns if c not in ("created_at", "updated_at")]
    chunks = chunking.build_chunks(sections, cap).withColumn("model", F.lit(model)).select(*values)
    report = incremental.run_report(incremental.delta(stored.select("id", "model"), chunks)).first().asDict()
    mine = sections.select("document_id").distinct()
    old = stored.join(mine, "document_id", "left_semi").join(chunks.select("id"), "id", "left_semi").unionByName(stored.join(mine, "document_id", "left_anti"))
    snapshots.write(incremental.upsert(old.select(*stored.columns), chunks, ["id"], F.current_timestamp()), path)
    return report


def ingest_stream(sections: DataFrame, path: str, checkpoint: str, model: str, cap: int = chunking.CHUNK_CAP) -> StreamingQuery:
    """Keeps the snapshot below path up to date with a stream of sections; available data only, then stops."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_batch(batch, path, model, cap)

    return sections.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Decisions by time window and kind over a stream (ts, decision), with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "decision").agg(F.count("*").alias("n"))
