from __future__ import annotations

from citewell.sources import snapshots
from citewell.streaming import ingest
from tests.test_operators import SECTION, sections


def test_stream_keeps_the_snapshot(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    sections(spark, "a\n\nb", "c").write.parquet(src)
    stream = lambda: spark.readStream.schema(SECTION).parquet(src)
    ingest.ingest_stream(stream(), out, check, "m").awaitTermination(120)
    assert snapshots.read(spark, out, ingest.STORED).count() == 3
    sections(spark, "a\n\nB", "c").write.mode("append").parquet(src)
    ingest.ingest_stream(stream(), out, check, "m").awaitTermination(120)
    assert {r["text"] for r in snapshots.read(spark, out, ingest.STORED).collect()} == {"a", "B", "c"}
    assert ingest.ingest_batch(sections(spark, "a\n\nB", "c"), out, "m")["pending"] == 0


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp '2024-01-01 00:10:00' ts, 'approve' decision union all select timestamp '2024-01-01 00:50:00', 'approve' union all select timestamp '2024-01-01 02:00:00', 'reject'").write.parquet(src)
    q = ingest.decision_counts(spark.readStream.schema("ts timestamp, decision string").parquet(src)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]
