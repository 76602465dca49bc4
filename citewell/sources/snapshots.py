"""Snapshots and logs as files: a table is the newest complete snapshot below its path."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete snapshots, oldest first."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v="))
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{DONE}"))]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{found[-1]}") if found else spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """The next snapshot beside the one that may be being read; older ones beyond `keep` go after it is complete."""
    spark, name = df.sparkSession, f"v={time.time_ns():020d}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{name}")
    for old in versions(spark, path)[:-keep]:
        at, fs = _fs(spark, f"{path}/{old}")
        fs.delete(at, True)
    return name


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a log that is only ever appended to."""
    df.write.mode("append").parquet(path)


def manifest_json(sections: DataFrame) -> str:
    """A manifest of one document's worth of sections as deterministic JSON: ordered sections, sorted keys."""
    rows = sections.orderBy("ordinal").collect()
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def corpus_markdown(title: str, sections: DataFrame) -> str:
    rows = sections.orderBy("anchor").collect()
    return f"# {title}\n\n" + "\n".join(f"## {r['group_id']}:{r['anchor']}\n\n{r['text']}\n" for r in rows)


def digest_markdown(title: str, rows: DataFrame) -> str:
    """The table part of a review digest: anchor, run, coverage, verdict; weakest first."""
    lines = [f"| {r['anchor']} | {r['run']} | {r['coverage']:.2f} | {r['verdict']} |" for r in rows.orderBy("run", "anchor").collect()]
    return "\n".join([f"# {title}", "", "| anchor | run | coverage | verdict |", "| --- | --- | --- | --- |", *lines]) + "\n"


def provenance_digest(title: str, header: dict[str, object], rows: DataFrame, wanted: str = "", min_run: int = 4) -> str:
    """A review digest: provenance lines, the separator, counts by verdict, and the selected entries, weakest first.

    rows: anchor, run, coverage, verdict. Without `wanted` the uncorroborated ones are shown. Below the separator
    the text depends on the rows alone, so a check can compare bodies.
    """
    from citewell.operators.scans import select_entries

    counts = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    chosen = select_entries(rows, "anchor", wanted, F.col("verdict") == "uncorroborated")
    head = "".join(f"{k}: {header[k]}\n" for k in sorted(header))
    tally = "".join(f"- {k}: {counts[k]}\n" for k in sorted(counts))
    return f"{head}\n---\n{digest_markdown(title, chosen)}\nA run of {min_run} words corroborates.\n\n{tally}"


def unchanged(path: str, text: str) -> bool:
    """Whether a file already holds exactly this text (the check mode of writers)."""
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read() == text
    except FileNotFoundError:
        return False


def report(**counts) -> str:
    return json.dumps(counts, sort_keys=True)


def as_row(spark: SparkSession, **counts: int) -> DataFrame:
    """A one-row table of counts."""
    return spark.range(1).select(*[F.lit(int(v)).cast("long").alias(k) for k, v in counts.items()])
