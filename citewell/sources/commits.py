"""Tables in hash buckets of their key, and one commit for several of them.

A table is a folder of parts, part=<id>/bucket=<k>/*.parquet; nothing in it is ever overwritten. A commit is one small
file that names, for every table of the group, the part that holds each bucket. It is written beside and renamed into
place where no file of that number is, so of two writers that started from one commit the second fails, and a run that
dies before its commit leaves every table as it was. Readers go by the newest commit, or by any that is still there.

Scale: an increment decides by its keys which buckets it touches; only those are read, joined and written. A commit
holds one number a bucket (BUCKETS at most a table), so its size does not depend on the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.sources.shared import keep as kept_table
from citewell.sources.shared import scratch

#: The most buckets of a table: what a commit lists.
BUCKETS = 65_536
BUCKET = "bucket"
#: The most keys that are sent to every executor; rows that meet more of them are shuffled.
FEW = 200_000


class Conflict(Exception):
    """Another writer committed first."""


@dataclass(frozen=True)
class Stage:
    """Buckets of a table that were written and wait for a commit; parts maps every touched bucket to its part, or None if it is empty now."""

    table: str
    key: tuple[str, ...]
    buckets: int
    schema: str
    parts: dict[int, str | None] = field(default_factory=dict)


def bucket_of(key: list[str] | tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class Commits:
    """The commit log below a folder that every executor can read and write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        path = self._path("_log")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    # ------------------------------------------------------------ the log

    def numbers(self) -> list[int]:
        """Commits, oldest first."""
        log = self._path("_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def state(self, number: int | None = None) -> tuple[int, dict[str, dict]]:
        """(number, tables) of a commit, the newest if none is named; (0, {}) before the first."""
        number = number if number is not None else (self.numbers() or [0])[-1]
        if not number:
            return 0, {}
        stream = self._fs.open(self._path("_log", f"{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def commit(self, base: int, stages: list[Stage]) -> int:
        """Makes the stages visible together as commit base + 1; Conflict if that number is taken."""
        number, tables = self.state(base)
        for s in stages:
            old = tables.get(s.table, {"key": list(s.key), "buckets": s.buckets, "schema": s.schema, "parts": {}})
            if (old["key"], old["buckets"]) != (list(s.key), s.buckets):
                raise ValueError(f"table {s.table} has other keys or buckets")
            parts = old["parts"] | {str(b): p for b, p in s.parts.items()}
            tables[s.table] = old | {"schema": s.schema, "parts": {b: p for b, p in parts.items() if p}}
        draft, target = self._path("_log", f".{uuid.uuid4().hex}"), self._path("_log", f"{number + 1:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise Conflict(f"commit {number + 1} is there already") from e
            raise
        return number + 1

    # ------------------------------------------------------------ tables

    def read(self, table: str, schema: str | None = None, buckets: list[int] | None = None, number: int | None = None) -> DataFrame:
        """A table as of a commit, or only some of its buckets; an unknown table is empty and needs a schema."""
        _, tables = self.state(number)
        meta = tables.get(table)
        if not meta:
            if schema is None:
                raise ValueError(f"no table {table}")
            return self.spark.createDataFrame([], schema)
        wanted = meta["parts"] if buckets is None else {b: meta["parts"][str(b)] for b in buckets if str(b) in meta["parts"]}
        if not wanted:
            return self.spark.createDataFrame([], meta["schema"])
        paths = [f"{self.root}/{table}/part={p}/{BUCKET}={b}" for b, p in sorted(wanted.items(), key=lambda x: int(x[0]))]
        return self.spark.read.schema(meta["schema"]).parquet(*paths)

    def buckets(self, table: str, default: int) -> int:
        return self.state()[1].get(table, {}).get("buckets", default)

    def stage(self, df: DataFrame | None, table: str, key: list[str], buckets: int, touched: list[int] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None, beside: DataFrame | None = None) -> Stage:
        """Writes df as the whole contents of the touched buckets (all, if none are named), without a commit.

        Files follow the size of what a bucket gets: small buckets share a task, a large one is split over several.
        finish: makes the stored columns of df once its rows are dealt, so what it derives does not travel. beside: more
        rows, read from buckets of this table; they lie as they should and are written where they are read.
        """
        if not 1 <= buckets <= BUCKETS:
            raise ValueError(f"a table has 1 to {BUCKETS} buckets")
        part = uuid.uuid4().hex
        place = f"{self.root}/{table}/part={part}"
        rows = []
        if df is not None:
            dealt = df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)
            rows.append(finish(dealt.drop(BUCKET)).withColumn(BUCKET, bucket_of(key, buckets)) if finish else dealt)
        if beside is not None:
            rows.append(beside.withColumn(BUCKET, bucket_of(key, buckets)))
        out = reduce(DataFrame.unionByName, rows)
        out.write.option("compression", "zstd").partitionBy(BUCKET).parquet(place)
        at = self._path(table, f"part={part}")
        written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(f"{BUCKET}=")}
        every = range(buckets) if touched is None else touched
        if not written <= set(every):
            raise ValueError("rows outside of the touched buckets")
        return Stage(table, tuple(key), buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != BUCKET), {b: part if b in written else None for b in every})

    def sweep(self, keep: int = 2) -> int:
        """Deletes commits but the last `keep`, and parts that none of these names; the number of parts that went.

        A part of a writer that has not committed yet goes too: sweep where no writer is at work.
        """
        numbers = self.numbers()
        for old in numbers[:-keep]:
            self._fs.delete(self._path("_log", f"{old:012d}.json"), False)
        named = {(t, p) for n in numbers[-keep:] for t, meta in self.state(n)[1].items() for p in meta["parts"].values()}
        gone = 0
        for t in {t for t, _ in named}:
            for s in self._fs.listStatus(self._path(t)):
                part = s.getPath().getName().removeprefix("part=")
                if (t, part) not in named:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def touched_buckets(keys: DataFrame, key: list[str], buckets: int) -> list[int]:
    """The buckets that these keys fall into: one number a bucket comes to the driver."""
    return sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())


def few(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= FEW else keys


def _inside(df: DataFrame, scope: dict[str, object] | DataFrame) -> DataFrame:
    """Rows of a scope: values of columns, or a table of such values; nulls match nothing."""
    if isinstance(scope, DataFrame):
        return df.join(scope.distinct(), scope.columns, "left_semi")
    return df.where(reduce(and_, [F.col(c) == v for c, v in scope.items()]))


def upsert(commits: Commits, table: str, incoming: DataFrame, key: list[str], now: Column, schema: str, buckets: int, base: int | None = None, created="created_at", updated="updated_at", finish: Callable[[DataFrame], DataFrame] | None = None, keep: DataFrame | None = None, scope: dict[str, object] | DataFrame | None = None, count: bool = False):
    """incoming.upsert of operators.incremental, on the buckets that the incoming keys fall into alone.

    Only keys meet, by a shuffle. Stored rows whose key came again are left out where their bucket is read and written;
    incoming rows are dealt to buckets once. Both sides' keys are expected to be unique; incoming rows are read up to
    three times (twice only their keys), so keep them if they cost much. finish: as in Commits.stage.

    keep, scope: drops what prune would, by the same writing; incoming keys are in keep. count: (stage, rows dropped).
    """
    buckets = commits.buckets(table, buckets)
    touched = touched_buckets(incoming, key, buckets)
    there = commits.state(base)[1].get(table, {}).get("parts")
    if not there:
        fresh = incoming.withColumns({created: now, updated: now})
        columns = commits.read(table, schema, number=base).columns
        whole = (lambda df: finish(df).select(*columns)) if finish else (lambda df: df.select(*columns))
        stage = commits.stage(fresh, table, key, buckets, touched, whole)
        return (stage, 0) if count else stage
    with scratch("upsert"):
        stored = commits.read(table, schema, number=base)
        met = commits.read(table, schema, touched, base).select(*key, F.col(created).alias("_created")).join(incoming.select(*key), key, "left_semi").withColumn("_met", F.lit(True))
        if keep is not None:
            columns = scope.columns if isinstance(scope, DataFrame) else list(scope)
            stale = _inside(stored.select(*{*key, *columns}), scope).select(*key).join(keep.select(*key), key, "left_anti")
            met = met.unionByName(stale.withColumn("_met", F.lit(False)), allowMissingColumns=True)
        met = kept_table(met, "met", "zstd")
        found = met.groupBy(bucket_of(key, buckets).alias("b")).agg(F.count("*").alias("n"), F.count_if(~F.col("_met")).alias("gone")).collect()  # a row a bucket
        n, touched = sum(r["n"] for r in found), sorted({*touched, *(r["b"] for r in found)})
        again = few(met.where("_met"), n)
        fresh = incoming.join(again, key, "left").withColumns({created: F.when(F.col("_met"), F.col("_created")).otherwise(now), updated: now}).drop("_created", "_met")
        whole = (lambda df: finish(df).select(*stored.columns)) if finish else (lambda df: df.select(*stored.columns))
        rest = commits.read(table, schema, touched, base).join(few(met.select(*key), n), key, "left_anti").select(*stored.columns)
        stage = commits.stage(fresh, table, key, buckets, touched, whole, rest)
    return (stage, sum(r["gone"] for r in found)) if count else stage


def prune(commits: Commits, table: str, keep: DataFrame, scope: dict[str, object] | DataFrame, key: list[str], base: int | None = None, staged: Stage | None = None, count: bool = False):
    """Drops the rows of a scope whose key is not in keep; an empty keep clears the scope.

    scope: values of columns, or a table of such values (its columns are the scope's; nulls match nothing). Only key and
    scope are read of all buckets; what is rewritten are the buckets that hold a row to drop. After another stage of
    the same commit, its buckets count as they will be, and the result stands for both. count: (stage, rows dropped).
    """
    _, tables = commits.state(base)
    meta = tables.get(table)
    overlay = staged.parts if staged else {}
    if staged is None and not meta:
        raise ValueError(f"no table {table}")
    schema, buckets = (staged.schema, staged.buckets) if staged else (meta["schema"], meta["buckets"])
    parts = ({int(b): p for b, p in meta["parts"].items()} if meta else {}) | overlay

    def rows(wanted: list[int]) -> DataFrame:
        paths = [f"{commits.root}/{table}/part={parts[b]}/{BUCKET}={b}" for b in wanted if parts.get(b)]
        return commits.spark.read.schema(schema).parquet(*paths) if paths else commits.spark.createDataFrame([], schema)

    columns = scope.columns if isinstance(scope, DataFrame) else list(scope)
    with scratch("prune"):
        stale = kept_table(_inside(rows(sorted(parts)).select(*{*key, *columns}), scope).select(*key).join(keep.select(*key), key, "left_anti"), "stale", "zstd")
        found = stale.groupBy(bucket_of(key, buckets).alias("b")).agg(F.count("*").alias("n")).collect()  # a row a bucket
        touched, n = sorted(r["b"] for r in found), sum(r["n"] for r in found)
        kept = rows(touched)
        out = commits.stage(None, table, key, buckets, touched, beside=kept.join(few(stale, n), key, "left_anti").select(*kept.columns))
    stage = Stage(table, tuple(key), buckets, schema, overlay | out.parts)
    return (stage, n) if count else stage
