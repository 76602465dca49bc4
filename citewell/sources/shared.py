"""Tables between steps, in the folder that all executors share: a lost executor costs a task, not the steps before."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_held: list[tuple[SparkSession, str]] = []  # results of scratch() blocks that are still open


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; a cluster has none that its executors share, so
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="citewell-"))
    return shared_dir(spark)


def keep(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, survives lost executors.

    The table stays until its scratch() block ends, or else until Python does. codec: of the files (the session's, if none
    is given); zstd halves hashes in hex.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citewell-{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for tables, which goes as those of keep() do."""
    path = f"{shared_dir(spark)}/citewell-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def scratch(name: str, codec: str | None = None) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a result as a table; all other tables that keep() wrote in the block go at its end."""
    first, results = len(_written), []

    def result(df: DataFrame) -> DataFrame:
        out = keep(df, name, codec)
        results.append(_written[-1])
        _held.append(_written[-1])
        return out

    try:
        yield result
    finally:
        for x in results:
            _held.remove(x)
        own = _written[first:]
        stays = [x for x in own if x in results or x in _held]
        delete([x for x in own if x not in stays])
        _written[first:] = stays


def delete(written: list[tuple[SparkSession, str]]) -> None:
    """Deletes tables; one that cannot be deleted (its session has ended) does not keep the others."""
    for spark, path in written:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001, S112  the folder's owner clears it
            continue


@atexit.register
def _sweep() -> None:
    delete(_written)
