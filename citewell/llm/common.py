"""What the operators share: tables in the cluster's shared folder, held-out folds, row digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.sources.shared import keep, scratch, shared_dir  # noqa: F401  operators take them from here

#: One or more characters that are not ASCII white space: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch where rows hold whole texts; the session's default of 10,000 puts no bound on its bytes.
TEXTS_A_BATCH = 1024
#: Characters of texts that a task works on at once, about; a longer text is alone.
CHARS_A_BLOCK = 250_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to TEXTS_A_BATCH rows, unless the session sets one, whatever it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, str(TEXTS_A_BATCH))


def text_blocks(texts, chars: int = CHARS_A_BLOCK, most: int = TEXTS_A_BATCH):
    """(index of the first, texts) of runs of an Arrow column of texts: about `chars` characters, at most `most` texts.

    Null counts as empty. What a task holds is bounded by the length of texts, not by their number alone.
    """
    lo, part, held = 0, [], 0
    for i in range(len(texts)):
        part.append(texts[i].as_py() or "")
        held += len(part[-1])
        if held >= chars or len(part) >= most:
            yield lo, part
            lo, part, held = i + 1, [], 0
    if part:
        yield lo, part


def release() -> None:
    """Gives memory that a worker has freed back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def power_of_two_at_least(n: float) -> int:
    k = 0
    while (1 << k) < n:
        k += 1
    return k


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def as_int64(numbers):
    """uint64 -> int64 with the same bits, as Spark's long stores them."""
    import numpy as np

    return np.ascontiguousarray(numbers).view(np.int64)
