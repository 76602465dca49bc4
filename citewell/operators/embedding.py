"""Batched embedding with an injected embedder: numbered batches, retries, checks of every vector, all or nothing.

Rows are numbered over the whole input in the caller's order, so a batch is the same rows at every run and a failure
names a range of that order. What a batch gives, vectors or an error, is written as a table before anything uses
it: a vector is asked for once, and a failed batch does not cost those that succeeded their place in the table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citewell.functions.vectors import NORM_TOLERANCE
from citewell.operators.numbering import numbered
from citewell.sources.shared import scratch

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


class BatchError(ValueError):
    """A batch failed: rows start to end (exclusive) of the caller's order, after so many attempts."""

    def __init__(self, start: int, end: int, attempts: int, error: str):
        super().__init__(f"embed [{start}:{end}] failed after {attempts} attempt{'s' if attempts > 1 else ''}: {error}")
        self.start, self.end, self.attempts, self.error = start, end, attempts, error


def vector_error(v: Sequence[float] | None, width: int) -> str | None:
    """What would spoil a cosine later: another width, values that are not finite, a zero or unnormalised vector."""
    if v is None or (width and len(v) != width):
        return f"expected {width} dimensions, got {0 if v is None else len(v)}"
    if any(x is None or not math.isfinite(x) for x in v):
        return "contains NaN or Inf"
    length = math.sqrt(sum(x * x for x in v))
    if not length:
        return "zero vector"
    return f"not normalized (norm {length:.4f})" if abs(length - 1) > NORM_TOLERANCE else None


def _retryable(e: Exception) -> bool:
    """Transport errors (no status), 429 and 5xx; a wrong answer is not asked for again."""
    status = getattr(e, "status", None)
    return (status is None and isinstance(e, (OSError, TimeoutError))) or (status is not None and (status == 429 or 500 <= status <= 599))


def _batch(frame: pd.DataFrame, embedder: Embedder, width: int, attempts: int, backoff: float) -> pd.DataFrame:
    frame = frame.sort_values("n")
    error, vectors, done = None, None, 0
    for done in range(1, attempts + 1):
        try:
            vectors, error = [None if v is None else [float(x) for x in v] for v in embedder(frame["text"].tolist())], None
            break
        except Exception as e:  # noqa: BLE001  whatever the embedder raises fails the batch
            error = f"{type(e).__name__}: {e}"
            if not _retryable(e) or done == attempts:
                break
            time.sleep(backoff * 2 ** (done - 1))
    if error is None and len(vectors) != len(frame):
        error = f"got {len(vectors)} vectors for {len(frame)} texts"
    if error is None:
        error = next((f"{i}: {x}" for i, v in zip(frame["id"], vectors, strict=True) if (x := vector_error(v, width))), None)
    return frame.assign(embedding=vectors if error is None else None, attempts=done, error=error)


def _answers(embedder: Embedder, width: int, attempts: int, backoff: float):
    """For mapInArrow over rows in order of batch and n: what every batch gave. Other columns pass through as they are."""
    import pyarrow as pa

    def told(table: pa.Table) -> list[pa.RecordBatch]:
        frame = pd.DataFrame({c: table.column(c).to_pylist() for c in ("id", "text", "n", "batch")})
        done = [_batch(own, embedder, width, attempts, backoff) for _, own in frame.groupby("batch", sort=False)]
        columns = {"embedding": pa.list_(pa.float64()), "attempts": pa.int32(), "error": pa.string()}
        for name, kind in columns.items():
            table = table.append_column(name, pa.array([x for out in done for x in out[name].tolist()], kind, from_pandas=True))
        return table.to_batches()

    def run(batches):
        held = []  # rows of a batch that may go on
        for rows in filter(len, batches):
            numbers, cut = rows.column("batch").to_pylist(), 0
            if held and held[0].column("batch")[0].as_py() != numbers[0]:
                yield from told(pa.Table.from_batches(held))
                held = []
            if numbers[-1] != numbers[0]:
                cut = numbers.index(numbers[-1])
                yield from told(pa.Table.from_batches([*held, rows.slice(0, cut)]))
                held = []
            held.append(rows.slice(cut))
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def embedded_rows(rows: DataFrame, embedder: Embedder, width: int, order: list[str], batch: int = 32, attempts: int = 3, backoff: float = 0.5, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows (id, text, any others) with n, batch, embedding, attempts, error: a table of what every batch gave.

    A batch either has a vector for each row or an error for each. An empty table gives no rows. save: writes the table
    (sources.shared.keep if none is given); the numbered rows go once it is written.
    """

    with scratch("embedded", "zstd") as result:
        own = numbered(rows, order, "n", codec="zstd").withColumn("batch", F.floor(F.col("n") / batch).cast("long"))
        schema = StructType([*own.schema, *StructType.fromDDL("embedding array<double>, attempts int, error string")])
        dealt = own.repartition("batch").sortWithinPartitions("batch", "n")
        return (save or result)(dealt.mapInArrow(_answers(embedder, width, attempts, backoff), schema))


def embedded(rows: DataFrame, embedder: Embedder, width: int, order: list[str], batch: int = 32, attempts: int = 3, backoff: float = 0.5, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with column embedding, or the BatchError of the first range that failed."""
    out = embedded_rows(rows, embedder, width, order, batch, attempts, backoff, save)
    bad = out.where("error is not null").groupBy("batch").agg(F.min("n").alias("start"), (F.max("n") + 1).alias("end"), F.max("attempts").alias("attempts"), F.max("error").alias("error"))
    first = bad.orderBy("batch").limit(1).collect()
    if first:
        raise BatchError(first[0]["start"], first[0]["end"], first[0]["attempts"], first[0]["error"])
    return out.select(*rows.columns, "embedding")
