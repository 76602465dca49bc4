"""Scans and lookups: filters that reach the file scan, with a defined order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """A point lookup that met no row."""


def where_equal(df: DataFrame, order: list[str] | None = None, **values) -> DataFrame:
    """Rows whose columns equal the values; ordered where an order is given."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order) if order else df


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a key, as a table of at most one row."""
    return where_equal(df, **key).limit(1)


def get(df: DataFrame, **key) -> dict:
    """The row of a key; NotFound without one."""
    found = lookup(df, **key).collect()
    if not found:
        raise NotFound(str(key))
    return found[0].asDict(recursive=True)


def ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.orderBy(*by)


def narrow(df: DataFrame, guard: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a guard, and one row with the number of those that do not (null counts as not passing)."""
    ok = F.coalesce(guard, F.lit(False))
    return df.where(ok), df.agg(F.count_if(~ok).alias("rejected"))


def public(df: DataFrame, hidden: Callable[[str], bool] | set[str]) -> DataFrame:
    """df without hidden columns."""
    hide = hidden if callable(hidden) else hidden.__contains__
    return df.select(*[c for c in df.columns if not hide(c)])


def fields(schema, prefix: str = "") -> list[str]:
    """Paths of all fields of a schema, through structs, arrays and maps."""
    from pyspark.sql import types as t

    if isinstance(schema, t.StructType):
        return [p for f in schema.fields for p in (prefix + f.name, *fields(f.dataType, f"{prefix}{f.name}."))]
    if isinstance(schema, t.ArrayType):
        return fields(schema.elementType, prefix)
    if isinstance(schema, t.MapType):
        return fields(schema.valueType, prefix)
    return []


def forbidden(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of fields, at any depth, whose name must not be shown."""
    return [p for p in fields(df.schema) if p.rpartition(".")[2] in names]


def parse_list(text: str) -> list[tuple[int, int]]:
    """Numbers and ranges such as `3, 7-12` as (first, last), in order; anything else is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        try:
            out.append((int(low), int(high if dash else low)))
        except ValueError:
            raise ValueError(f"bad entry or range: {part!r}") from None
    return sorted(out)


def select_entries(entries: DataFrame, number: str, wanted: str = "", queue: Column | None = None) -> DataFrame:
    """Entries in the order of their number: those of a list with ranges (a number that is missing is an error, one that
    is asked for twice comes twice), else those in the queue, else all."""
    if not wanted:
        return (entries if queue is None else entries.where(queue)).orderBy(number)
    asked = entries.sparkSession.createDataFrame(parse_list(wanted), "_lo long, _hi long").where("_lo <= _hi")
    asked = asked.select(F.explode(F.sequence("_lo", "_hi")).alias("_n"))
    missing = asked.join(entries.select(F.col(number).cast("long").alias("_n")), "_n", "left_anti").orderBy("_n").limit(5).collect()
    if missing:
        raise LookupError("no such entry: " + ", ".join(str(r[0]) for r in missing))
    return entries.join(F.broadcast(asked), F.col(number) == F.col("_n")).drop("_n").orderBy(number)  # as long as the list


def gated_group(chunks: DataFrame, group_id) -> DataFrame:
    """The verified chunks of a group in the order (start, id)."""
    return chunks.where((F.col("group_id") == group_id) & F.col("verified")).orderBy("start", "id")


def pending_anchors(rows: DataFrame) -> DataFrame:
    """One row: how many different anchors have something pending."""
    return rows.where("review_status = 'pending'").agg(F.count_distinct("group_id", "anchor").alias("pending"))
