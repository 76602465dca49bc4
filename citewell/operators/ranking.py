"""Ranks, batches and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.operators.numbering import numbered


def duplicate_index(df: DataFrame, keys: list[str], order: list[str], name: str = "dup") -> DataFrame:
    """Position, from 0, among rows with equal keys, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def batched(df: DataFrame, size: int, order: list[str], within: list[str] | None = None, name: str = "batch") -> DataFrame:
    """Windows of `size` rows in order, over the table or within groups; numbered range by range, never in one task."""
    return numbered(df, order, "_n", within).withColumn(name, F.floor(F.col("_n") / size).cast("long")).drop("_n")


def bounded(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first n rows in order (a top-k, no full sort), and one row that tells whether more were left."""
    total = df.agg((F.count("*") > n).alias("truncated"), F.count("*").alias("available"))
    return df.orderBy(*order).limit(n), total


def first_seen_distinct(values: Column, drop_empty: bool = False) -> Column:
    """Distinct elements in the order of their first occurrence."""
    kept = F.filter(values, lambda x: x != "") if drop_empty else values
    return F.array_distinct(kept)


def first_failures(df: DataFrame, value: str, order: list[str], n: int = 20) -> DataFrame:
    """One row: the first n values in order, as an array."""
    top = df.orderBy(*order).limit(n)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias("sample"))


def planned_calls(n: Column, batch: int = 32) -> Column:
    return F.ceil(n / batch).cast("long")
