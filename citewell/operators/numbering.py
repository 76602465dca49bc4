"""Numbers over a whole table, without a window over one partition.

Rows are range-sorted once and written with their place; the counts of ranges, one number each, are added up; the
number of a row is its range's start and its place there. A group's numbers start at the smallest of its rows, so a
group that holds most of the table is spread over as many ranges as it fills.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.sources.shared import keep

_PLACE = "_place"
_BITS = 33  # monotonically_increasing_id: the range above, the place in it below


def numbered(df: DataFrame, order: list[str | Column], name: str = "n", within: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """df and column `name` (from 0) in this order, or for each group of `within` in this order.

    Rows that tie on the order take numbers in no defined order: add columns until only equal rows tie. Nulls come
    first, as Spark sorts them; null groups are groups. An empty table gives no rows. codec: of the table kept between.
    """
    keys = [F.col(c) for c in within or []] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_PLACE, F.monotonically_increasing_id())
    placed = keep(placed, "placed", codec)
    at = F.shiftright(F.col(_PLACE), _BITS)
    ends = placed.groupBy(at.cast("int").alias("r")).agg(F.count("*").alias("n")).orderBy("r").collect()  # a row a range
    starts = list(zip([r["r"] for r in ends], accumulate([r["n"] for r in ends], initial=0), strict=False))
    if len(starts) > 1:
        listed = F.array(*[F.struct(F.lit(r).alias("_range"), F.lit(n).cast("long").alias("_start")) for r, n in starts])
        known = F.broadcast(df.sparkSession.range(1).select(F.inline(listed)))
        placed = placed.join(known, at.cast("int") == F.col("_range")).withColumn(_PLACE, F.col("_start") + F.col(_PLACE).bitwiseAND(F.lit((1 << _BITS) - 1)))
    elif starts:  # one range holds all, whichever it is
        placed = placed.withColumn(_PLACE, F.col(_PLACE).bitwiseAND(F.lit((1 << _BITS) - 1)))
    whole = placed.select(*df.columns, F.col(_PLACE).alias(name))
    if not within:
        return whole
    firsts = whole.groupBy(*within).agg(F.min(name).alias("_first")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], "_first")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)])
    return whole.join(firsts, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_g{i}" for i in range(len(within))])
