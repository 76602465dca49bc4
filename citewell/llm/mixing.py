"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue. Its documents are shuffled by a seeded hash; a copy of a document gets the virtual
finish time (words of the source up to and including the copy) / (the source's target), so all sources reach
time 1 when each has given its target. Copies are taken in the order of finish time up to the total budget.

Scale: the text is read once, to count words. Rows are numbered over the table in the order of source and hash; running
sums within a source come from sums over every ROWS_A_RANGE numbers (partial aggregates) plus a window inside one such
range, so a source, an id (null among them) or an equal row with a third of all rows is spread over as many windows as
it needs. The cut is a single tuple: copies that finish by time 1 always fit,
and only the few that finish just after it are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import WORD, keep, text_or_empty
from citewell.operators.numbering import numbered

#: Weights by the rank of a source, repeating; the share of all words to take; the most copies.
WEIGHTS = (5, 2, 1)
BUDGET_RATIO = 1.5
MAX_COPIES = 2
SEED = 20_240_607
#: Rows of one window, about; and the most sources whose table is sent to every task.
ROWS_A_RANGE = 2_000
BROADCAST_SOURCES = 50_000
#: Keys of repeated rows that are sent to every task, at most.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_ratio=BUDGET_RATIO, max_copies=MAX_COPIES) -> DataFrame:
    """One row a source: sid (rank by code point, null last), source_size, weight, target.

    Targets are min(cap, level * weight): sorted by cap / weight, the level is what the budget leaves to the
    sources that stay below their caps. One row a source, so the windows here are as small as that table.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("sid", F.row_number().over(every) - 1)
    picked = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(picked, F.col("sid") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_copies))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumns(
        {
            "level_here": (F.sum("source_size").over(whole) * budget_ratio - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(onward),
            "ratio": F.col("cap") / F.col("weight"),
        }
    )
    level = F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(whole)
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return levels.select("sid", "source", "source_size", "weight", target.alias("target"))


def _finish(copy: int | Column) -> Column:
    return (F.col("source_size") * copy + F.col("upto")) / F.col("target")


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", **parameters) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken, first_finish, upto.

    Rows are globally range-sorted by the finish time of their first copy (numbers only; no text is moved).
    Parameters are those of decide().

    Null text counts as empty (size 0; such documents are never taken: they have no words to give). Null
    sources are one source, ordered last. Repeated rows are separate documents; rows of one id are ordered by their
    size and a hash of the text, so reruns agree. An empty table gives no rows.
    """
    decided = decide(_sized(docs, doc_id, text, source, F.xxhash64(text)), **parameters).drop("tie")
    return decided.repartitionByRange("first_finish", "doc_id").sortWithinPartitions("first_finish", "doc_id")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, tie: Column) -> DataFrame:
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    return keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), tie.alias("tie")), "mix-sizes")


def decide(sized: DataFrame, weights=WEIGHTS, budget_ratio=BUDGET_RATIO, max_copies=MAX_COPIES, seed=SEED) -> DataFrame:
    """The columns of mix() and tie for rows of doc_id, source, size and tie (any number that orders rows of one id)."""
    spark = sized.sparkSession
    targets = keep(source_targets(sized, weights, budget_ratio, max_copies).coalesce(1), "mix-targets")
    n_sources = targets.count()
    small = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    # 60 bits of a hash that SQL engines share; ties fall back to the id and the size
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    order = F.conv(F.left(F.sha2(key.cast("binary"), 256), F.lit(15)), 16, 10).cast("long")
    rows = sized.join(small, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", sized["source"], "size", "tie", "sid", "source_size", "target", order.alias("dealt")
    )
    # windows of ROWS_A_RANGE rows of the order, whatever repeats: no id, and no row, can fill one beyond that
    rows = numbered(rows.withColumn("row", F.monotonically_increasing_id()), ["sid", "dealt", "doc_id", "size", "tie", "row"], "n")
    rows = rows.withColumn("range", F.floor(F.col("n") / ROWS_A_RANGE).cast("long"))
    sums = rows.groupBy("sid", "range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("sid", "range").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.withColumn("here", F.sum("size").over(within)).join(sums, ["sid", "range"])
    dealt = keep(dealt.withColumn("upto", F.col("earlier") + F.col("here")).drop("earlier", "here", "range", "n", "row"), "mix-dealt")

    cut = _cut(dealt, max_copies, spark)
    copies = sum((F.when(_taken(c, cut), 1).otherwise(0) for c in range(max_copies)), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return dealt.select(
        "doc_id",
        "source",
        "size",
        "tie",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("target") > 0, _finish(0)).alias("first_finish"),
        "upto",
    )


def _taken(copy: int, cut: tuple | None) -> Column:
    finish = _finish(copy)
    within = finish <= 1.0
    if cut is not None:
        at = F.struct(finish.alias("f"), F.col("sid").alias("s"), F.col("upto").alias("u"), F.lit(copy).alias("c"))
        last = F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).cast("int").alias("s"), F.lit(cut[2]).cast("long").alias("u"), F.lit(cut[3]).alias("c"))
        within = within | (at <= last)
    return F.coalesce(within, F.lit(False))


def _cut(dealt: DataFrame, max_copies: int, spark) -> tuple | None:
    """(finish, sid, upto, copy) of the last copy after time 1 that the total budget still holds; None if none does."""
    live = dealt.where("size > 0 and target > 0")
    by_one = sum((F.when(_finish(c) <= 1.0, F.col("size")).otherwise(0) for c in range(max_copies)), F.lit(0))
    budget = dealt.select("sid", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    used = live.agg(F.sum(by_one)).first()[0] or 0
    left = budget - used
    if left < 1:
        return None
    beyond = live.select("sid", "upto", "size", F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), _finish(c).alias("finish")) for c in range(max_copies)])).alias("x")).select("sid", "upto", "size", "x.*").where("finish > 1")
    width = max(4.0 * left / budget, 1e-12)
    while True:
        near = beyond.where(F.col("finish") <= 1.0 + width)
        if (near.agg(F.sum("size")).first()[0] or 0) >= left or width > 2.0 * max_copies * 1e9:
            break
        if not beyond.where(F.col("finish") > 1.0 + width).limit(1).count():
            break
        width *= 4
    order = Window.orderBy("finish", "sid", "upto", "copy").rowsBetween(Window.unboundedPreceding, 0)
    last = near.withColumn("sum", F.sum("size").over(order)).where(F.col("sum") <= left).orderBy(F.desc("finish"), F.desc("sid"), F.desc("upto"), F.desc("copy")).select("finish", "sid", "upto", "copy").first()
    return tuple(last) if last else None


def mixed_documents(docs: DataFrame, doc_id="doc_id", text="text", source="source", ordered=True, **parameters) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; keeps the columns of docs.

    ordered: globally range-sorted by finish time, which moves all texts once more; a step that deals documents
    anew (such as packing) does not need it. Null and empty texts are never taken. Rows meet their decisions by a
    hash of the whole row (so no column may be a map); rows that are equal in all columns are one document of that
    join and appear as often as all of them are taken. Reruns give the same rows. An empty table gives no rows.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(F.lit(SEED), *names, *[F.col(f"`{c}`").isNull() for c in docs.columns])  # a hash skips nulls
    decided = keep(decide(_sized(docs, doc_id, text, source, row), **parameters).where("copies > 0").select("tie", "copies", "source_size", "target", "upto"), "mix-decided")
    repeated = decided.groupBy("tie").agg(F.count("*").alias("n")).where("n > 1")
    held = docs.select(F.struct(*names).alias("_doc"), row.alias("_tie"))
    finish = (F.col("source_size") * F.col("_copy") + F.col("upto")) / F.col("target")
    copies = decided.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("tie", finish.alias("_finish"))
    n = repeated.count()
    if n:
        # equal rows: one text for each slice of about ROWS_A_RANGE of their copies
        known = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
        again = copies.join(known, "tie").withColumn("_slice", F.pmod(F.xxhash64("_finish"), F.ceil(F.col("n") / ROWS_A_RANGE)))
        one = held.join(known, F.col("_tie") == F.col("tie")).groupBy("_tie", "n").agg(F.first("_doc").alias("_doc"))
        one = one.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / ROWS_A_RANGE) - 1)))
        again = one.drop("n").join(again.drop("n"), (F.col("_tie") == F.col("tie")) & (one["_slice"] == again["_slice"])).select("_doc", "_finish", "_tie")
        lone = copies.join(known, "tie", "left_anti")
    else:
        again, lone = None, copies
    # decisions grow with the documents: never broadcast, so that the plan is the same at every size
    taken = held.join(lone.hint("merge"), F.col("_tie") == F.col("tie")).select("_doc", "_finish", "_tie")
    taken = taken.unionByName(again) if again is not None else taken
    taken = taken.repartitionByRange("_finish", "_tie").sortWithinPartitions("_finish", "_tie") if ordered else taken
    return taken.select("_doc.*")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_finish")
