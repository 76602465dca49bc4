"""Range-anchored retrieval: exact lookup first, similarity within the group as a fallback.

A range is joined by exploding it to its anchors (ranges that exceed their group are rejected before that, so a
range has at most as many rows as its group has anchors) and an equi-join on (group, anchor).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THEMATIC_K = 5
#: Verdicts of a retrieval sweep, in the order of a report.
VERDICTS = ("PASS_EXACT", "NEEDS_REVIEW_THEMATIC", "GAP_INSUFFICIENT_EVIDENCE", "ERROR")


def covers(anchor: Column, start: Column, end: Column) -> Column:
    """Whether a range holds an anchor; 0/0 marks a chunk without one."""
    return (start > 0) & (start <= anchor) & (anchor <= end)


def anchored(mappings: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """mappings (group_id, start, end, ...) with one row for each anchor they cover, as column anchor.

    Ranges that do not begin at 1 or later, are inverted, or end beyond the group's size are left out.
    """
    sized = mappings.join(group_sizes.select("group_id", F.col("n").alias("_n")), "group_id")
    valid = sized.where((F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_n")))
    return valid.drop("_n").withColumn("anchor", F.explode(F.sequence("start", "end")))


def exact_hits(anchors: DataFrame, mappings: DataFrame, group_sizes: DataFrame) -> DataFrame:
    """(group_id, anchor, chunk_id, start, end) of every verified mapping over every anchor asked for."""
    hits = anchored(mappings.where("verified"), group_sizes)
    return anchors.select("group_id", "anchor").join(hits, ["group_id", "anchor"]).select("group_id", "anchor", "chunk_id", "start", "end")


def topk_in_group(queries: DataFrame, candidates: DataFrame, k: int = THEMATIC_K, block: int = 4096) -> DataFrame:
    """query_id, chunk_id, score: the k candidates of the query's group with the largest cosine, ties to smaller ids.

    queries: query_id, group_id, v; candidates: chunk_id, group_id, v (arrays of numbers). Candidates are dealt into
    blocks and queries into portions of that size; each portion meets every block of its group, and each meeting returns
    the best k, so pairs never become rows and no task holds more than about one portion and one block of a group.
    """
    sizes = candidates.groupBy("group_id").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    asked = queries.groupBy("group_id").agg(F.ceil(F.count("*") / block).cast("long").alias("portions"))
    sizes = sizes.join(asked, "group_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    c = candidates.join(sizes, "group_id").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks"))).withColumn("portion", every("portions"))
    q = queries.join(sizes, "group_id").withColumn("portion", F.pmod(F.xxhash64("query_id"), F.col("portions"))).withColumn("block", every("blocks"))
    kinds = dict(queries.dtypes)["query_id"], dict(candidates.dtypes)["chunk_id"]
    # fresh columns: both sides may come from one table
    q = q.select(*[F.col(x).alias(x) for x in ("group_id", "portion", "block", "query_id", "v")])
    meet = "group_id", "portion", "block"
    best = q.groupBy(*meet).cogroup(c.select(*meet, "chunk_id", "v").groupBy(*meet))
    found = best.applyInPandas(partial(_best, k=k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    columns = ["query_id", "chunk_id", "score"]
    if not len(queries) or not len(candidates):
        return pd.DataFrame(columns=columns)
    out = []
    ids = candidates["chunk_id"].to_numpy()
    usable = [x if x is not None else [] for x in candidates["v"]]
    for width in sorted({len(x) for x in usable}):
        own = np.array([i for i, x in enumerate(usable) if len(x) == width])
        table = np.array([np.asarray(usable[i], float) for i in own]).reshape(len(own), width)
        lengths = np.sqrt((table * table).sum(axis=1))
        for query_id, v in zip(queries["query_id"], queries["v"], strict=True):
            q = np.asarray(v if v is not None else [], float)
            n = np.sqrt((q * q).sum())
            good = len(q) == width and width > 0 and n > 0
            score = np.divide(table @ q, lengths * n, out=np.zeros(len(own)), where=lengths > 0) if good else np.zeros(len(own))
            score = np.round(score, 12)
            order = np.lexsort((ids[own], -score))[:k]
            out += [(query_id, ids[own[i]], float(score[i])) for i in order]
    return pd.DataFrame(out, columns=columns)


def evidence_chain(anchors: DataFrame, mappings: DataFrame, group_sizes: DataFrame, thematic: DataFrame, k: int = THEMATIC_K, embedder: bool = True) -> DataFrame:
    """tier and evidence of every anchor: group_id, anchor, tier, rank, chunk_id, score.

    anchors: group_id, anchor, v. Exact hits suppress the fallback; anchors without any get the k most similar
    verified thematic chunks of their group; those left are one row `insufficient`. Without an embedder, or with a
    null or empty query vector, a gap is insufficient.
    """
    hits = exact_hits(anchors, mappings, group_sizes)
    served = anchors.join(hits, ["group_id", "anchor"], "left")
    by_start = Window.partitionBy("group_id", "anchor").orderBy("start", "chunk_id")
    none = F.lit(None).cast("double")
    exact = served.where("chunk_id is not null").select("group_id", "anchor", F.lit("exact").alias("tier"), F.row_number().over(by_start).alias("rank"), "chunk_id", none.alias("score"))
    gaps = served.where("chunk_id is null").select("group_id", "anchor", "v")
    asked = gaps.where(F.lit(embedder) & F.col("v").isNotNull() & (F.size("v") > 0))
    asked = asked.select(F.struct("group_id", "anchor").alias("query_id"), "group_id", "v")
    found = topk_in_group(asked, thematic.where("verified").select("chunk_id", "group_id", "v"), k)
    found = found.select("query_id.group_id", "query_id.anchor", "rank", "chunk_id", "score")
    fallback = gaps.select("group_id", "anchor").join(found, ["group_id", "anchor"], "left")
    tier = F.when(F.col("chunk_id").isNull(), "insufficient").otherwise("thematic")
    return exact.unionByName(fallback.select("group_id", "anchor", tier.alias("tier"), F.coalesce("rank", F.lit(0)).alias("rank"), "chunk_id", "score"))


def retrieval_verdicts(chain: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """verdict and n for every verdict, zeros kept, and a TOTAL row. failed: anchors whose lookup raised an error."""
    tier = F.max(F.when(F.col("tier") == "exact", 3).when(F.col("tier") == "thematic", 2).otherwise(1))
    each = chain.groupBy("group_id", "anchor").agg(tier.alias("t"))
    word = F.when(F.col("t") == 3, VERDICTS[0]).when(F.col("t") == 2, VERDICTS[1]).otherwise(VERDICTS[2])
    seen = each.select(word.alias("verdict"))
    if failed is not None:
        seen = seen.unionByName(failed.select(F.lit(VERDICTS[3]).alias("verdict")))
    counted = seen.groupBy("verdict").agg(F.count("*").alias("n"))
    every = chain.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    rows = every.join(counted, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return rows.unionByName(seen.agg(F.count("*").alias("n")).select(F.lit("TOTAL").alias("verdict"), "n"))
