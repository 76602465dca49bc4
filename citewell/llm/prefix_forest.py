"""Approximate nearest neighbours by a forest of hash prefixes (largest inner product).

Every vector gets one hash string of signs in each of TREES trees (random hyperplanes; vectors are first lifted by
one coordinate so that their lengths are equal and the angle orders them as the inner product does). A tree is the
sorted array of its strings. A query descends to its longest prefix match in every tree, and all trees ascend
together, one bit at a time.

How far to ascend is decided for each query by what it has found. It first ascends until FIRST x k entries are
reached in each block, scores those, and so learns an angle within which k vectors lie. A vector at an angle a
agrees with the query in one bit with probability p = 1 - a / pi, so it is under the prefix of length l in at
least one tree with probability 1 - (1 - p^l)^TREES. The query then ascends to the longest l where that is RECALL
or more at the angle found. The true k nearest are nearer than that, so each is found with at least that
probability; everything under the prefixes is scored exactly, without a cap. Where vectors crowd around queries,
prefixes stay long and little of the index is scored; where the nearest are hardly nearer than the rest, most of
it is, as for any hash.

Scale: strings are computed once, with their number of bits from the size of the index, and stored beside the
vectors. The index is dealt into blocks of vectors by a hash, and a task sorts the strings of one block into its
arrays; a vector is stored once, no prefix is a hot key, and a candidate that several trees find is scored once.
Equal vectors are indexed once, with the smallest ids that can be asked for. Queries meet the blocks in chunks; a
query costs a block 2 x TREES binary searches and its candidates' scores. Nothing is broadcast but the hyperplanes'
seed and one number a width.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import keep, power_of_two_at_least

TREES, SEED = 64, 71
NEIGHBOURS = 20
#: The least probability that a neighbour is found; entries, in multiples of k, that the first ascent reaches in a block.
RECALL, FIRST = 0.92, 4
#: Bits of a hash string: so many more than the logarithm of the index, between these.
MORE_BITS, LEAST_BITS, MOST_BITS = 6, 16, 32
#: Vectors of a block; queries of a chunk, at least and at most; chunks times blocks to have work for many tasks.
BLOCK, LEAST_CHUNK, CHUNK, TASKS = 16_384, 256, 16_384, 24


def usable(vector: str) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def string_bits(n: int) -> int:
    """Bits of the hash strings of an index of n vectors."""
    return min(MOST_BITS, max(LEAST_BITS, power_of_two_at_least(max(n, 1)) + MORE_BITS))


def _planes(width: int, bits: int) -> np.ndarray:
    return np.random.RandomState(SEED).standard_normal((width + 1, TREES * bits)).astype(np.float32)


def _strings(vectors: np.ndarray, longest: float, bits: int, planes: np.ndarray, query: bool) -> np.ndarray:
    """Hash strings as numbers of `bits` bits, most significant first: one column a tree."""
    if query:
        lengths = np.linalg.norm(vectors, axis=1)
        lifted = np.c_[vectors / lengths[:, None], np.zeros(len(vectors))]
    else:
        scaled = vectors / longest
        lifted = np.c_[scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))]
    signs = (lifted.astype(np.float32) @ planes > 0).reshape(len(vectors), TREES, bits)
    return (signs.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))).astype(np.uint32)


class Forest:
    """The sorted arrays of all trees over the vectors of one block."""

    def __init__(self, strings: np.ndarray, bits: int):
        self.bits = bits
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def ranges(self, tree: int, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of the tree's array under each string's prefix of `level` bits."""
        free = self.bits - level
        low = strings.astype(np.uint64) >> np.uint64(free) << np.uint64(free)
        high = (low + np.uint64((1 << free) - 1)).astype(np.uint32)
        own = self.sorted[:, tree]
        return np.searchsorted(own, low.astype(np.uint32), "left"), np.searchsorted(own, high, "right")

    def ascend(self, strings: np.ndarray, enough: int) -> np.ndarray:
        """For each query the longest prefix length under which all trees together have `enough` entries; 0: all.

        What a length reaches grows as it gets shorter, so the length is found by bisection.
        """
        low, high = np.zeros(len(strings), np.int64), np.full(len(strings), self.bits)
        while (low < high).any():
            middle = (low + high + 1) // 2
            reached = np.zeros(len(strings), np.int64)
            for level in np.unique(middle[middle > 0]):
                own = np.flatnonzero((middle == level) & (low < high))
                for tree in range(self.sorted.shape[1]):
                    lo, hi = self.ranges(tree, strings[own, tree], int(level))
                    reached[own] += hi - lo
            ok, open_ = reached >= enough, low < high
            low = np.where(open_ & ok, middle, low)
            high = np.where(open_ & ~ok, middle - 1, high)
        return low

    def candidates(self, strings: np.ndarray, levels: np.ndarray):
        """For each query: the vectors under its prefix of the given length in any tree; length 0 reaches all."""
        n = len(self.order)
        lows, highs = (np.empty(strings.shape, np.int64) for _ in range(2))
        for level in np.unique(levels):
            own = np.flatnonzero(levels == level)
            for tree in range(strings.shape[1]):
                lows[own, tree], highs[own, tree] = self.ranges(tree, strings[own, tree], int(level)) if level else (0, n)
        seen = np.zeros(n, bool)
        for q in range(len(strings)):
            if not levels[q]:
                yield np.arange(n)
                continue
            seen[:] = False
            for tree in np.flatnonzero(highs[q] > lows[q]).tolist():
                seen[self.order[lows[q, tree] : highs[q, tree], tree]] = True
            yield np.flatnonzero(seen)


def level_for(cosine: np.ndarray, bits: int, recall: float = RECALL) -> np.ndarray:
    """The longest prefix under which one of TREES trees has a vector at this angle with probability `recall`."""
    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    each = 1 - (1 - recall) ** (1 / TREES)
    with np.errstate(divide="ignore"):
        level = np.floor(np.log(each) / np.log(np.clip(agree, 0, 1 - 1e-12)))
    return np.clip(np.nan_to_num(level, posinf=bits), 0, bits).astype(np.int64)


def _matrix(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _search(key, queries: pd.DataFrame, index: pd.DataFrame, bits: dict[int, int], k: int, first: int | None) -> pd.DataFrame:
    """The best of each query in one block, and a row without vec_id that says how many vectors were scored.

    first: how many entries to ascend to (the queries' levels are not known yet).
    """
    names = ["query_id", "vec_id", "score", "scored"]
    if not len(queries) or not len(index):
        return pd.DataFrame(columns=names)
    forest = Forest(_matrix(index["s"], np.uint32), bits[int(key[0])])
    q, v, strings = _matrix(queries["v"]), _matrix(index["v"]), _matrix(queries["s"], np.uint32)
    levels = forest.ascend(strings, first) if first is not None else queries["level"].to_numpy(np.int64)
    ids, out = index["ids"].tolist(), []
    for i, (query_id, own) in enumerate(zip(queries["query_id"].tolist(), forest.candidates(strings, levels), strict=True)):
        if not len(own):
            continue
        near = v[own] @ q[i]
        take = min(k + 1, len(own))  # one class more: the query's own id may be alone in its class
        least = np.partition(near, len(own) - take)[len(own) - take]
        best = own[near >= least - 1e-9 * max(1.0, abs(least))]
        # component by component in a fixed order, so that equal vectors have equal scores wherever they stand
        exact = np.add.reduce(np.ascontiguousarray((v[best] * q[i]).T), axis=0)
        found = [(-score, x) for at, score in zip(best.tolist(), exact.tolist(), strict=True) for x in ids[at] if x != query_id]
        out += [(query_id, x, -score, 0) for score, x in sorted(found)[:k]]
        out.append((query_id, None, None, len(own)))
    done = pd.DataFrame(out, columns=names, dtype=object)
    return done.astype({"query_id": "Int64", "vec_id": "Int64", "score": float, "scored": "Int64"})


def nearest(table: DataFrame, is_query: Column, vec_id="vec_id", vector="embedding", k=NEIGHBOURS, recall=RECALL, first=FIRST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among all other rows; scored: how
    many different vectors the query was compared with in its last ascent.

    Unusable vectors (null, zero, null or non-finite components) take no part, as queries or as candidates. Vectors
    meet only those of their own width. Ties go to the smaller vec_id. Of rows with one id and one vector, one
    takes part; a null id takes no part. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    spark = table.sparkSession
    rows = table.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"), is_query.alias("q"))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: np.asarray(x, np.float64).tobytes())

    rows = keep(rows.select("vec_id", F.coalesce("q", F.lit(False)).alias("q"), F.size("x").alias("width"), packed("x").alias("v"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b).alias("square")).dropDuplicates(["vec_id", "v"]), "forest-rows")
    found = rows.groupBy("width").agg(F.max("square").alias("longest"), F.count("*").alias("n"), F.count_if("q").alias("m")).collect()  # one row a width
    if not any(r["m"] for r in found):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    longest = {r["width"]: float(np.sqrt(r["longest"])) * (1 + 1e-12) for r in found}
    bits = {r["width"]: string_bits(r["n"]) for r in found}

    @F.pandas_udf("binary")
    def hashed(vectors: pd.Series, queries: pd.Series) -> pd.Series:
        out, widths = [b""] * len(vectors), vectors.map(len) // 8
        for w in widths.unique().tolist():
            planes = _planes(w, bits[w])
            for query in (False, True):
                at = np.flatnonzero((widths == w).to_numpy() & (queries.to_numpy(bool) == query))
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    for i, row in zip(part.tolist(), _strings(_matrix(vectors.iloc[part]), longest[w], bits[w], planes, query), strict=True):
                        out[i] = row.tobytes()
        return pd.Series(out)

    # classes of equal vectors with their k + 1 smallest ids: of each salt, then of all
    by_salt = Window.partitionBy("width", "v", "salt").orderBy("vec_id")
    by_class = Window.partitionBy("width", "v").orderBy("vec_id")
    least = rows.select("width", "v", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn("r", F.row_number().over(by_salt)).where(F.col("r") <= k + 1)
    least = least.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    classes = least.groupBy("width", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = keep(classes.select("width", "v", "ids", F.xxhash64("v").alias("h"), hashed("v", F.lit(False)).alias("s")), "forest-classes")
    n, m = classes.count(), max(r["m"] for r in found)
    blocks = max(1, -(-n // BLOCK))
    chunks = max(1, -(-m // min(CHUNK, max(LEAST_CHUNK, m * blocks // TASKS))))
    asked = rows.where("q").select("width", "v", F.col("vec_id").alias("query_id"), hashed("v", F.lit(True)).alias("s"))
    asked = keep(asked.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks))), "forest-queries")
    all_of = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<long>"))
    index = classes.select("width", "v", "s", "ids", F.pmod("h", F.lit(blocks)).alias("block"), all_of(chunks).alias("chunk"))
    on, schema = ["width", "chunk", "block"], "query_id long, vec_id long, score double, scored long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda hits: hits.where("vec_id is not null").withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)

    near = _cogroup(asked.withColumn("block", all_of(blocks)), index, on, partial(_search, bits=bits, k=k, first=first * k), schema)
    # the k-th best so far; a query that has found fewer goes through everything
    reach = top(near).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    reach = reach.select("query_id", F.when(F.col("n") >= k, F.col("score")).alias("reach"))

    @F.pandas_udf("int")
    def level(reach: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(reach), np.int32)
        for i, (score, v) in enumerate(zip(reach, vectors, strict=True)):
            if not np.isnan(score):
                x = np.frombuffer(v, np.float64)
                out[i] = level_for(np.array(score / (np.linalg.norm(x) * longest[len(x)])), bits[len(x)], recall)
        return pd.Series(out)

    leveled = keep(asked.join(reach, "query_id", "left").withColumn("level", level("reach", "v")).drop("reach"), "forest-levels")
    hits = keep(_cogroup(leveled.withColumn("block", all_of(blocks)), index, on, partial(_search, bits=bits, k=k, first=None), schema), "forest-hits")
    scored = hits.where("vec_id is null").groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return top(hits).drop("scored").join(scored, "query_id").select("query_id", "rank", "vec_id", "score", "scored")


def _cogroup(left: DataFrame, right: DataFrame, on: list[str], run, schema: str) -> DataFrame:
    def each(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(key, a, b)

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(each, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % 20 == 0)
