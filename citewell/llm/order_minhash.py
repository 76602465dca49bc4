"""Document fingerprints by Order MinHash: sensitive to edit distance, not only to the set of k-mers.

A text's k-mers of code points are numbered by occurrence, so repeats count. For each of `m` hash orders the
`l` smallest numbered k-mers are chosen, put back into text order and hashed as a tuple. Two texts agree in a
component when they chose the same k-mers in the same order; the share of equal components is the likeness.

Scale: a fingerprint needs its own text only. Pairing each document with the next one needs one shuffle of the
texts. The order is that of (doc_id, hash of the text); a table of these keys, without texts, is range-sorted, and
the first key of each range bounds it, so ids that many rows share, null among them, are split like any others. The
first document of each range also goes to the range before it. A task streams its sorted ranges and holds two
texts. Rows that are equal in id and text more than MANY times are fingerprinted once. Only the bounds reach the
driver, never texts or fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import bounded_batches, keep

#: k-mer length in code points; k-mers a tuple; tuples a fingerprint; the seed of the hash orders.
K, L, M, SEED = 5, 2, 64, 11
#: Rows of a range, about, unless that makes more ranges than the second number.
ROWS_A_RANGE, MOST_RANGES = 1500, 100_000
#: Equal rows from this number on are one row of the ranges; keys of such rows that may be broadcast.
MANY, BROADCAST_KEYS = 16, 100_000
_BLOCK = 1 << 18  # numbers hashed at once

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


class OrderMinHash:
    def __init__(self, k: int = K, l: int = L, m: int = M, seed: int = SEED):  # noqa: E741
        self.k, self.l, self.m = k, l, m
        draw = np.random.RandomState(seed)
        self.shift = draw.randint(0, 2**32, (m, 1), dtype=np.uint32)
        self.times = draw.randint(0, 2**32, (m, 1), dtype=np.uint32) | np.uint32(1)

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the occurrence-numbered k-mers, and where each begins. A shorter text is one k-mer."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = min(self.k, len(points))
        n = len(points) - k + 1
        codes = np.full(n, k, np.uint32)
        for j in range(k):
            codes = (codes + points[j : j + n]) * np.uint32(0x9E3779B1)
            codes ^= codes >> np.uint32(15)
        keys = (codes.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        keys.sort()
        codes = (keys >> np.uint64(32)).astype(np.uint32)
        at = np.arange(n)
        first = np.where(np.r_[True, codes[1:] != codes[:-1]], at, 0)
        occurrence = (at - np.maximum.accumulate(first)).astype(np.uint32)
        return _mix(codes + occurrence * np.uint32(0x85EBCA77)), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def signature(self, text: str) -> np.ndarray:
        """m numbers of 32 bits; all zero for the empty text alone."""
        if not text:
            return np.zeros(self.m, np.uint32)
        grams, place = self.numbered(text)
        n = len(grams)
        chosen = np.empty((self.m, min(self.l, n)), np.int64)
        step = max(1, _BLOCK // n)
        for lo in range(0, self.m, step):
            hi = min(self.m, lo + step)
            values = (grams ^ self.shift[lo:hi]) * self.times[lo:hi]
            rows = np.arange(hi - lo)
            for j in range(chosen.shape[1]):
                least = values.argmin(axis=1)
                chosen[lo:hi, j] = least
                values[rows, least] = 0xFFFFFFFF
        order = np.argsort(place[chosen], axis=1)
        in_order = grams[np.take_along_axis(chosen, order, axis=1)]
        out = np.full(self.m, chosen.shape[1], np.uint32)
        for j in range(in_order.shape[1]):
            out = _mix(out * np.uint32(0x9E3779B1) + in_order[:, j])
        return out | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint_udf(k: int = K, l: int = L, m: int = M, seed: int = SEED):  # noqa: E741
    """Column function: the fingerprint of a text as hexadecimal digits; null counts as empty."""
    hasher = OrderMinHash(k, l, m, seed)

    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hasher.signature(t or "").astype(">u4").tobytes().hex())

    return fingerprint


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Row:
    def __init__(self, no_id: bool, down: int, text: str, n: int):
        self.id, self.text, self.n = None if no_id else ~down, text, n


def _stream(batches, hasher: OrderMinHash) -> Iterator:
    """Rows come sorted by range, its own rows in order and then the first of the next range, of which the first counts."""
    import pyarrow as pa

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    hexadecimal = lambda x: x.astype(">u4").tobytes().hex()

    def row(own: _Row, sign: np.ndarray, text: str, following: np.ndarray) -> tuple:
        other = edited(own.text, text)
        changed = hasher.signature(other)
        return own.id, len(own.text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), hexadecimal(sign), hexadecimal(changed), likeness(sign, changed), likeness(sign, following)

    last, sign, part, done = None, None, None, False
    for batch in batches:
        out = []
        columns = [batch.column(batch.schema.names.index(c)) for c in ("part", "guest", "no_id", "down", "text", "n")]
        for i in range(batch.num_rows):
            at, guest, no_id, down, text, n = (c[i].as_py() for c in columns)
            if at != part:
                part, last, done = at, None, False
            if done:
                continue
            own = _Row(no_id, down, text, n)
            mark = hasher.signature(text)
            if last is not None:
                out.append(row(last, sign, text, mark))
            if not guest and n > 1:  # equal rows that stand for one: all but the last are followed by their equal
                out += [row(own, mark, text, mark)] * (n - 1)
            last, sign, done = own, mark, guest
        for lo in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[lo : lo + 4096], strict=True), kinds, strict=True)], names)


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", k=K, l=L, m=M, seed=SEED) -> DataFrame:  # noqa: E741
    """One row for each row of docs, in SCHEMA: its fingerprint, that of its edited text, and their likeness.

    The next document is the one with the next smaller doc_id (after the last: the first); equal ids follow each
    other by a hash of the text, null ids come last. Null text is empty. A table of one row is its own next.
    Two empty texts are alike (1); an empty and another text are not (0). An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    order = ["no_id", "down", "tie"]  # down: the complement of the id, so that the largest comes first
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.col("id").isNull().alias("no_id"), F.bitwise_not(F.coalesce("id", F.lit(0))).alias("down"), F.xxhash64("text").alias("tie"), "text")
    keys = keep(rows.groupBy(*order).agg(F.count("*").alias("n")), "order-keys")
    n = keys.agg(F.sum(F.least("n", F.lit(MANY)))).first()[0]
    if not n:
        return spark.createDataFrame([], SCHEMA)
    ranges = max(1, min(MOST_RANGES, -(-n // ROWS_A_RANGE)))
    ordered = keys.repartitionByRange(ranges, *order) if ranges > 1 else keys.coalesce(1)
    firsts = ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("k")).select("k.*").collect()  # at most `ranges` rows
    bounds = sorted((r["no_id"], r["down"], r["tie"]) for r in firsts)
    numbers = np.array([_key(*b) for b in bounds], "S17")

    @F.pandas_udf("struct<part int, first boolean>")
    def range_of(no_id: pd.Series, down: pd.Series, tie: pd.Series) -> pd.DataFrame:
        own = np.array([_key(*x) for x in zip(no_id.tolist(), down.tolist(), tie.tolist(), strict=True)], "S17")
        part = np.maximum(np.searchsorted(numbers, own, "right") - 1, 0)
        return pd.DataFrame({"part": part.astype(np.int32), "first": numbers[part] == own})

    many = keys.where(F.col("n") >= MANY)
    n_many = many.count()
    if n_many:
        known = F.broadcast(many) if n_many <= BROADCAST_KEYS else many
        equal = rows.join(known, order).groupBy(*order, "n").agg(F.first("text").alias("text"))
        rows = rows.join(known, order, "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(equal)
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    dealt = rows.withColumn("at", range_of(*order))
    own = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("at.part") - 1, F.lit(len(bounds))).cast("int").alias("part"), F.lit(True).alias("guest"))
    copies = F.explode(F.when(F.col("at.first"), F.array(own, guest)).otherwise(F.array(own)))
    dealt = dealt.select(*order, "text", "n", copies.alias("x")).select("x.part", "x.guest", *order, "n", "text")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "guest", *order)
    return dealt.mapInArrow(partial(_stream, hasher=OrderMinHash(k, l, m, seed)), SCHEMA)


def _key(no_id: bool, down: int, tie: int) -> bytes:
    """A key as bytes that sort as it does."""
    return bytes([no_id]) + (down + (1 << 63)).to_bytes(8, "big") + (tie + (1 << 63)).to_bytes(8, "big")


def op5(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
