"""Vector codes: each vector as one small codebook index a part, by rounds of assigning and averaging in integers.

Each round broadcasts one kd-tree a codebook (at most ENTRIES points each, so a bounded size). A task walks the tree
with all vectors of a batch at once: branch and bound, near side first, and a far side is visited where its bound is
no larger than the best distance so far, so that an equally near entry with a lower index is found. Tasks send integer
sums by (part, entry, position), which Spark adds up; only these, entries x dimensions numbers, reach the driver.

Scale: vectors are turned into integers once, in a table of the shared folder; each round reads that column, without a
shuffle of vectors. What a round shuffles is tasks x entries x dimensions numbers. A hot label is pre-aggregated.

Defined results: a vector that is null or empty, or holds null or non-finite components, is dropped; so is one whose
length parts do not divide, or that differs in length from the first kept one (smallest id). Null ids sort last; rows
that repeat an id count one by one, ordered by their components. Fewer vectors than entries give that many entries.
Integers are bounded to +-2^((62 - log2(length)) / 2 - 1), so that no distance leaves 64 bits (2^27 for 64
components, values of +-32768); an error summed over a label stops at the largest long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import keep, scratch, table

#: Parts of a vector, entries of a codebook, rounds, and the factor that turns components into integers.
PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096
#: The most entries of a kd-tree's leaf.
LEAF = 2
_FAR = np.iinfo(np.int64).max


class KdTree:
    """The entries of one codebook; nearest() finds for many points at once the nearest entry, ties to the lower index."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, np.int64)
        self.nodes: list[tuple] = []
        self._build(np.arange(len(self.points)))

    def _build(self, own: np.ndarray) -> int:
        """Adds the node of these entries: (lowest corner, highest corner, entries or None, left, right)."""
        at, points = len(self.nodes), self.points[own]
        low, high = points.min(0), points.max(0)
        self.nodes.append((low, high, own, -1, -1))
        axis = int(np.argmax(high - low))
        if len(own) > LEAF and high[axis] > low[axis]:
            order = own[np.argsort(points[:, axis], kind="stable")]
            half = len(own) // 2
            left, right = self._build(np.sort(order[:half])), self._build(np.sort(order[half:]))
            self.nodes[at] = (low, high, None, left, right)
        return at

    def bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distance from each point to the node's box: no entry below the node is nearer."""
        low, high = self.nodes[node][:2]
        off = np.maximum(low - q, 0) + np.maximum(q - high, 0)
        return (off * off).sum(1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of q."""
        best, index = np.full(len(q), _FAR), np.full(len(q), len(self.points))
        self._visit(0, np.arange(len(q)), np.zeros(len(q), np.int64), q, best, index)
        return index, best

    def _visit(self, node: int, rows: np.ndarray, bound: np.ndarray, q: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        rows = rows[bound <= best[rows]]  # an equal bound too: the entry may tie and have a lower index
        if not len(rows):
            return
        _, _, own, left, right = self.nodes[node]
        if own is not None:
            for entry in own:
                off = q[rows] - self.points[entry]
                d = (off * off).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], entry
            return
        to_left, to_right = self.bound(left, q[rows]), self.bound(right, q[rows])
        near = to_left <= to_right
        self._visit(left, rows[near], to_left[near], q, best, index)
        self._visit(right, rows[~near], to_right[~near], q, best, index)
        self._visit(right, rows[near], to_right[near], q, best, index)
        self._visit(left, rows[~near], to_left[~near], q, best, index)


def most(length: int) -> int:
    """The bound of a component's integer."""
    return 1 << int((62 - np.log2(max(length, 1))) / 2 - 1)


def _integers(batches, parts: int, factor: int) -> Iterator:
    """Kept vectors as integers, in batches of (id, label, v)."""
    import pyarrow as pa

    for batch in batches:
        vectors = batch.column(2)
        if not batch.num_rows:
            continue
        lengths = np.diff(vectors.offsets.to_numpy())
        values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        starts = vectors.offsets.to_numpy()[:-1]
        fine = (vectors.is_valid().to_numpy(zero_copy_only=False)) & (lengths > 0) & (lengths % parts == 0)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        fine &= bad[starts + lengths] == bad[starts]
        rows = np.flatnonzero(fine)
        out = []
        for i in rows:
            x = values[starts[i] : starts[i] + lengths[i]] * factor
            out.append(np.floor(np.clip(x, -most(len(x)), most(len(x)))).astype(np.int32))
        ints = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), ints], ["id", "label", "v"])


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _assign(matrix: np.ndarray, trees: list[KdTree]) -> tuple[np.ndarray, np.ndarray]:
    """(index of each part, squared distance over all parts) of each row."""
    w = matrix.shape[1] // len(trees)
    codes, error = np.empty((len(matrix), len(trees)), np.int64), np.zeros(len(matrix), np.int64)
    for p, tree in enumerate(trees):
        codes[:, p], d = tree.nearest(matrix[:, p * w : (p + 1) * w])
        error += d
    return codes, error


def _sums(batches, trees) -> Iterator:
    """What a task adds to each entry: its count, and its sum at each position."""
    import pyarrow as pa

    books: list[KdTree] = trees.value
    w, k = books[0].points.shape[1], len(books[0].points)
    count, total = np.zeros((len(books), k), np.int64), np.zeros((len(books), k, w), np.int64)
    for batch in batches:
        matrix = _matrix(batch.column(0))
        if not len(matrix):
            continue
        codes, _ = _assign(matrix, books)
        for p in range(len(books)):
            count[p] += np.bincount(codes[:, p], minlength=k)
            np.add.at(total[p], codes[:, p], matrix[:, p * w : (p + 1) * w])
    p, e, at = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
    used = np.repeat(count.ravel(), w)
    rows = np.flatnonzero(used)
    yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (p, e, at, used, total.ravel())], ["part", "entry", "at", "n", "total"])


def _codes(batches, trees) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        matrix = _matrix(batch.column(2))
        if len(matrix):
            codes, error = _assign(matrix, trees.value)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(error)], ["id", "label", "code", "error"])


def fit(ints: DataFrame, first: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, position) after the rounds, from the entries that `first` gives (entry, part, position)."""
    context = ints.sparkSession.sparkContext
    books = first.transpose(1, 0, 2).copy()
    for _ in range(rounds):
        trees = context.broadcast([KdTree(b) for b in books])
        sums = ints.select("v").mapInArrow(partial(_sums, trees=trees), "part int, entry int, at int, n long, total long")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for part, entry, at, n, total in sums.collect():  # as many rows as the codebooks have numbers
            books[part, entry, at] = int(total) // n  # rounds down
        trees.unpersist()
    return books


def encode(vectors: DataFrame, vec_id="vec_id", vector="embedding", label="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, factor=FACTOR) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error and codebooks_sha256 of each kept vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    kind = vectors.schema[label].dataType.simpleString()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    with scratch("codes") as result:
        given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
        ints = keep(given.mapInArrow(partial(_integers, parts=parts, factor=factor), f"id long, label {kind}, v array<int>"), "integers")
        first = ints.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(1).collect()
        if not first:
            return result(spark.createDataFrame([], schema))
        length = len(first[0]["v"])
        ints = ints.where(F.size("v") == length)
        start = ints.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
        books = fit(ints, np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1), parts, rounds)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        coded = keep(ints.mapInArrow(partial(_codes, trees=trees), f"id long, label {kind}, code string, error long"), "coded")
        longest = F.lit(2**63 - 1).cast("decimal(38,0)")
        totals = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), longest).cast("long").alias("label_error"))
        joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
        return result(joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def op13(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The same rounds in SQL: every part against every entry."""
    nearest = """SELECT rid, p.part, arg_min(entry, {{'d': {d}, 'e': entry}}) AS entry, min({d}) AS d FROM p JOIN c{k} c ON c.part = p.part GROUP BY rid, p.part"""
    d = "list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k, d=d)})")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (SELECT p.part, entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS pos FROM p JOIN a{k} a ON a.rid = p.rid AND a.part = p.part) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY pos) AS v FROM s{k} GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {FACTOR})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= {ENTRIES}),
{', '.join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS}),
coded AS (SELECT rid, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), h"""
