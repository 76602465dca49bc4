"""Near-duplicate documents by MinHash bands, odd sketches and exact sets of word shingles.

1. Every text becomes its set of word shingles, MinHash samples of the set, keys of bands of samples, and an odd
   sketch: a bitmap of parities into which all samples are folded. Texts with equal sets form one class.
2. Classes that share a band key are candidates. They are never paired up: each bucket names its smallest member its
   leader, and every class is verified against the smallest leader of its buckets. These links form a forest, whose
   trees are groups; a page and its thousands of near copies are one group then.
3. Only classes whose buckets hold several groups are left. Each goes into a block of its group's home (a large
   bucket nearby), or of its group if that is large, and two blocks meet if they share such a bucket.
For every pair of a task the population count of the XOR of two odd sketches estimates the similarity; pairs that
may reach the threshold are confirmed on the full sets unless confirmed links connect them already. What leaves a
task is a forest of confirmed links; those of step 3 link groups, so only groups are contracted further.
A pair at exactly the threshold 0.8 shares no bucket with probability (1 - 0.8^6)^40 = 5e-6. A pair at the
threshold differs in about 80 of the 512 bits of its sketches (standard deviation 11); only pairs with more than
SKETCH_DISTANCE = 150 are left out. Both figures are for a single link; groups usually have several.

Scale: texts are read twice (the second time only for documents that share a bucket). Copies collapse by partial
aggregation. Links of the first kind are at most one a class, and their roots are found by doubling the paths of inner
nodes alone. Links between groups are contracted by alternating large-star and small-star steps on tables in the
shared folder, with nodes of very many neighbours joined apart from the others; and a block task holds at most two
blocks. Texts are hashed in runs of bounded length.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import bounded_batches, keep, release, text_blocks
from citewell.llm.shingles import mix64, shingle_sets

#: The contract of the query: shingles of four words, linked at 80 % of the union.
WORDS, PERCENT = 4, 80
BANDS, ROWS, SKETCH_BITS = 40, 6, 512
SKETCH_DISTANCE = 150
#: Classes of a block, about; and document ids that may be broadcast.
BLOCK = 192
BROADCAST_IDS = 500_000
_NO_ID = -(2**63)
#: A node with more neighbours is joined by a table of such nodes that every task gets, if they are at most the second number.
HUB, HUBS = 4096, 100_000
#: Texts that are hashed at once, at most.
_TEXTS = 64

SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch binary"


class Sampler:
    def __init__(self, bands=BANDS, rows=ROWS, bits=SKETCH_BITS, seed=5):
        draw = np.random.RandomState(seed)
        self.bands, self.rows, self.bits, n = bands, rows, bits, bands * rows
        self.shift = draw.randint(0, 2**32, (n, 1), dtype=np.uint32)
        self.times = draw.randint(0, 2**32, (n, 1), dtype=np.uint32) | np.uint32(1)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty(len(self.shift), np.uint32)
        step = max(1, (1 << 16) // len(x))
        for lo in range(0, len(out), step):
            out[lo : lo + step] = ((x ^ self.shift[lo : lo + step]) * self.times[lo : lo + step]).min(axis=1)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """Band keys (one row a text); the band's number goes into its key."""
        table = samples.reshape(len(samples), self.bands, self.rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), table.shape[:2])
        for r in range(self.rows):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + table[:, :, r])
        return out

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """Odd sketches (one row of bytes a text): bit j is the parity of the samples that hash to j."""
        order = np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32)
        place = (mix64(samples.astype(np.uint64) | order) % np.uint64(self.bits)).astype(np.int64)
        n = len(samples)
        counts = np.bincount((place + np.arange(n)[:, None] * self.bits).ravel(), minlength=n * self.bits)
        return np.packbits((counts & 1).astype(bool).reshape(n, self.bits), axis=1)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        one = int(mix64(hashes).sum(dtype=np.uint64))
        two = int(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


def _sign(batches, words: int, sampler: Sampler):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        for at, texts in text_blocks(batch.column(1), most=_TEXTS):
            sets = shingle_sets(texts, words)
            full = [i for i, s in enumerate(sets) if len(s)]
            samples = np.array([sampler.samples(sets[i]) for i in full], np.uint32).reshape(len(full), -1)
            keys, sketches = [None] * len(sets), [None] * len(sets)
            if full:
                for i, k, s in zip(full, sampler.keys(samples).view(np.int64), sampler.sketches(samples), strict=True):
                    keys[i], sketches[i] = k, s.tobytes()
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(texts)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"],
            )
    release()


def signatures(docs: DataFrame, doc_id="doc_id", text="text", words=WORDS, sampler: Sampler | None = None) -> DataFrame:
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(partial(_sign, words=words, sampler=sampler or Sampler()), SIGNATURES)


def _sets(batches, words: int):
    import pyarrow as pa

    for batch in batches:
        for _, texts in text_blocks(batch.column(0), most=_TEXTS):
            sets = shingle_sets(texts, words)
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["d1", "d2", "hashes"],
            )
    release()


def components(ties: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ties (a, b): alternating star contractions."""
    edges = keep(ties.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    while True:
        ends = edges.select(F.col("u").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("n")))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("n").alias("n"))
        unsettled, few = ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > 0))), F.count_if(F.col("n") > HUB)).first()
        if not unsettled:  # stars, each around its smallest node
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        if 0 < few <= HUBS:  # all neighbours of a hub would meet in one task
            hubs = F.broadcast(least.join(ends.where(F.col("n") > HUB).select("u"), "u", "left_semi"))
            joined = upward.join(hubs, "u").unionByName(upward.join(hubs, "u", "left_anti").join(least, "u"))
        else:
            joined = upward.join(least, "u")
        large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = keep(small, f"{name}-edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def tree_roots(forest: DataFrame, name: str) -> DataFrame:
    """node, root for every node of a forest: a is the parent of b, smaller than b, and the only one.

    Paths of inner nodes (parents that have a parent) double until they end at roots; all others then need one step.
    """
    ends = forest.select(F.col("b").alias("node"), F.col("a").alias("up"), F.lit(False).alias("inner")).unionByName(forest.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("inner")))
    inner = keep(ends.groupBy("node").agg(F.max("up").alias("up"), F.max("inner").alias("inner")).where("inner and up is not null").select("node", "up"), f"{name}-inner")
    few = inner.count() <= HUBS
    step = lambda: (F.broadcast if few else lambda x: x)(inner.select(F.col("node").alias("up"), F.col("up").alias("next")))
    while inner.join(step(), "up", "left_semi").limit(1).count():
        inner = keep(inner.join(step(), "up", "left").select("node", F.coalesce("next", "up").alias("up")), f"{name}-inner")
    roots = forest.select(F.col("b").alias("node"), F.col("a").alias("up")).join(step(), "up", "left").select("node", F.coalesce("next", "up").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


# ---------------------------------------------------------------- blocks


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets: products of 0/1 matrices over the shared hashes."""
    flat = np.concatenate([*a, *b])
    universe, column = np.unique(flat, return_inverse=True)
    often = np.bincount(column) > 1
    renumber = np.cumsum(often) - 1
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    live = often[column]
    rows, column = rows[live], renumber[column[live]]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        own = (column >= lo) & (column < lo + 4096)
        table = np.zeros((len(a) + len(b), 4096), np.float32)
        table[rows[own], column[own] - lo] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out.astype(np.int64)


def confirmed_forest(groups_a, sketch_a, sets_a, groups_b, sketch_b, sets_b, percent=PERCENT, distance=SKETCH_DISTANCE) -> list[tuple[int, int]]:
    """Links between groups of rows of a and of b (the same lists: within one block) that span all confirmed ones."""
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (sets_a, sets_b))
    xor = np.zeros((len(groups_a), len(groups_b)), np.int32)
    wa, wb = (np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) for x in (sketch_a, sketch_b))
    for j in range(wa.shape[1]):
        xor += np.bitwise_count(wa[:, j][:, None] ^ wb[:, j][None, :])
    small, big = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    maybe = (xor <= distance) & (100 * small >= percent * big)
    if groups_a is groups_b:
        maybe &= np.tri(len(groups_a), k=-1, dtype=bool).T
    maybe &= np.array(groups_a)[:, None] != np.array(groups_b)[None, :]
    i, j = np.nonzero(maybe)
    if not len(i):
        return []
    order = np.argsort(xor[i, j], kind="stable")
    i, j = i[order], j[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    shared = intersections(sets_a, sets_b) if len(i) > 4 * (len(groups_a) + len(groups_b)) else None
    if shared is not None:
        common = shared[i, j]
        good = 100 * common >= percent * (size_a[i] + size_b[j] - common)
        i, j = i[good], j[good]
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(groups_a[x]), root(groups_b[y])
        if p == q:
            continue
        if shared is None:
            common = len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True))
            if 100 * common < percent * (len(sets_a[x]) + len(sets_b[y]) - common):
                continue
        parent[p] = q
        out.append((groups_a[x], groups_b[y]))
    return out


def _link(batches, percent: int, distance: int):
    """Rows come sorted by task and side; one task's rows are held at a time."""
    import pyarrow as pa

    task, held = None, ([], [])

    def close():
        a, b = held
        if not a:
            return []
        columns = [tuple(map(list, zip(*x, strict=True))) for x in (a, b) if x]
        return confirmed_forest(*columns[0], *columns[-1], percent, distance)

    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for batch in batches:
        links = []
        columns = [batch.column(k) for k in range(batch.num_columns)]
        for at in range(batch.num_rows):
            i, j, side, group, sketch, hashes = (c[at].as_py() for c in columns)
            if task != (i, j):
                links += close()
                task, held = (i, j), ([], [])
            held[side].append((group, sketch, np.frombuffer(hashes, np.uint64)))
        yield batch_of(links)
    yield batch_of(close())
    release()


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", words=WORDS, percent=PERCENT, sampler: Sampler | None = None, distance=SKETCH_DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles, are linked with nothing and are kept. Repeated rows have one
    component; each of them with the component's id is kept. A null doc_id takes part, is never a component's
    id while another id is in it, and is kept only where its component has no other. An empty table gives no rows.
    """
    sampler = sampler or Sampler()
    bounded_batches(docs.sparkSession)
    signed = keep(signatures(docs, doc_id, text, words, sampler), "dedup-signed")
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")
    banded = classes.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = keep(banded.join(buckets, "key"), "dedup-members")
    roots = _roots(docs, doc_id, text, classes, members, words, percent, distance)

    own = classes.select("d1", "d2", "doc", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = own.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = own.join(ids, "root").select("d1", "d2", "component_id")
    lone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"])
    rows = rows.select("doc_id", "n_shingles", "component_id").unionByName(lone)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _roots(docs, doc_id, text, classes, members, words, percent, distance) -> DataFrame:
    """node, root: the components of all confirmed links."""
    needed = members.groupBy("node").agg(F.min("leader").alias("leader")).join(classes.select("node", "d1", "d2", "doc", "sketch"), "node")
    needed = keep(needed, "dedup-placed")
    # sets of the classes in buckets, from one document of each
    wanted = needed.select(F.coalesce("doc", F.lit(_NO_ID)).alias("id"))
    if needed.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    sets = source.join(wanted, "id", "left_semi").select("text").mapInArrow(partial(_sets, words=words), "d1 long, d2 long, hashes binary")
    sets = keep(sets.groupBy("d1", "d2").agg(F.first("hashes").alias("hashes")).join(needed, ["d1", "d2"]).select("node", "sketch", "hashes"), "dedup-sets")

    def linked(tasks: DataFrame) -> DataFrame:
        """tasks: i, j (a task), side, node, group. Sets join last, so that they move for their tasks only."""
        tasks = tasks.join(sets, "node").select("i", "j", "side", "group", "sketch", "hashes")
        tasks = tasks.repartition("i", "j").sortWithinPartitions("i", "j", "side")
        return tasks.mapInArrow(partial(_link, percent=percent, distance=distance), "a long, b long")

    def parts(counts: DataFrame, *keys: str) -> DataFrame:
        """Numbers of parts where they are several: at most one row for BLOCK classes, so every task gets them."""
        return F.broadcast(counts.where(F.col("n") > BLOCK).select(*keys, F.ceil(F.col("n") / BLOCK).alias("parts")))

    # every class against one leader: leader l meets its followers in tasks (l, part of the followers)
    led = needed.where("leader < node").select("node", "leader")
    leaders = led.groupBy("leader").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long")))
    followers = led.join(parts(leaders, "leader"), "leader", "left").select(F.col("leader").alias("i"), part.alias("j"), F.lit(1).alias("side"), "node", F.col("node").alias("group"))
    leaders = leaders.select(F.col("leader").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)).alias("j"), F.lit(0).alias("side"), F.col("leader").alias("node"), F.col("leader").alias("group"))
    first = keep(linked(leaders.unionByName(followers)), "dedup-first")
    # what is confirmed so far is a group; only buckets that hold several groups are left
    groups = keep(tree_roots(first, "dedup-groups"), "dedup-groups")
    grouped = keep(members.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("group")), "dedup-grouped")
    mixed = grouped.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "n")
    left = keep(grouped.join(mixed, "key"), "dedup-left")
    # a group's home: the largest bucket that its own buckets' groups are in, so that few blocks meet
    by_group = left.select("key", "group", F.struct("n", "key").alias("home")).distinct()
    near = by_group.groupBy("group").agg(F.max("home").alias("home"))
    near = by_group.select("key", "group").join(near, "group").groupBy("key").agg(F.max("home").alias("home"))
    homes = by_group.select("key", "group").join(near, "key").groupBy("group").agg(F.max("home").alias("home"))
    about = left.select("node", "group").distinct().join(homes, "group").select("node", "group", F.col("home.key").alias("home"))
    about = keep(about, "dedup-homes")
    # a block has classes of one group, if there are enough of them, or of one home
    alone = parts(about.groupBy("group").agg(F.count("*").alias("n")), "group")
    placed = about.join(alone, "group", "left").select("node", "group", F.when(F.col("parts").isNotNull(), F.col("group")).alias("alone"), "home")
    placed = placed.withColumn("home", F.xxhash64(F.coalesce("alone", "home"), F.col("alone").isNotNull()))
    placed = placed.join(parts(placed.groupBy("home").agg(F.count("*").alias("n")), "home"), "home", "left")
    placed = placed.select("node", "group", F.xxhash64("home", F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("parts", F.lit(1).cast("long")))).alias("block"), "alone")
    placed = keep(placed, "dedup-blocks")
    many = left.select("key", "node").join(placed, "node").select("key", "block", "alone").distinct()
    other = many.select("key", F.col("block").alias("other"), F.col("alone").alias("other_alone"))
    pairs = many.join(other, "key").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("alone") == F.col("other_alone"), F.lit(False)))
    pairs = keep(pairs.select(F.col("block").alias("i"), F.col("other").alias("j")).distinct(), "dedup-pairs")
    one = placed.join(pairs.withColumn("block", F.col("i")), "block").withColumn("side", F.lit(0))
    two = placed.join(pairs.where("i < j").withColumn("block", F.col("j")), "block").withColumn("side", F.lit(1))
    joined = components(linked(one.unionByName(two).select("i", "j", "side", "node", "group")), "dedup-links")
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = joined.join(groups.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return groups.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone)


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text", **parameters) -> DataFrame:
    """The documents that stay: of each component, the rows with its id; keeps the columns of docs.

    The ids that go are broadcast if they number at most BROADCAST_IDS, so texts are not shuffled for them; beyond
    that the anti-join shuffles. An id that stands for several texts stays if one of them does.
    """
    rows = near_duplicates(docs, doc_id, text, **parameters).groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_gone"))
    gone = keep(rows.agg(F.max(F.col("kept").cast("int")).alias("stays")).where("stays = 0").select("_gone"), "dedup-gone")
    few = gone.count() <= BROADCAST_IDS
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)).alias("own"))
    return held.join(F.broadcast(gone) if few else gone, F.col("own") == F.col("_gone"), "left_anti").select("doc.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
