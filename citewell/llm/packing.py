"""Best-fit packing of tokenized documents by bin completion with branch and bound.

A sequence is decided by the lengths in it, and there are at most `max_tokens` lengths, so the search runs on
the histogram of lengths: its size does not depend on the number of documents. Best-fit decreasing gives the
incumbent. Bins are then completed around the largest remaining length: its undominated fillings are enumerated,
fullest first, each used as often as the histogram allows, and branches are pruned by a waste bound. All
pieces are decided by this search. Its first descent always reaches a whole packing; what is left of `steps` goes into
the branches from its end upwards. It ends where the bound is reached or the tree is exhausted (the optimum), or after
the steps with the best packing found, never a worse one than best-fit decreasing. Then every piece takes the place
that its rank among the pieces of its length stands for.

Scale: the text is read once. Pieces (a few numbers each, no text) are written to the shared folder; the
histogram has one row a length. Ranks within a length come from counts over hash slices plus a window inside
one slice of one length, so a length that a third of all documents have is spread over many windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from bisect import bisect_left, insort
from functools import partial
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import bounded_batches, keep, release, text_blocks
from citewell.llm.shingles import span_hashes

MAX_TOKENS = 2048
END_ID = 0
#: Steps that the search may take after its first descent (about two seconds); beyond them its best solution stands.
STEPS = 500_000
#: Dominated fillings that the first descent passes over before it takes the fullest one as it is.
PASSED = 64
#: Rows of one window, about.
ROWS_A_SLICE = 2_000
#: A worker remembers up to half of 2^CACHE_BITS units and CACHE_IDS of their ids, then starts anew.
CACHE_BITS, CACHE_IDS = 20, 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- tokens

#: What a byte is to the tokenizer's pattern: 0 white space, 1 ASCII letter, 2 digit (a token of its own), 3 other
#: printable ASCII (tokens are runs of these), 4 anything that needs the tokenizer's own view of the whole chunk.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3


class UnitEncoder:
    """Ids of whole texts, by way of their units: the tokenizer never joins across these.

    A chunk between white space is one unit if it holds an apostrophe, a control character or anything beyond
    ASCII, and is otherwise split where the tokenizer's pattern splits. Units are found, hashed (A-Z as a-z, as
    the tokenizer lowers them) and looked up with numpy; the tokenizer itself sees each unit once.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.start = np.zeros(1 << CACHE_BITS, np.int32)
        self.size = np.zeros(1 << CACHE_BITS, np.int32)
        self.pool = np.zeros(1 << 20, "<u4")
        self.used = self.held = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is, or the empty slot where it would be."""
        mask = np.uint64((1 << CACHE_BITS) - 1)
        slots = (hashes >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        found = self.keys[slots]
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & int(mask)
            found = self.keys[slots[open_]]
            open_ = open_[(found != hashes[open_]) & (found != 0)]
        return slots

    def _learn(self, hashes: np.ndarray, units: list[bytes], simple: np.ndarray) -> None:
        model, texts = self.tokenizer.model, [u.decode("utf-8", "replace") for u in units]
        whole = iter(self._ids([t for t, s in zip(texts, simple, strict=True) if not s]))
        found = [[t.id for t in model.tokenize(text.lower())] if plain else next(whole) for text, plain in zip(texts, simple.tolist(), strict=True)]
        sizes = np.array([len(x) for x in found], np.int64)
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += int(sizes.sum())
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), self.used - len(self.pool)), "<u4")])
        self.pool[self.used - int(sizes.sum()) : self.used] = np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))
        keys, mask, slots = self.keys, (1 << CACHE_BITS) - 1, []
        for h, slot in zip(hashes.tolist(), (hashes >> np.uint64(64 - CACHE_BITS)).tolist(), strict=True):
            while keys[slot]:  # the hash is new, so its place is the next one that is free
                slot = (slot + 1) & mask
            keys[slot] = h
            slots.append(slot)
        self.start[slots], self.size[slots] = starts, sizes
        self.held += len(slots)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        alone = {i: t for i, t in enumerate(texts) if "<|" in t and any(s in t for s in self.specials)}
        raw = [b"" if i in alone else t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts)]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        begins = np.r_[0, np.cumsum([len(r) + 1 for r in raw])]
        kind = _CLASS[data]
        inside = kind != 0
        before = np.r_[np.uint8(0), kind[:-1]]
        chunk = inside & (before == 0)
        first = np.flatnonzero(chunk)
        last = np.flatnonzero(inside & np.r_[kind[1:] == 0, True]) + 1
        start = inside & ((kind != before) | (kind == 2))
        odd = np.r_[0, np.cumsum(kind == 4)]
        odd = odd[last] > odd[first]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[first[odd]] = 1
        edge[last[odd]] = -1
        within = np.cumsum(edge[:-1], dtype=np.int8) > 0
        start &= ~within | chunk
        starts = np.flatnonzero(start)
        ends = np.flatnonzero(inside & np.r_[start[1:] | ~inside[1:], True]) + 1
        hashes = span_hashes(data, starts, ends)
        slots = self._slots(hashes)
        new = np.flatnonzero(self.keys[slots] == 0)
        if len(new):
            if self.held + len(new) > (1 << CACHE_BITS) // 2 or self.used > CACHE_IDS:
                self._clear()
                new = np.arange(len(hashes))
            fresh, at = np.unique(hashes[new], return_index=True)
            if len(fresh) > (1 << CACHE_BITS) // 2:  # one enormous text of new units
                return [np.array(x, "<u4") for x in self._ids(texts)]
            at = new[at]
            whole = data.tobytes()
            self._learn(fresh, [whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], ~within[starts[at]])
            slots = self._slots(hashes)
        sizes = self.size[slots].astype(np.int64)
        to = np.r_[0, np.cumsum(sizes)]
        ids = self.pool[np.repeat(self.start[slots] - to[:-1], sizes) + np.arange(to[-1])]
        cuts = to[np.searchsorted(starts, begins)]
        out = [ids[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i, t in alone.items():
            out[i] = np.array(self._ids([t])[0], "<u4")
        return out


_encoders: dict[str, UnitEncoder] = {}


def _encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def _cut(batches, path: str, max_tokens: int, end_id: int, with_ids: bool):
    import pyarrow as pa

    encoder, end = _encoder(path), np.array([end_id], "<u4")
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, part in text_blocks(texts):
            doc_id, piece, start, length, crc, own = [], [], [], [], [], []
            for d, tokens in zip(ids[lo : lo + len(part)], encoder.encode(part), strict=True):
                tokens = np.concatenate([tokens, end])
                for k, at in enumerate(range(0, len(tokens), max_tokens)):
                    x = tokens[at : at + max_tokens]
                    doc_id.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(x))
                    crc.append(zlib.crc32(x))
                    if with_ids:
                        own.append(x.astype("<i4"))
            columns = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
    release()


def tokenized_pieces(docs: DataFrame, doc_id="doc_id", text="text", tokenizer=None, max_tokens=MAX_TOKENS, end_id=END_ID, with_ids=False) -> DataFrame:
    """One row a piece: a document's ids and the end id, cut after every max_tokens ids. Null text is empty."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    run = partial(_cut, path=tokenizer or default_tokenizer(), max_tokens=max_tokens, end_id=end_id, with_ids=with_ids)
    return source.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- search

Pattern = tuple[tuple[int, int], ...]  # (length, how often), largest length first


def _pattern(lengths) -> Pattern:
    out: dict[int, int] = {}
    for x in sorted(lengths, reverse=True):
        out[x] = out.get(x, 0) + 1
    return tuple(out.items())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on the histogram: bins with the same contents are handled together."""
    rooms: dict[int, dict[Pattern, int]] = {}
    order: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            insort(order, room)
        rooms[room][pattern] = rooms[room].get(pattern, 0) + times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, ((length, each),), full)
                    left -= full * each
                if left:
                    put(capacity - left * length, ((length, left),), 1)
                    left = 0
                break
            room = order[at]
            pattern, times = next(iter(rooms[room].items()))
            each = min(room // length, left)
            used = min(times, max(1, left // each))
            rooms[room][pattern] -= used
            if not rooms[room][pattern]:
                del rooms[room][pattern]
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            put(room - each * length, (*pattern, (length, each)), used)
            left -= used * each
    return [(p, t) for same in rooms.values() for p, t in same.items()]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the bins: by volume and waste, and by how many pieces of some length or more a bin holds.

    Waste is the room beside a piece of more than half the capacity that no small piece can fill.
    """
    order = sorted(counts, reverse=True)
    total, waste, carried, small = sum(x * n for x, n in counts.items()), 0, 0, len(order) - 1
    for large in order:
        if 2 * large <= capacity:
            break
        room = capacity - large
        while small >= 0 and order[small] <= room:
            carried += order[small] * counts[order[small]]
            small -= 1
        used = min(carried, room * counts[large])
        waste += room * counts[large] - used
        carried -= used
    most, pieces = -(-(total + waste) // capacity), 0
    for x in order:
        pieces += counts[x]
        most = max(most, -(-pieces // (capacity // x)))
    return most


class Budget:
    """Steps that the search may still take; every sum, piece and test of the enumeration is one."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int) -> bool:
        self.left -= steps
        return self.left > 0


def dominated(filling: tuple[int, ...], counts: dict[int, int], room: int) -> bool:
    """Whether one more piece could stand for some pieces of the filling, or for none, and waste no more.

    That is: an unused piece x and a part of the filling with the sum s, where s <= x <= s + (room left). A filling
    that another one dominates by putting several pieces into one of its own has such an x (the largest piece of the
    other that does not stand for itself), so this is the whole test. A piece does not stand for its equal.
    """
    slack = room - sum(filling)
    single, several = 0, 1  # bits: sums of one piece, and of none or of two and more
    for y in filling:
        several |= (several & ~1) << y | single << y
        single |= 1 << y
    free = 0
    for x, n in counts.items():
        if x <= room and n > filling.count(x):
            free |= 1 << x
    return bool(_smeared(several, slack) & free or slack and _smeared(single << 1, slack - 1) & free)


def _smeared(bits: int, by: int) -> int:
    """Every bit also at the `by` places above it."""
    done = 0
    while done < by:
        more = min(done + 1, by - done)
        bits |= bits << more
        done += more
    return bits


def fillings(counts: dict[int, int], room: int, budget: Budget, after: tuple[int, ...] | None = None, every: bool = False) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of a room, the fullest first, those of few large pieces first; lazily.

    For each piece, largest first, the sums that it and all smaller ones reach are bits of a number. So every branch
    of the enumeration ends in a filling, and the work between two fillings is bounded by the number of lengths. It
    ends early only where the budget ends. after: only what comes after this filling in that order; every: dominated
    fillings too. counts must not change while the enumeration goes on.
    """
    if counts.get(room) and not every:
        if after is None:
            yield (room,)  # the only undominated filling: it can stand for any other
        return
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    if not lengths:
        if after is None:
            yield ()
        return
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in reversed(lengths):
        sums, left, step = reach[-1], min(counts[x], room // x), 1
        while left:
            step = min(step, left)
            sums |= (sums << (step * x)) & mask
            left -= step
            step *= 2
        reach.append(sums)
    reach.reverse()  # reach[i]: sums of lengths[i:]
    if not budget.spend(2 * len(lengths)):
        return
    last = None if after is None else sum(after)
    sums = reach[0] if last is None else reach[0] & ((1 << (last + 1)) - 1)
    while sums > 1:
        target = sums.bit_length() - 1
        sums ^= 1 << target
        for found in _exactly(target, lengths, counts, reach, budget):
            if not budget.spend(4 + len(found)):
                return
            if target == last and found >= after:
                continue
            if every or not dominated(found, counts, room):
                yield found


def _exactly(target: int, lengths: list[int], counts: dict[int, int], reach: list[int], budget: Budget) -> Iterator[tuple[int, ...]]:
    """Fillings with this sum, lexicographically largest first."""
    stack = [(0, target, ())]
    while stack:
        i, left, chosen = stack.pop()
        while left and budget.left > 0:
            budget.left -= 1
            x = lengths[i]
            most = min(counts[x], left // x)
            tails = [k for k in range(most + 1) if reach[i + 1] >> (left - k * x) & 1]
            budget.left -= most
            for k in tails[:-1]:
                stack.append((i + 1, left - k * x, (*chosen, *[x] * k)))
            k = tails[-1]
            i, left, chosen = i + 1, left - k * x, (*chosen, *[x] * k)
        if left:
            return
        yield chosen


def descend(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """One whole packing: the bin of the largest piece gets the fullest undominated filling, as often as there is enough.

    Where the PASSED fullest fillings are all dominated, the fullest one is taken, so the work at a bin is bounded.
    """
    rest, out = dict(counts), []
    while rest:
        largest = max(rest)
        _put(rest, ((largest, 1),), -1)
        room, free = capacity - largest, Budget(1 << 62)
        found = next((f for f in islice(fillings(rest, room, free, every=True), PASSED) if not dominated(f, rest, room)), None)
        if found is None:
            found = next(fillings(rest, room, free, every=True))
        _put(rest, ((largest, 1),), 1)
        pattern = _pattern((largest, *found))
        times = min(rest[x] // k for x, k in pattern)
        _put(rest, pattern, -times)
        out.append((pattern, times))
    return out


def _put(rest: dict[int, int], pattern: Pattern, times: int) -> None:
    for x, k in pattern:
        rest[x] = rest.get(x, 0) + k * times
        if not rest[x]:
            del rest[x]


def complete(counts: dict[int, int], capacity: int, incumbent: list[tuple[Pattern, int]], steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Bin completion by branch and bound over the whole histogram, from the incumbent on.

    The bin of the largest piece is filled in every undominated way, best first. A filling is used as often as the
    histogram allows at once, and taken back one bin at a time, so the tree is the one of single bins. A branch is
    left where the bins used and the bound of the rest reach the best solution. The search ends with the
    optimum if it reaches the bound of the whole or has no branch left, else after `steps`, with the best found.
    The steps count from the end of the first descent on, which is the packing that descend() gives.
    """
    best, fewest, floor = incumbent, sum(t for _, t in incumbent), least_bins(counts, capacity)
    if fewest <= floor:
        return best
    first = descend(counts, capacity)
    if (n := sum(t for _, t in first)) < fewest:
        best, fewest = first, n
    budget = Budget(steps)
    rest: dict[int, int] = {}
    # a bin: its pattern, how often it stands, its volume, and the enumeration that goes on when all of them are taken back
    frames: list[list] = [[p, t, sum(x * k for x, k in p), None] for p, t in first]
    used, volume, visits = sum(t for _, t in first), 0, 0
    going: Iterator[tuple[int, ...]] | None = iter(())  # the first descent is done: go back at once

    while fewest > floor and budget.left > 0:
        # at a node: fillings of the next bin, from `going` on (None: all of them)
        visits += 1
        open_ = used + -(-volume // capacity) < fewest
        if open_ and rest and (going is not None or visits % 16 == 0 or len(rest) <= 64):
            budget.spend(len(rest))
            open_ = used + least_bins(rest, capacity) < fewest
        if not rest:
            if used < fewest:
                best, fewest = [(f[0], f[1]) for f in frames], used
            open_ = False
        found = None
        if open_:
            largest = max(rest)
            if going is None:
                going = _fillings_around(largest, rest, capacity, budget)
            found = next(going, None)
        if found is not None:
            pattern = _pattern((largest, *found))
            times = min(rest[x] // k for x, k in pattern)
            each = sum(x * k for x, k in pattern)
            _put(rest, pattern, -times)
            frames.append([pattern, times, each, going])
            used, volume, going = used + times, volume - times * each, None
            continue
        if not frames:
            break
        last = frames[-1]  # take one bin back and go on with its next filling
        _put(rest, last[0], 1)
        used, volume = used - 1, volume + last[2]
        last[1] -= 1
        going = last[3] if not last[1] else None
        if going is None:  # other counts than when it was first filled
            largest = last[0][0][0]
            tail = [x for x, k in last[0] for _ in range(k)][1:]
            going = _fillings_around(largest, rest, capacity, budget, tuple(tail))
        if not last[1]:
            frames.pop()
    return best


def _fillings_around(largest: int, rest: dict[int, int], capacity: int, budget: Budget, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...]]:
    counts = dict(rest)
    _put(counts, ((largest, 1),), -1)
    return fillings(counts, capacity - largest, budget, after)


def solve(counts: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold every piece of the histogram exactly once."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    return complete(counts, capacity, best_fit(counts, capacity), steps)


# ---------------------------------------------------------------- places


def _places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: where they begin, the first sequence, pieces a sequence, first offset."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            lo = used.get(length, 0)
            rows.append((length, lo, sequence, each, offset))
            used[length] = lo + each * times
            offset += each * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "sequence", "each", "offset"), table.T.copy(), strict=True))


def _place(batches, places: dict[str, np.ndarray]):
    import pyarrow as pa

    first = {int(x): int(i) for x, i in zip(*np.unique(places["length"], return_index=True), strict=True)}
    last = {int(x): int(i) for x, i in zip(*np.unique(places["length"][::-1], return_index=True), strict=True)}
    n = len(places["length"])
    for batch in batches:  # other columns pass through as they are: no id becomes a float
        lengths, ranks = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
        at = np.zeros(batch.num_rows, np.int64)
        for x in np.unique(lengths):
            own = lengths == x
            lo, hi = first[int(x)], n - last[int(x)]
            at[own] = lo + np.searchsorted(places["lo"][lo:hi], ranks[own], "right") - 1
        within = ranks - places["lo"][at]
        sequence = places["sequence"][at] + within // places["each"][at]
        offset = places["offset"][at] + within % places["each"][at] * lengths
        kept = [k for k, c in enumerate(batch.schema.names) if c != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[k] for k in kept), "sequence_id", "offset"])


def pack(docs: DataFrame, doc_id="doc_id", text="text", tokenizer=None, max_tokens=MAX_TOKENS, end_id=END_ID, with_ids=False, steps=STEPS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    steps: how long the search goes on after its first descent.

    Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they occur.
    A null doc_id stays null. An empty table gives no rows. Other columns are not read.
    """
    pieces = keep(tokenized_pieces(docs, doc_id, text, tokenizer, max_tokens, end_id, with_ids), "pack-pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most max_tokens rows
    places = _places(solve({r[0]: r[1] for r in histogram}, max_tokens, steps))
    slices = max(1, -(-sum(r[1] for r in histogram) // ROWS_A_SLICE))
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    sums = dealt.groupBy("length", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("here", F.row_number().over(here) - 1).join(sums, ["length", "slice"])
    columns = [c for c in pieces.columns if c != "length"]
    ranked = ranked.select(*columns, "length", (F.col("earlier") + F.col("here")).cast("long").alias("rank"))
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*columns, "length"]) + ", sequence_id long, offset long"
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return ranked.mapInArrow(partial(_place, places=places), schema.replace("bigint", "long")).select(*order)


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
