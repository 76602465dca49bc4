"""The search of op10 on thousands of middle-sized pieces, and where it beats best fit through pack()."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citewell.llm import packing as P


def total(packing):
    return sum(times for _, times in packing)


@pytest.mark.parametrize(("low", "high"), [(300, 900), (200, 700)])
def test_middle_sized_pieces_come_within_a_hundredth_of_the_bound(low, high):
    r = random.Random(1)
    counts = Counter(r.randint(low, high) for _ in range(20_000))
    began = time.perf_counter()
    found = P.solve(counts, 2048)
    assert time.perf_counter() - began < 20  # about 2 s alone on a core
    used = Counter()
    for pattern, times in found:
        assert sum(x * k for x, k in pattern) <= 2048
        used.update({x: k * times for x, k in pattern})
    assert used == counts
    assert total(found) <= 1.01 * P.least_bins(counts, 2048) < total(P.best_fit(counts, 2048))


def test_enumeration_goes_on_after_any_filling():
    r = random.Random(2)
    for _ in range(60):
        counts = Counter(r.randint(1, 12) for _ in range(r.randint(1, 9)))
        room = r.randint(1, 25)
        whole = list(P.fillings(counts, room, P.Budget(1 << 40)))
        for i, f in enumerate(whole):
            assert list(P.fillings(counts, room, P.Budget(1 << 40), after=f)) == whole[i + 1 :]


def test_more_steps_never_give_more_bins():
    r = random.Random(3)
    for _ in range(10):
        counts = Counter(r.randint(8, 40) for _ in range(60))
        found = [total(P.solve(counts, 100, steps)) for steps in (0, 1000, 100_000)]
        assert found == sorted(found, reverse=True) and found[0] <= total(P.best_fit(counts, 100))


def test_pack_uses_the_search(spark):
    r = random.Random(4)
    while True:
        counts = Counter(r.randint(5, 20) for _ in range(40))
        if total(P.solve(counts, 48)) < total(P.best_fit(counts, 48)):
            break
    lengths = list(counts.elements())
    docs = spark.createDataFrame([(i, " ".join(["7"] * (n - 1))) for i, n in enumerate(lengths)], "doc_id long, text string")
    out = P.pack(docs, max_tokens=48).agg(F.count_distinct("sequence_id"), F.count("*"), F.sum("length")).first()
    assert tuple(out) == (total(P.solve(counts, 48)), len(lengths), sum(lengths))
