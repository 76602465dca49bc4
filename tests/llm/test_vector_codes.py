"""Vector codes against plain rounds over all entries, and the tree against a full search."""

import hashlib
import math

import numpy as np

from citewell.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def test_tree_finds_the_nearest_and_the_lower_of_equal_entries():
    r = np.random.default_rng(3)
    for k, w, span in ((1, 1, 2), (16, 8, 3), (16, 2, 2), (33, 3, 50), (16, 8, 1)):
        points = r.integers(-span, span + 1, (k, w))
        q = r.integers(-span - 2, span + 3, (500, w))
        d = ((q[:, None] - points[None]) ** 2).sum(2)
        index, best = V.KdTree(points).nearest(q)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()  # argmin: the lowest index


def plain(rows, parts, entries, rounds):
    kept = sorted(((i, [math.floor(4096 * x) for x in v], label) for i, v, label, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    of = {}
    for _, label, c in coded:
        of[label] = of.get(label, 0) + sum(d for d, _ in c)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), of[label], digest) for i, label, c in coded)


def test_against_plain_rounds(spark):
    r = np.random.default_rng(1)
    rows = [(i, [round(float(x), 1) for x in r.normal(0, 1, 16)], int(i % 3) if i % 5 else None, "x") for i in range(120)]
    rows += [(3, rows[3][1], 0, "x"), (None, rows[5][1], None, None), (200, None, 1, None), (201, [], 1, None), (202, [None] * 16, 1, None), (203, [float("nan")] * 16, 1, None), (204, [1.0] * 15 + [float("inf")], 1, None)]
    got = V.encode(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain(rows, 8, 16, 6)


def test_few_equal_odd_and_no_vectors(spark):
    few = [(2, [0.5, -0.5] * 4, 1, None), (1, [0.5, -0.5] * 4, None, None), (3, [1.0] * 7, 1, None), (4, [1e30, -1e30] * 4, 1, None)]
    got = {r["vec_id"]: r for r in V.encode(spark.createDataFrame(few, SCHEMA)).collect()}
    assert set(got) == {1, 2, 4}  # the length 7 cannot be cut into 8 parts
    assert got[1]["code"] == got[2]["code"] == "00" * 8 and got[1]["error"] == 0
    assert V.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.encode(spark.createDataFrame([(1, None, 1, None)], SCHEMA)).collect() == []
