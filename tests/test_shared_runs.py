"""Runs of words over all passages, against a plain comparison of every pair."""

import random

from citewell.operators.shared_runs import longest_runs, shared_runs

VERSE, PASSAGE = "verse_id long, text string", "passage_id long, text string"


def plain(v, p, least):
    """{(shift, start): run} of every longest common stretch."""
    a, b, out = v.split(), p.split(), {}
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least and not (i and j and a[i - 1] == b[j - 1]):
                out[j - i, i] = n
    return out


def test_runs_of_every_pair(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    verses = [(i, text(r.randint(0, 14))) for i in range(12)] + [(50, None), (51, "")]
    verses.append((52, verses[3][1]))  # a repeated verse
    passages = [(i, text(r.randint(0, 40))) for i in range(25)] + [(90, None)]
    got = {(x["verse_id"], x["passage_id"], x["shift"], x["start"]): x["run"] for x in shared_runs(spark.createDataFrame(verses, VERSE), spark.createDataFrame(passages, PASSAGE)).collect()}
    want = {(v, p, shift, start): n for v, a in verses for p, b in passages for (shift, start), n in plain(a or "", b or "", 4).items()}
    assert got == want and len(want) > 20


def test_longest_run_is_found_where_little_of_the_verse_is_covered(spark):
    long = " ".join(f"w{i}" for i in range(400))
    verses = [(1, long), (2, "nothing like it at all"), (3, "x y z"), (4, "أَحْمَدُ قَالَ لَهُ شيئا")]
    passages = [(1, "w7 w8 w9"), (2, "so w100 w101 w102 w103 w104 end"), (3, "w100 w101 w102 w103 w104 w9"), (4, "w1 w2 w3 w4"), (5, "احمد قال له شيئا هنا")]
    got = {r["verse_id"]: (r["passage_id"], r["run"]) for r in longest_runs(spark.createDataFrame(verses, VERSE), spark.createDataFrame(passages, PASSAGE)).collect()}
    assert got == {1: (2, 5), 2: (None, 0), 3: (None, 0), 4: (5, 4)}  # 5 of 400 words: 1.25 % of the verse


def test_empty_tables(spark):
    v, p = spark.createDataFrame([(1, "a b c d")], VERSE), spark.createDataFrame([], PASSAGE)
    assert [tuple(r) for r in longest_runs(v, p).collect()] == [(1, None, 0)]
    assert longest_runs(v.limit(0), p).collect() == []
