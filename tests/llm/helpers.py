"""Small tables with every awkward case, and plain versions of what operators compute."""

from __future__ import annotations

import re

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t: str | None) -> list[str]:
    return [w for w in SPACES.split(t or "") if w]


def shingles(t: str | None, n: int) -> set[tuple]:
    w = words(lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


#: The columns of documents, and extra ones whose names operators also use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, size int, _key string, word string"

BASE = "one two three four five six seven eight nine ten eleven twelve"


def awkward(spark):
    """Nulls in every column, empty and white texts, a very long text, ties, repeated rows, odd characters."""
    texts = [None, "", " \n\t ", "Word", BASE, BASE, BASE.upper(), BASE + " thirteen", "été à la plage 中文 \U0001f600", "x" * 5000, "long text " * 20000, "password = abcdefgh token: 123", "a\x00b \x1c \x85"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 3}", len(t or ""), 0.5, "x", 1, "k", "w") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id at all here", None, None, None, None, None, None, None, None), (99, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def components(rows: list[tuple[int, str]], n: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {i: root(i) for i in ids}
