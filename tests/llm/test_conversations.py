"""Conversation repair against every edit script of small conversations, and a plain programme on long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from citewell.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, score double"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_script(rows):
    """(cost, audit, turns) of the cheapest script by trying all, at most one insertion at a place and two in all."""
    found, best = faults(rows), None
    places = [p for k in range(3) for p in itertools.combinations(range(len(rows) + 1), k)]
    for letters in itertools.product(*["D" if f in ("blank", "duplicate") else "DKR" for f in found]):
        for inserted in places:
            audit, slots, cost = "", [], 0
            for i in range(len(rows) + 1):
                if i in inserted:
                    audit, cost = audit + "I", cost + 5
                    slots.append((("user", "assistant"), ""))
                if i < len(rows):
                    x, (role, text) = letters[i], rows[i]
                    audit, cost = audit + x, cost + {"D": 2, "K": 0, "R": 1}[x] + (5 if x != "D" and found[i] == "truncated" else 0)
                    if x != "D":
                        slots.append(((role,) if x == "K" else ("user", "assistant"), text))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            for roles in itertools.product(*[s[0] for s in slots]):
                if GRAMMAR.match("".join(r[:1] or "?" for r in roles)):
                    best = (cost, audit, list(zip(roles, [s[1] for s in slots], strict=True)))
                    break
    return best


def plain(rows):
    """(cost, audit) turn by turn; one insertion before a turn at most."""
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    given = {0: 2, 1: 2, 3: 2, 2: 3}
    best = {0: (0, "")}
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        new = {}

        def put(state, cost, audit, new=new):
            new[state] = min(new.get(state, (1 << 60, "")), (cost, audit))

        for f, (cost, audit) in best.items():
            put(f, cost + 2, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault == "truncated" else 0
            for at, c, a in ((f, cost, audit), (given[f], cost + 5, audit + "I")):
                put(given[at], c + late + 1, a + "R")
                if (at, role[:1]) in legal:
                    put(legal[at, role[:1]], c + late, a + "K")
        best = new
    return min((c + {0: 0, 1: 10, 2: 5, 3: 0}[f], a + {0: "", 1: "II", 2: "I", 3: ""}[f]) for f, (c, a) in best.items())


def small(seed):
    r = random.Random(seed)
    return [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), r.choice(["a.", "b!", "cut", " ", "", "d?  ", "a."])) for _ in range(r.randint(0, 5))]


def test_against_every_script(spark):
    cases = {i: small(i) for i in range(60)}
    rows = [(i, t, role, text, 0.0) for i, case in cases.items() for t, (role, text) in enumerate(case)]
    got = {r["conv_id"]: r for r in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    turns = {}
    for r in sorted(C.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["conv_id"], r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for i, case in cases.items():
        if not case:
            assert i not in got
            continue
        cost, audit, fixed = every_script(case)
        found = faults(case)
        assert (got[i]["cost"], got[i]["audit"]) == (cost, audit), case
        assert turns.get(i, []) == fixed
        assert got[i]["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        assert [got[i][k] for k in ("blank", "duplicate", "truncated")] == [found.count(k) for k in ("blank", "duplicate", "truncated")]
        assert got[i]["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(case))


@pytest.mark.parametrize(("segment", "join"), [(6, 9), (1, 1)])
def test_a_conversation_of_most_rows_is_cut_into_segments(spark, monkeypatch, segment, join):
    monkeypatch.setattr(C, "SEGMENT_BITS", segment)
    monkeypatch.setattr(C, "JOIN_BITS", join)
    r = random.Random(5)
    n = 700 if segment == 1 else 3000
    hot = [(r.choice(["user", "assistant", "system"]), r.choice(["", f"t{r.randrange(200)}.", f"cut {r.randrange(9)}", f"own {i}!"])) for i in range(n)]
    rows = [(7, t, role, text, 0.0) for t, (role, text) in enumerate(hot)] + [(8, 0, "user", "x.", 0.0), (8, 1, "assistant", "y.", 0.0)]
    got = {x["conv_id"]: x for x in C.repair(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert (got[7]["cost"], got[7]["audit"]) == plain(hot)
    assert (got[8]["cost"], got[8]["audit"]) == (0, "KK")


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (None, 3, "user", "a.", None), (1, None, "user", "b.", 1.0), (1, None, "user", "b.", 1.0), (1, 2, "assistant", None, None), (1, 9, "assistant", "c.", None), (2, 5, "assistant", "", None)]
    got = {r["conv_id"]: r for r in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None]["audit"] == "DD" and got[None]["cost"] == 4 and got[None]["blank"] == 1 and got[None]["gaps"] == 0
    assert (got[1]["audit"], got[1]["duplicate"], got[1]["blank"], got[1]["gaps"]) == ("KDDK", 1, 1, 6)
    assert (got[2]["audit"], got[2]["repaired_sha256"]) == ("D", hashlib.sha256(b"").hexdigest())
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage_follows_the_rule_and_keeps_every_conversation(spark, tmp_path):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"text {t}.", 0.0) for i in range(60) for t in range(3)] + [(None, None, None, None, None)]
    given = spark.createDataFrame(rows, SCHEMA)
    hurt = {(r["conv_id"], r["turn"]): r for r in C.damaged(given).collect()}
    for i, t, role, text, _ in rows:
        d = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        r = hurt.get((i, t))
        assert (r is None) == (d == 0)
        if r:
            role, text = role or " ", text or " "
            want = {1: (role, "", 1), 2: (role, text.replace(".", ""), 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(d, (role, text, 1))
            assert (r["role"], r["text"], r["copies"]) == want
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op12(spark, str(tmp_path)).toPandas()
    assert len(got) == 61
