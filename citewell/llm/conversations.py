"""Conversation repair: the cheapest edits that give every conversation the order of roles `(s?(ua)+)?`.

Turns are range-sorted by conversation and turn and numbered over the table, so that SEGMENT consecutive turns of one
conversation are a segment, however long the conversation is. Segments are dealt by hash; a task gathers whole
segments into batches of about BATCH rows and gives each batch to one recursive DuckDB query, which advances all
segments of the batch by one turn at a time and keeps, for each state that a segment may start in and each state of
the grammar, the least (cost, audit). Segments are then turns of larger segments, which the same query joins, until
each conversation is one. The last pass streams the turns of a conversation past its audit into one digest.

States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's; 0 and 3 may end.
At most two insertions precede a turn: two give back a state that was there before, at a higher cost.

Scale: the dynamic programme sees roles, flags and hashes, never texts. Texts are shuffled once, by conversation. A
conversation's digest is one hash of all its repaired turns and its audit one string: by definition one task's work,
but its turns stream through and none is held. A conversation of a third of all rows is otherwise cut into segments.

Defined results: null role and text count as one space, a null turn sorts first, a null conversation is a
conversation. Turns that tie are ordered by role and hash of the text; equal turns at one place are duplicates of the
first. An initial other than s, u and a can only be given a new role or be deleted. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import WORD, bounded_batches, keep, scratch, table
from citewell.operators.numbering import numbered

#: Costs of deleting, giving a role, inserting, and of a truncated turn that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Turns of a segment, segments that a later step joins (both powers of two, as bits), and rows of a DuckDB batch.
SEGMENT_BITS, JOIN_BITS, BATCH = 6, 9, 20_000
LEGAL = ("su", "ua", "au")
ENDS_WELL = ".!?"

_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, role string, text string, edit string"
_SPACE = WORD.replace("[^", "[")
_AFTER_INSERT = {0: 2, 1: 2, 2: 3, 3: 2}


def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, from state, to state, cost, letters) of one turn. Kind: d must go; or the initial, and 5 if truncated."""
    out = []
    for f in range(4):
        out.append(("d", f, f, DELETE, "D"))
        for initial in "suao":
            for truncated in (0, 1):
                kind, late = initial + "5" * truncated, TRUNCATED * truncated
                out.append((kind, f, f, DELETE, "D"))
                at, cost, letters = f, 0, ""
                for _ in range(3):
                    to = {"s": 1 if at == 0 else None, "u": 2 if at != 2 else None, "a": 3 if at == 2 else None, "o": None}[initial]
                    if to is not None:
                        out.append((kind, f, to, cost + late, letters + "K"))
                    out.append((kind, f, _AFTER_INSERT[at], cost + late + REROLE, letters + "R"))
                    at, cost, letters = _AFTER_INSERT[at], cost + INSERT, letters + "I"
    return out


_PATHS = """
WITH RECURSIVE best(seg, first, state, i, cost, audit) USING KEY (seg, first, state) AS (
  SELECT seg, s, s, 0, 0::BIGINT, '' FROM (SELECT DISTINCT seg FROM steps), (VALUES (0), (1), (2), (3)) v(s)
  UNION
  SELECT b.seg, b.first, t.to_state, b.i + 1, min(b.cost + t.cost), arg_min(b.audit || t.letters, {'c': b.cost + t.cost, 'a': b.audit || t.letters})
  FROM best b JOIN steps t ON t.seg = b.seg AND t.i = b.i + 1 AND t.from_state = b.state GROUP BY 1, 2, 3, 4)
SELECT seg, first, state, cost, audit FROM best JOIN (SELECT seg, max(i) AS i FROM steps GROUP BY seg) USING (seg, i)"""
_FROM_TURNS = "CREATE TEMP TABLE steps AS SELECT t.seg, t.i, m.from_state, m.to_state, m.cost + t.more * {delete} AS cost, m.letters || repeat('D', t.more) AS letters FROM turns t JOIN moves m USING (kind)"
_FROM_PARTS = "CREATE TEMP TABLE steps AS SELECT seg, dense_rank() OVER (PARTITION BY seg ORDER BY part) AS i, from_state, to_state, cost, audit AS letters FROM turns"


def _recursion(batches, turns: bool) -> Iterator:
    """Rows (conv_id, part, next, ...) sorted by (conv_id, next, part): the least (cost, audit) of each (conv_id, next)."""
    import duckdb
    import pyarrow as pa
    import pyarrow.compute as pc

    def solve(held: list[pa.RecordBatch]):
        data = pa.Table.from_batches(held).combine_chunks()
        conv, following = data.column("conv_id"), data.column("next")
        new = [True, *((a != b) for a, b in zip(zip(conv.to_pylist()[1:], following.to_pylist()[1:], strict=True), zip(conv.to_pylist(), following.to_pylist(), strict=False), strict=False))]
        starts = [i for i, x in enumerate(new) if x]
        seg = pc.subtract(pc.cumulative_sum(pa.array(new).cast(pa.int64())), 1)
        with duckdb.connect(config={"threads": 1, "memory_limit": "600MB"}) as con:
            con.execute("SET enable_progress_bar = false")
            if turns:
                given = pa.table({"seg": seg, "i": pa.array(_places(new)), "kind": data.column("kind"), "more": data.column("more")})
                con.register("moves", pa.table(dict(zip(("kind", "from_state", "to_state", "cost", "letters"), map(pa.array, zip(*moves(), strict=True)), strict=True))))
            else:
                given = pa.table({"seg": seg, **{c: data.column(c) for c in ("part", "from_state", "to_state", "cost", "audit")}})
            con.register("turns", given)
            con.execute(_FROM_TURNS.format(delete=DELETE) if turns else _FROM_PARTS)
            found = con.execute(_PATHS).fetchall()
        at = [starts[r[0]] for r in found]
        part = following.take(pa.array(at, pa.int64()))
        columns = [conv.take(pa.array(at, pa.int64())), part, *(pa.array([r[k] for r in found], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.string())))]
        for lo in range(0, len(found), 1024):
            yield pa.RecordBatch.from_arrays([c.slice(lo, 1024).combine_chunks() if isinstance(c, pa.ChunkedArray) else c.slice(lo, 1024) for c in columns], ["conv_id", "part", "from_state", "to_state", "cost", "audit"])

    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda b, i: (b.column("conv_id")[i].as_py(), b.column("next")[i].as_py())
        if rows >= BATCH:  # whole segments only: the open one may go on in this batch
            cut = 0
            while cut < batch.num_rows and key(batch, cut) == last:
                cut += 1
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if batch.num_rows:
                yield from solve(held)
                held, rows = [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            last = key(batch, batch.num_rows - 1)
    if rows:
        yield from solve(held)


def _places(new: list[bool]) -> list[int]:
    out, at = [], 0
    for x in new:
        at = 1 if x else at + 1
        out.append(at)
    return out


def _joined(rows: DataFrame, turns: bool) -> DataFrame:
    """One step of joining: rows with column `next`, dealt by hash of (conv_id, next)."""
    dealt = rows.repartition("conv_id", "next").sortWithinPartitions("conv_id", "next", "part")
    return dealt.mapInArrow(partial(_recursion, turns=turns), "conv_id long, part long, from_state int, to_state int, cost long, audit string")


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, cost, audit of the cheapest repair, from rows (conv_id, place over the table, kind, more)."""
    parts = _joined(turns.withColumn("part", F.col("place")).withColumn("next", F.shiftright("place", SEGMENT_BITS)), True)
    parts = keep(parts, "segments")
    while parts.groupBy("conv_id").agg((F.min("part") < F.max("part")).alias("open")).where("open").limit(1).count():
        parts = keep(_joined(parts.withColumn("next", F.shiftright("part", JOIN_BITS)), False), "segments")
    closing = F.create_map(*[F.lit(x) for x in (0, "", 1, "II", 2, "I", 3, "")])[F.col("to_state")]
    ended = parts.where("from_state = 0").select("conv_id", (F.col("cost") + INSERT * F.length(closing)).alias("cost"), F.concat("audit", closing).alias("audit"))
    return ended.groupBy("conv_id").agg(F.min(F.struct("cost", "audit")).alias("x")).select("conv_id", "x.cost", "x.audit")


class _Open:
    """A conversation that is being replayed."""

    def __init__(self, conv_id, cost: int, audit: str):
        self.conv_id, self.cost, self.audit = conv_id, cost, audit
        self.at = self.state = self.place = 0
        self.sha, self.edits = hashlib.sha256(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.initial = None

    def _put(self, role: str, text: str, edit: str) -> None:
        self.sha.update((("\n" if self.place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.edits.append((self.conv_id, self.place, role, text, edit))
        self.place += 1

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._next_role("", "I")
            self.at += 1

    def _next_role(self, text: str, edit: str) -> None:
        self.state = _AFTER_INSERT[self.state]
        self._put("user" if self.state == 2 else "assistant", text, edit)

    def turn(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[initial]
            self._put(role, text, letter)
        elif letter == "R":
            self._next_role(text, letter)

    def close(self) -> tuple:
        self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.sha.hexdigest()


def _replay(batches, rows_out: bool) -> Iterator:
    """Streams a conversation: its audit (kind 0), then for each different turn its flags (1) and its texts (2)."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if rows_out else [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [f.split()[0] for f in (_TURNS if rows_out else _RESULT).split(", ")]

    def batch_of(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    out, size, now, flags = [], 0, None, (False, False, False)
    for batch in batches:
        columns = [batch.column(batch.schema.names.index(c)) for c in ("conv_id", "kind", "turn", "role", "text", "copies", "cost", "audit", "blank", "repeated", "cut")]
        for i in range(batch.num_rows):
            conv_id, kind, turn, role, text, copies, cost, audit, *flagged = (c[i].as_py() for c in columns)
            if kind == 0:
                if now is not None and not rows_out:
                    out.append(now.close())
                elif now is not None:
                    now.close()
                    out += now.edits
                now = _Open(conv_id, cost, audit)
            elif kind == 1:
                flags = flagged
            else:
                for _ in range(copies):
                    blank, repeated, cut = flags
                    now.turn(turn, role, text, "blank" if blank else "duplicate" if repeated else "truncated" if cut else "")
                    flags = (blank, True, cut)  # an equal turn at the same place repeats this one
                if rows_out:
                    out += now.edits
                now.edits.clear()
            size += len(text or "") + len(audit or "")
            if len(out) >= 1024 or size > 4_000_000 and out:
                yield batch_of(out)
                out, size = [], 0
    if now is not None:
        ended = now.close()
        out += now.edits if rows_out else [ended]
    if out:
        yield batch_of(out)


def _flags(rows: DataFrame) -> DataFrame:
    """One row for each different turn: its flags, how often it is there, and whether an earlier turn repeats it."""
    text = F.col("text")
    last = F.right(F.regexp_replace(text, rf"{_SPACE}\z", ""), F.lit(1))
    flagged = rows.select("conv_id", "known", "turn", "role", "digest", "copies", (last == "").alias("blank"), (~last.isin(*ENDS_WELL)).alias("cut"))
    key = ["conv_id", "known", "turn", "role", "digest"]
    slim = flagged.groupBy(*key).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    firsts = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    joined = slim.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    return joined.select(*key, "copies", "blank", "cut", (~F.struct("known", "turn").eqNullSafe(F.col("first"))).alias("repeated"))


def _replayed(rows: DataFrame, conversations: DataFrame, rows_out: bool) -> DataFrame:
    """rows: conv_id, turn, role, text, copies of turns as they are; conversations: conv_id of all that are asked for."""
    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("known", F.col("turn").isNotNull()).withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = ["known", "turn", "role", "digest"]
    slim = keep(numbered(_flags(rows), ["conv_id", *order], "place"), "turns")
    initial = F.left("role", F.lit(1))
    kind = F.when(F.col("blank") | F.col("repeated"), "d").otherwise(F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), F.when(F.col("cut"), "5").otherwise("")))
    found = audits(slim.select("conv_id", "place", kind.alias("kind"), (F.col("copies") - 1).alias("more")))
    found = found.select(F.col("conv_id").alias("_c"), "cost", "audit")
    heads = conversations.distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    marked = heads.select("conv_id", F.lit(0).alias("kind"), "cost", "audit")
    marked = marked.unionByName(slim.select("conv_id", F.lit(1).alias("kind"), *order, "blank", "repeated", "cut"), allowMissingColumns=True)
    marked = marked.unionByName(rows.select("conv_id", F.lit(2).alias("kind"), *order, "text", "copies"), allowMissingColumns=True)
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, *order, "kind")
    return dealt.mapInArrow(partial(_replay, rows_out=rows_out), _TURNS if rows_out else _RESULT)


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))


def repair(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row a conversation: its faults, the cost and letters of the cheapest edits, the hash of the repaired turns."""
    rows = _turns(conversations, conv_id, turn, role, text).withColumn("copies", F.lit(1))
    with scratch("repair") as result:
        return result(_replayed(rows, rows.select("conv_id"), False))


def repaired_turns(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, role, text, and the edit that put each there."""
    rows = _turns(conversations, conv_id, turn, role, text).withColumn("copies", F.lit(1))
    with scratch("repair") as result:
        return result(_replayed(rows, rows.select("conv_id"), True))


def damage_of(conv_id: Column, turn: Column) -> Column:
    """crc32 of `conv_id:turn`, modulo 20; a null counts as one space."""
    return F.crc32(F.concat_ws(":", F.coalesce(conv_id.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage that op12 does."""
    d = F.col("_damage")
    rows = _turns(conversations, "conv_id", "turn", "role", "text").withColumn("_damage", damage_of(F.col("conv_id"), F.col("turn"))).where(d != 0)
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(d == 3, 2).otherwise(1).alias("copies"))


def op12(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    with scratch("repair") as result:
        return result(_replayed(damaged(given), given.select(F.col("conv_id").cast("long").alias("conv_id")), False))


def oracle() -> str:
    """The same in SQL, turn by turn over the whole table."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: {byte}), 4294967295)"
    options = ", ".join(f"('{k}', {f}, {t}, {c}, '{x}')" for k, f, t, c, x in moves())
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (SELECT *, {crc} % 20 AS d FROM named),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE d <> 0),
t AS MATERIALIZED (SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid) AS seen, lag(left(role, 1)) OVER w AS before, right(regexp_replace(text, '{_SPACE}$', ''), 1) AS last FROM (SELECT *, row_number() OVER () AS rid FROM hurt) WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), rid)),
f AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM t),
moves(kind, f, g, c, x) AS (VALUES {options}),
steps AS MATERIALIZED (SELECT conv_id, n, moves.* FROM f JOIN moves ON kind = CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END || CASE WHEN fault = 'truncated' THEN '5' ELSE '' END END),
best AS (SELECT DISTINCT conv_id, 0 AS n, 0 AS state, 0 AS cost, '' AS audit FROM f UNION ALL
  SELECT b.conv_id, b.n + 1, s.g, min(b.cost + s.c), arg_min(b.audit || s.x, {{'c': b.cost + s.c, 'a': b.audit || s.x}}) FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.n + 1 AND s.f = b.state GROUP BY 1, 2, 3),
ended AS (SELECT b.conv_id, b.cost + {INSERT} * length(z) AS cost, b.audit || z AS audit FROM best b JOIN (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id) m ON m.n = b.n AND m.conv_id IS NOT DISTINCT FROM b.conv_id JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) v(state, z) USING (state)),
chosen AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, {{'c': cost, 'a': audit}}) AS audit FROM ended GROUP BY conv_id),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS i FROM chosen),
placed AS (SELECT *, count(*) FILTER (WHERE x <> 'I') OVER w AS n, count(*) FILTER (WHERE x <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
lined AS (SELECT p.conv_id, p.place, CASE WHEN x = 'K' THEN f.role WHEN (place - coalesce(max(CASE WHEN x = 'K' AND left(f.role, 1) = 's' THEN 1 END) OVER (PARTITION BY p.conv_id), 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE f.text END AS line FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n AND x <> 'I' WHERE x IN ('K', 'R', 'I')),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS h FROM lined GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM c.conv_id"""
