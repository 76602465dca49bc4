"""Secret scans by a trigram inverted index (DataFrame functions only).

Every rule's regular expression gives a Boolean query over trigrams that any match must contain. The index holds,
for each document, one bit for each trigram that some query names: posting lists turned by document, so
intersecting postings is an AND of bits. It is built first and kept as a table. A scan reads the index, evaluates the
queries on it, and gets for each rule the documents that can match; only those are verified with the rule itself.
Rules without a mandatory trigram scan every document.

Scale: two narrow passes over the text, and a table of a few bytes a document. The documents that satisfy some
query are sent to every task if they number at most BROADCAST_DOCS, so no text is shuffled; beyond that they are
joined by id. An id that several rows share has the bits of all of them, which can only add candidates. The index
can be kept (`trigram_index`) for later scans of the same texts, and inverted into lists (`postings`). Places of
spans come from two-level sums, so many matches in one text cost n^1.5 additions instead of n^2 copies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import keep, text_or_empty

#: Candidate documents that are sent to every task, at most.
BROADCAST_DOCS = 500_000
#: Characters of the pieces in which texts are redacted.
PIECE = 1024


@dataclass(frozen=True)
class Rule:
    """kind; the expression; the group whose length counts (0: the match) and its least length; whether A-Z are a-z."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    either_case: bool = False
    #: where a short match can hide no longer one: an equivalent expression that does not stop at short ones
    only_long: str | None = None


#: The base rules, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, only_long=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, only_long=r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Spans that the method adds: public formats of key material.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + EXTRA

# ---------------------------------------------------------------- Boolean trigram queries
# A query is a set of alternatives; an alternative is a set of trigrams that must all occur. None: no condition.

Query = frozenset[frozenset[str]] | None


def trigram_query(pattern: str, either_case: bool = False) -> Query:
    """Trigrams that every match contains: runs of literal characters, and the choices of alternations.

    Works on Python's parse of the expression. Concatenation joins literal runs and ANDs conditions; alternation
    ORs them; what may be absent or is a class of many characters ends a run. Small classes are expanded.
    """
    parsed = re._parser.parse(pattern)
    texts, query = _walk(list(parsed))
    query = _and(query, _of(texts))
    if query is None or not all(query):
        return None
    lower = (lambda s: s.lower()) if either_case else (lambda s: s)
    found = {frozenset(lower(t) for t in alternative) for alternative in query}
    return frozenset(a for a in found if not any(b < a for b in found))


_MANY = 64


def _of(texts: set[str] | None) -> Query:
    """The condition that one of the texts occurs."""
    if not texts or any(len(t) < 3 for t in texts):
        return None
    return frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return frozenset(x | y for x in a for y in b)


def _walk(items: list) -> tuple[set[str] | None, Query]:
    """(the texts that the whole may be exactly, or None; a condition on any match)."""
    exact: set[str] | None = {""}
    runs: set[str] = {""}
    query: Query = None
    for item in items:
        texts, own = _item(item)
        query = _and(query, own)
        if texts is not None and len(runs) * len(texts) <= _MANY:
            runs = {a + b for a in runs for b in texts}
            exact = None if exact is None else {a + b for a in exact for b in texts}
        else:
            query = _and(query, _of(runs))
            query = _and(query, _of(texts))
            runs, exact = {""}, None
    if exact is not None:
        return exact, query
    return None, _and(query, _of(runs))


def _item(item) -> tuple[set[str] | None, Query]:
    kind, value = str(item[0]), item[1]
    if kind == "LITERAL":
        return {chr(value)}, None
    if kind == "IN":
        chars = set()
        for sub, x in value:
            if str(sub) == "LITERAL":
                chars.add(chr(x))
            elif str(sub) == "RANGE" and x[1] - x[0] < 6:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 6 else (None, None)
    if kind == "SUBPATTERN":
        return _walk(list(value[-1]))
    if kind == "BRANCH":
        parts = [_walk(list(x)) for x in value[1]]
        if all(t is not None for t, _ in parts):
            return set().union(*(t for t, _ in parts)), None
        queries = [_and(q, _of(t)) for t, q in parts]
        return None, None if any(q is None for q in queries) else frozenset().union(*queries)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, sub = value
        texts, query = _walk(list(sub))
        if low == 0:
            return ({""} | texts if texts is not None and high == 1 else None), None
        if low == high and texts is not None and len(texts) ** min(int(low), 9) <= _MANY:
            out = {""}
            for _ in range(int(low)):
                out = {a + b for a in out for b in texts}
            return out, None
        return None, _and(query, _of(texts) if texts else None)
    if kind in ("ASSERT", "ASSERT_NOT", "AT"):
        return {""}, None
    return None, None


# ---------------------------------------------------------------- index


class TrigramIndex:
    """The trigrams that the rules' queries name, each with its bit, and the rules' queries over these bits."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.pattern, r.either_case) for r in rules}
        self.folded = {r.kind: r.either_case for r in rules}
        named = {(t, r.either_case) for r in rules for alternative in self.queries[r.kind] or () for t in alternative}
        self.grams = sorted(named)
        self.bit = {g: i for i, g in enumerate(self.grams)}

    def bits(self, text: str, lowered: str) -> Column:
        """array<long>: the bits of a document, 62 to a number."""
        words = []
        for lo in range(0, max(len(self.grams), 1), 62):
            own = self.grams[lo : lo + 62]
            parts = [F.when(F.contains(F.col(lowered if folded else text), F.lit(gram)), F.lit(1 << i)).otherwise(F.lit(0)) for i, (gram, folded) in enumerate(own)]
            words.append(reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(0).cast("long")))
        return F.array(*words)

    def candidate(self, kind: str, bits: str) -> Column:
        """Whether a document's bits satisfy the rule's query; true for rules without one."""
        query = self.queries[kind]
        if query is None:
            return F.lit(True)
        tests = []
        for alternative in sorted(query, key=sorted):
            masks: dict[int, int] = {}
            for gram in alternative:
                at = self.bit[gram, self.folded[kind]]
                masks[at // 62] = masks.get(at // 62, 0) | (1 << (at % 62))
            tests.append(reduce(lambda a, b: a & b, [F.col(bits)[w].bitwiseAND(F.lit(m)) == F.lit(m) for w, m in sorted(masks.items())]))
        return reduce(lambda a, b: a | b, tests)


def trigram_index(docs: DataFrame, doc_id="doc_id", text="text", index: TrigramIndex | None = None) -> DataFrame:
    """The index as a table: doc_id and bits (array<long>), one row for each row of docs; null text has no bits."""
    index = index or TrigramIndex()
    both = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(f"`{text}`").alias("t")).withColumn("l", F.lower("t"))
    return both.select("doc_id", index.bits("t", "l").alias("bits"))


def candidates(table: DataFrame, index: TrigramIndex | None = None) -> DataFrame:
    """doc_id and rules (the bits of those rules with a query that the document satisfies), where there is one.

    One row an id; rows of the index with one id, null included, are taken together.
    """
    index = index or TrigramIndex()
    tests = [(k, index.candidate(r.kind, "bits")) for k, r in enumerate(index.rules) if index.queries[r.kind] is not None]
    held = reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, test in tests], F.lit(0)).cast("long")
    return table.select("doc_id", held.alias("rules")).where("rules <> 0").groupBy("doc_id").agg(F.bit_or("rules").alias("rules"))


def postings(table: DataFrame, index: TrigramIndex | None = None) -> DataFrame:
    """The table inverted: one row for each trigram and document that has it."""
    index = index or TrigramIndex()
    held = [F.when(F.col("bits")[i // 62].bitwiseAND(F.lit(1 << (i % 62))) != 0, F.struct(F.lit(g).alias("trigram"), F.lit(folded).alias("folded"))) for i, (g, folded) in enumerate(index.grams)]
    return table.select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("x")).select("x.trigram", "x.folded", "doc_id")


# ---------------------------------------------------------------- spans


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.either_case else "") + (rule.only_long or rule.pattern)


def running_sums(numbers: Column) -> Column:
    """The sums of array<int> up to and including each element: sums of blocks of sqrt(n), then inside a block."""

    def summed(x: Column) -> Column:
        n = F.size(x)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: total(F.slice(x, b * width + 1, width)))
        return _once(blocks, lambda sums: _once(F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))), lambda before: F.transform(x, lambda _, i: F.get(before, F.floor(i / width).cast("int")) + total(F.slice(x, F.floor(i / width).cast("int") * width + 1, i % width + 1)))))

    return _once(numbers, lambda x: F.when(F.size(x) > 0, summed(x)).otherwise(x))


def _once(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rule_spans(rule: Rule, text: str, gate: Column) -> Column:
    """array<struct<start, end>> of the rule's matches, leftmost and not overlapping, code points, short ones dropped.

    The pieces between matches and the matches themselves alternate, so their lengths give the places.
    """
    pattern = F.lit(_java(rule))
    t = F.col(text)
    matches = F.regexp_extract_all(t, pattern, F.lit(0))
    counted = F.regexp_extract_all(t, pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.split(t, _java(rule), -1)

    def spans(m: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), m, lambda p, x: F.length(p) + F.length(x))
        ends = F.zip_with(running_sums(steps), m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end")))
        every = F.zip_with(ends, counted, lambda s, c: F.when(F.length(c) >= rule.least, s))
        return F.array_compact(every)

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(gate & F.regexp_like(t, pattern), _once(matches, spans)).otherwise(empty)


def _labelled(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, text="text", rules=RULES, doc_id="doc_id", index: DataFrame | None = None) -> DataFrame:
    """docs and the column spans: array<struct<start, rank, kind, end>> by start, then the order of the rules.

    index: a table that trigram_index() gave for these documents and rules; by default it is built and kept first. Null
    text counts as empty and has no spans. Spans of one rule do not overlap; those of different rules may. A column
    named spans is replaced; no other column is touched. Repeated and null ids are scanned like others, repeated rows
    each; an empty table gives no rows.
    """
    about = TrigramIndex(rules)
    table = index if index is not None else keep(trigram_index(docs, doc_id, text, about), "secret-index")
    found = keep(candidates(table, about), "secret-candidates").withColumnRenamed("doc_id", "id")
    few = found.count() <= BROADCAST_DOCS
    names = [c for c in docs.columns if c != "spans"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{doc_id}`").alias("own"), text_or_empty(f"`{text}`").alias("t"))
    rows = rows.join(F.broadcast(found) if few else found, F.col("own").eqNullSafe(F.col("id")), "left")
    parts = []
    for rank, rule in enumerate(rules):
        gate = F.lit(True) if about.queries[rule.kind] is None else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << rank)) != 0, F.lit(False))
        parts.append(_labelled(_rule_spans(rule, "t", gate), rank, rule.kind))
    spans = F.array_sort(F.concat(*parts)).alias("spans")
    return rows.select(*[F.col("doc")[c].alias(c) for c in names], spans)


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text="text", mark="[SECRET]", rules=RULES, doc_id="doc_id", index: DataFrame | None = None) -> DataFrame:
    """docs with each stretch of the text that spans cover replaced by a mark; overlapping spans are one stretch.

    Texts without spans, and null texts, stay as they are. Long texts are put together from pieces of PIECE
    characters, each cut where stretches begin and end in it, so no text is walked from its start for each span.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    rows = scan(held, "text", rules, "doc_id", index)
    t = F.col("text")

    def cut(piece: Column, k: Column, stretches: Column) -> Column:
        """One piece without what stretches cover, with a mark where a stretch begins."""
        low, high = k * PIECE, k * PIECE + F.length(piece)
        here = F.filter(stretches, lambda s: (s["start"] < high) & (s["end"] > low))
        part = lambda a, b: F.substring(piece, a - low + 1, F.greatest(b - a, F.lit(0)))
        before = lambda own, i: F.when(i == 0, low).otherwise(F.get(own, i - 1)["end"])
        shown = lambda own: F.transform(own, lambda s, i: F.concat(part(before(own, i), s["start"]), F.when(s["start"] >= low, F.lit(mark)).otherwise(F.lit(""))))
        last = lambda own: part(F.element_at(own, -1)["end"], high)
        return _once(here, lambda own: F.when(F.size(own) == 0, piece).otherwise(F.concat(F.array_join(shown(own), ""), last(own))))

    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = _once(_stretches(F.col("spans")), lambda stretches: F.array_join(F.transform(pieces, lambda p, k: cut(p, k, stretches)), ""))
    changed = F.when(F.size("spans") > 0, whole).otherwise(t)
    return rows.select(*[(changed if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])


def _stretches(spans: Column) -> Column:
    """Spans, sorted by start, as stretches that do not overlap: a span that begins inside an earlier one is cut off there.

    A span begins a stretch if no earlier one reaches beyond its start. The furthest end before each is found by
    blocks, as running_sums() finds sums.
    """

    def merged(x: Column) -> Column:
        n = F.size(x)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")
        furthest = lambda part: F.aggregate(part, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: furthest(F.slice(x, b * width + 1, width)))
        most = lambda part: F.aggregate(part, F.lit(0), lambda a, e: F.greatest(a, e))
        before = lambda sums: F.transform(sums, lambda _, b: most(F.slice(sums, F.lit(1), b)))
        reach = lambda earlier, i: F.greatest(F.get(earlier, F.floor(i / width).cast("int")), furthest(F.slice(x, F.floor(i / width).cast("int") * width + 1, i % width)))
        ends = _once(blocks, lambda sums: _once(before(sums), lambda earlier: F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), reach(earlier, i).alias("reach")))))
        return ends

    def joined(x: Column) -> Column:
        """Starts of stretches, and the furthest end before the next start."""
        begins = F.filter(F.transform(x, lambda s, i: F.when((i == 0) | (s["start"] >= s["reach"]), F.struct(s["start"].alias("start"), s["reach"].alias("reach")))), lambda s: s.isNotNull())
        last = F.array_max(F.transform(x, lambda s: s["end"]))
        return _once(begins, lambda b: F.transform(b, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(b, i + 1)["reach"], last).alias("end"))))

    return _once(spans, lambda x: _once(merged(x), joined))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
