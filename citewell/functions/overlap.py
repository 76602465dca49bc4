"""How much of a verse-like text a passage quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.functions.text import match_form

# Window length, share that counts as quoted, words of a run that corroborate, stock openings.
WINDOW = 8
QUOTED = 0.5
MIN_RUN = 4
INTRODUCING = ("يخبر تعالى", "يقول تعالى", "قال تعالى")

#: Windows of an index that every task gets, at most.
MAX_WINDOWS = 500_000


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once: inner lambdas see a variable instead of the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(folded: Column, k: int = WINDOW) -> Column:
    """All windows of k characters, repeats kept; none if the text is shorter."""
    slid = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - k + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(k)))
    return bound(folded, lambda t: F.when(F.length(t) >= k, slid(t)).otherwise(F.array().cast("array<string>")))


def quote_coverage(verse: Column, passage: Column, k: int = WINDOW) -> Column:
    """Share of the verse's windows that the passage contains; a verse shorter than k counts as one window.

    Both texts are folded first. An empty side gives 0.
    """
    v, p = match_form(F.coalesce(verse, F.lit(""))), match_form(F.coalesce(passage, F.lit("")))

    def shared(v: Column, p: Column) -> Column:
        own = windows(v, k)
        share = bound(own, lambda ws: F.aggregate(ws, F.lit(0), lambda n, w: n + F.contains(p, w).cast("int")) / F.size(ws))
        short = F.contains(p, v).cast("double")
        return F.when((v == "") | (p == ""), F.lit(0.0)).when(F.length(v) < k, short).otherwise(share)

    return bound(v, lambda x: bound(p, lambda y: shared(x, y)))


def longest_quoted_run(verse: Column, passage: Column) -> Column:
    """Longest stretch of consecutive verse words, joined by spaces, that occurs in the passage.

    For a start i the runs that fit are those up to some end, so one pass keeps the longest end so far: the window
    slides over the words, growing while it is contained and moving on when it is not.
    """
    v, p = match_form(F.coalesce(verse, F.lit(""))), match_form(F.coalesce(passage, F.lit("")))
    words = F.filter(F.split(v, " +"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("best"))

    def step(p: Column, state: Column, word: Column) -> Column:
        grown = F.concat(state["open"], F.array(word))
        fits = F.contains(p, F.array_join(grown, " "))
        kept = F.when(fits, grown).otherwise(F.slice(grown, 2, F.size(grown)))
        return F.struct(kept.alias("open"), F.when(fits, F.greatest(state["best"], F.size(grown))).otherwise(state["best"]).alias("best"))

    return bound(p, lambda t: F.aggregate(words, start, lambda state, word: step(t, state, word), lambda s: s["best"]))


def has_introduction(passage: Column, phrases=INTRODUCING) -> Column:
    p = match_form(F.coalesce(passage, F.lit("")))
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(p, match_form(F.lit(phrase)))
    return found


def score(verse: Column, passage: Column, k: int = WINDOW, phrases=INTRODUCING) -> Column:
    cov = quote_coverage(verse, passage, k)
    return F.struct(longest_quoted_run(verse, passage).alias("run"), cov.alias("coverage"), (cov >= QUOTED).alias("quoted"), has_introduction(passage, phrases).alias("introduced"))


def verdict(run: Column, introduced: Column, quoted: Column, min_run: int = MIN_RUN, has_passage: Column | None = None) -> Column:
    word = F.when((run >= min_run) | introduced | quoted, "corroborated").otherwise("uncorroborated")
    return word if has_passage is None else F.when(has_passage, word).otherwise("gap")


def coverage_pairs(verses: DataFrame, passages: DataFrame, k: int = WINDOW, least: float = QUOTED) -> DataFrame:
    """verse_id, passage_id, windows, found, coverage of all pairs that reach `least`.

    verses: verse_id, text; passages: passage_id, text. A verse shorter than k is one window of its own length, so
    passages also give the windows of each such length that occurs (below k, so a few numbers to collect). Windows of passages meet those of verses in an equi-join:
    a passage's distinct windows are first narrowed to the verses' windows by a semi-join, so what is shuffled is
    proportional to the matches. A window in very many passages spreads by AQE's skew handling, and each (verse,
    passage) pair is aggregated on the map side first.
    """
    folded = verses.select("verse_id", match_form(F.coalesce("text", F.lit(""))).alias("v"))
    own = folded.select("verse_id", F.explode(F.when(F.length("v") >= k, windows(F.col("v"), k)).when(F.length("v") > 0, F.array("v"))).alias("w"))
    own = own.groupBy("verse_id", "w").agg(F.count("*").alias("times"))
    shorter = [r[0] for r in folded.where((F.length("v") > 0) & (F.length("v") < k)).select(F.length("v")).distinct().collect()]
    totals = own.groupBy("verse_id").agg(F.sum("times").alias("windows"))
    wanted = own.select("w").distinct()
    chars = F.split(match_form(F.coalesce("text", F.lit(""))), "")
    p = passages.select("passage_id", chars.alias("c"))
    slid = lambda m: F.when(F.size("c") >= m, F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - m + 1, F.lit(1))), lambda i: F.array_join(F.slice("c", i, m), ""))).otherwise(F.array().cast("array<string>"))
    # array_distinct before the join: a passage counts a window once
    grams = p.select("passage_id", F.explode(F.array_distinct(F.concat(*map(slid, (k, *sorted(shorter)))))).alias("w"))
    met = grams.join(wanted, "w", "left_semi").join(own, "w").groupBy("verse_id", "passage_id").agg(F.sum("times").alias("found"))
    pairs = met.join(totals, "verse_id").withColumn("coverage", F.col("found") / F.col("windows"))
    return pairs.where(F.col("coverage") >= least).select("verse_id", "passage_id", F.col("windows").cast("long"), F.col("found").cast("long"), "coverage")


def coverage_pairs_indexed(verses: DataFrame, passages: DataFrame, k: int = WINDOW, least: float = QUOTED, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """coverage_pairs by an inverted index of the verses' windows that every task gets, if it has at most max_windows
    entries (checked); beyond that, by the equi-join. Both give the same rows. Passages are read once and nothing of
    them is shuffled."""
    found = _indexed(verses, passages, k, least, max_windows, runs=False, best=False)
    return coverage_pairs(verses, passages, k, least) if found is None else found


def scored_pairs(verses: DataFrame, passages: DataFrame, k: int = WINDOW, least: float = QUOTED, best: bool = False, phrases=INTRODUCING, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of coverage_pairs with run (longest_quoted_run) and introduced (has_introduction).

    best: of each verse only the passage of the largest coverage, of equals the smallest passage_id. Under max_windows
    all of it happens where a passage is read, so no text moves; beyond that the texts of the pairs left are joined.
    """
    found = _indexed(verses, passages, k, least, max_windows, runs=True, best=best, phrases=phrases)
    if found is None:
        pairs = coverage_pairs(verses, passages, k, least)
        pairs = _best(pairs) if best else pairs
        texts = passages.select("passage_id", F.col("text").alias("_p"))
        joined = pairs.join(texts, "passage_id").join(verses.select("verse_id", F.col("text").alias("_v")), "verse_id")
        return joined.select("verse_id", "passage_id", "windows", "found", "coverage", longest_quoted_run(F.col("_v"), F.col("_p")).cast("long").alias("run"), has_introduction(F.col("_p"), phrases).alias("introduced"))
    return _best(found) if best else found


def _best(pairs: DataFrame) -> DataFrame:
    """By partial aggregates; passage ids are numbers."""
    rest = [c for c in pairs.columns if c not in ("verse_id", "passage_id", "coverage")]
    top = pairs.groupBy("verse_id").agg(F.max(F.struct("coverage", (-F.col("passage_id")).alias("neg"), *rest)).alias("b"))
    return top.select("verse_id", (-F.col("b.neg")).alias("passage_id"), "b.coverage", *[F.col(f"b.{c}") for c in rest]).select(*pairs.columns)


def _run(words: list[str], passage: str) -> int:
    low = best = 0
    for high in range(1, len(words) + 1):
        while low < high and " ".join(words[low:high]) not in passage:
            low += 1
        best = max(best, high - low)
    return best


def _indexed(verses, passages, k, least, max_windows, runs: bool, best: bool, phrases=()) -> DataFrame | None:
    """Pairs by the broadcast index, or None if it would be too large.

    A passage's windows are first hashed as numbers and tested against a bitmap of the index's hashes; only those that
    pass become strings and are looked up.
    """
    import numpy as np
    import pandas as pd

    spark = verses.sparkSession
    folded = verses.select("verse_id", match_form(F.coalesce("text", F.lit(""))).alias("v"))
    n = folded.agg(F.sum(F.greatest(F.length("v") - k + 1, F.lit(1)))).first()[0] or 0
    if n > max_windows:
        return None
    index: dict[str, list[int]] = {}
    rows = [(r["verse_id"], r["v"]) for r in folded.collect() if r["v"]]
    ids, total = [x for x, _ in rows], [max(len(v) - k + 1, 1) for _, v in rows]
    for at, (_, v) in enumerate(rows):
        for i in range(max(len(v) - k + 1, 1)):
            index.setdefault(v[i : i + k], []).append(at)
    folds = [r[0] for r in spark.createDataFrame([(x,) for x in phrases], "t string").select(match_form(F.col("t"))).collect()] if runs and phrases else []
    bits = 22

    def hashes(text: str, m: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out = np.zeros(max(len(codes) - m + 1, 0), np.uint64)
        for j in range(m if len(out) else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(out)]
        return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)

    known = np.zeros(1 << bits, bool)
    for w in index:
        known[hashes(w, len(w))] = True
    shared = spark.sparkContext.broadcast((index, ids, total, sorted({len(w) for w in index}), known, [[w for w in v.split(" ") if w] for _, v in rows] if runs else None, folds))
    names = ["verse_id", "passage_id", "windows", "found", "coverage", *(["run", "introduced"] if runs else [])]

    def find(frames):
        index, ids, total, sizes, known, words, folds = shared.value
        for frame in frames:
            out, top = [], {}
            for passage_id, text in zip(frame["passage_id"], frame["p"], strict=True):
                found: dict[int, int] = {}
                for m in sizes:
                    for w in {text[i : i + m] for i in np.flatnonzero(known[hashes(text, m)]).tolist()} & index.keys():
                        for at in index[w]:
                            found[at] = found.get(at, 0) + 1
                for at, c in found.items():
                    share = c / total[at]
                    if share < least or best and top.get(at, (-1.0,)) >= (share, -passage_id):
                        continue
                    row = (ids[at], passage_id, total[at], c, share)
                    if runs:
                        row += (_run(words[at], text), any(x in text for x in folds))
                    if best:
                        top[at] = (share, -passage_id, row)
                    else:
                        out.append(row)
            yield pd.DataFrame([x[2] for x in top.values()] if best else out, columns=names)

    kinds = dict(verses.dtypes)["verse_id"], dict(passages.dtypes)["passage_id"]
    source = passages.select("passage_id", match_form(F.coalesce("text", F.lit(""))).alias("p"))
    more = ", run bigint, introduced boolean" if runs else ""
    return source.mapInPandas(find, f"verse_id {kinds[0]}, passage_id {kinds[1]}, windows bigint, found bigint, coverage double{more}")
