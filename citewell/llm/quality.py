"""Quality classifier: a sparse ensemble of rules over document statistics.

Shallow boosted trees are grown on statistics of labelled documents; every path from a root is a conjunctive
rule; a logistic regression with an L1 penalty keeps few of the rules; what remains is compiled into one Spark
column expression, so scoring is plain arithmetic inside whole-stage code after the statistics.

Scale: the classifier is fitted on the documents of at most SAMPLE labelled ids, those with the smallest hashes,
and on at most SAMPLE different ones of these, again by hash, each with the number of its repeats as its weight (a
documented bound; it makes the fit's cost constant). Statistics are computed for every document over its whole
text in one pass without a shuffle.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import bounded_batches, fold, release

#: The most labelled ids, and the most different documents of theirs, to learn from; the order that picks them.
SAMPLE, SEED = 20_000, 31
#: Trees, their depth, the smallest leaf (share of rows), the bins of a statistic, the step of boosting.
TREES, DEPTH, LEAF, BINS, STEP = 40, 3, 0.002, 48, 0.3
#: L1 penalties that a held-back fifth of the rows chooses from.
PENALTIES = (3e-3, 1e-3, 3e-4, 1e-4)
THRESHOLD = 0.3

STATISTICS = (
    "chars", "words", "word_length", "longest_word", "upper", "digits", "space", "beyond_ascii", "stops", "commas", "marks",
    "symbols", "bars", "brackets", "other_ascii", "lines", "line_length", "repeated_lines", "distinct_words", "top_word", "repeated_pairs",
)
_GROUPS = {
    "upper": range(65, 91),
    "digits": range(48, 58),
    "space": [0x20, *range(9, 14)],
    "beyond_ascii": range(128, 256),
    "stops": b".",
    "commas": b",;:",
    "marks": b"!?",
    "symbols": b"#$%&*@^~+=",
    "bars": b"|\\/_",
    "brackets": b"<>{}[]()",
    "other_ascii": b"\"'`-",
}
_TABLE = np.zeros((256, len(_GROUPS)))
for _k, _own in enumerate(_GROUPS.values()):
    _TABLE[list(_own), _k] = 1


def statistics_of(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS; all zero for the empty text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _TABLE / len(raw)
    words = text.split()
    n = max(len(words), 1)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = text.split("\n")
    twice: dict[str, int] = {}
    for x in lines:
        twice[x] = twice.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        float(max(map(len, words), default=0)),
        *shares.tolist(),
        float(np.log1p(len(lines))),
        len(text) / len(lines),
        sum(len(x) * (k - 1) for x, k in twice.items()) / len(text),
        len(kinds) / n,
        max(kinds.values(), default=0) / n,
        1 - pairs / max(len(words) - 1, 1),
    ]


def _append(batches, at: int):
    import pyarrow as pa

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            table = np.array([statistics_of(t.as_py() or "") for t in part.column(at)], float).reshape(part.num_rows, len(STATISTICS))
            columns = [pa.array(table[:, k]) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *map(_name, STATISTICS)])
    release()


def _name(statistic: str) -> str:
    return f"_q_{statistic}"


def with_statistics(docs: DataFrame, text="text") -> DataFrame:
    """docs and a column _q_<statistic> for each statistic of the whole text (null: empty); clashing ones are replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    bounded_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in map(_name, STATISTICS) if c != text))
    schema = StructType([*docs.schema.fields, *(StructField(_name(s), DoubleType()) for s in STATISTICS)])
    return docs.mapInArrow(partial(_append, at=docs.columns.index(text)), schema)


# ---------------------------------------------------------------- fit

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def _grow(bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, least: float) -> list[tuple[tuple, np.ndarray, float]]:
    """Paths of one regression tree: (conditions, rows, mean) of every node below the root."""
    out = []
    heavy = residual * weight

    def split(own: np.ndarray, path: tuple, left_depth: int) -> None:
        r, n = heavy[own], weight[own]
        every = n.sum()
        if not left_depth or every < 2 * least:
            return
        total, best = r.sum(), (1e-9, None)
        base = total * total / every
        for f in range(bins.shape[1]):
            if not len(cuts[f]):
                continue
            b = bins[own, f]
            count = np.cumsum(np.bincount(b, n, minlength=len(cuts[f]) + 1))[:-1]
            part = np.cumsum(np.bincount(b, r, minlength=len(cuts[f]) + 1))[:-1]
            ok = (count >= least) & (every - count >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, part**2 / count + (total - part) ** 2 / (every - count) - base, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k))
        if best[1] is None:
            return
        f, k = best[1]
        above = bins[own, f] > k
        for side in (False, True):
            rows_in = own[above == side]
            here = (*path, (f, side, float(cuts[f][k])))
            out.append((here, rows_in, float(heavy[rows_in].sum() / weight[rows_in].sum())))
            split(rows_in, here, left_depth - 1)

    split(rows, (), depth)
    return out


def _simplify(path: tuple) -> Rule:
    """Of several conditions on one statistic and side, the strictest; in a fixed order."""
    kept: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        old = kept.get((f, above))
        kept[f, above] = cut if old is None else (max(old, cut) if above else min(old, cut))
    return tuple(sorted((f, above, cut) for (f, above), cut in kept.items()))


def grow_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees=TREES, depth=DEPTH, seed=SEED) -> list[Rule]:
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    mean = float((y * weight).sum() / weight.sum())
    draw = np.random.RandomState(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] if len(x) else c for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.sort(draw.permutation(len(y))[: max(200, len(y) // 2)])
        for path, _, _ in (nodes := _grow(bins, cuts, residual, weight, rows, depth, max(5, int(LEAF * weight.sum())))):
            rules.setdefault(_simplify(path))
        inner = {p[:-1] for p, _, _ in nodes}
        for path, _, mean in nodes:
            if path not in inner:
                score[holds(path, x)] += STEP * 4 * mean
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > cut) if above else (x[:, f] <= cut) for f, above, cut in rule], np.ones(len(x), bool))


def lasso_logistic(r1: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, use: np.ndarray | None = None, steps: int = 150) -> np.ndarray:
    """Weights by accelerated proximal gradient steps; the first column of r1 is all ones and not penalised.

    `use`: how much each row counts (1 by default); the matrix is never copied.
    """
    use = np.ones(len(y), np.float32) if use is None else use.astype(np.float32)
    n = float(use.sum())
    v = np.random.RandomState(1).rand(r1.shape[1]).astype(np.float32)
    norm = 1.0
    for _ in range(12):
        v = r1.T @ (use * (r1 @ v))
        norm = float(np.linalg.norm(v))
        v /= norm
    rate = 4 * n / (1.02 * norm)
    w = np.zeros(r1.shape[1]) if start is None else start.copy()
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r1 @ z.astype(np.float32)).astype(float)))
        step = z - rate * (r1.T @ (use * (p - y).astype(np.float32))).astype(float) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (old - 1) / t * (new - w)
        w = new
    return w


class RuleEnsemble:
    """Rules with their weights, and an intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> RuleEnsemble:
        """No rows: score 0.5. One class: the smoothed share of it. Both: rules and their lasso weights.

        weight: how often each row counts (1 by default).
        """
        weight = np.ones(len(y)) if weight is None else weight.astype(float)
        if not len(y) or y.min() == y.max():
            share = ((y * weight).sum() + 1) / (weight.sum() + 2)
            return cls([], [], float(np.log(share / (1 - share))))
        rules = grow_rules(x, y, weight)
        r1 = np.ones((len(y), len(rules) + 1), np.float32)
        for k, rule in enumerate(rules, 1):
            r1[:, k] = holds(rule, x)
        back = np.random.RandomState(SEED).rand(len(y)) < 0.2
        best, w = (np.inf, PENALTIES[0]), None
        if back.any() and len(set(y[~back])) == 2:
            for penalty in PENALTIES:
                w = lasso_logistic(r1, y, penalty, w, np.where(back, 0, weight))
                s = np.clip(1 / (1 + np.exp(-(r1 @ w.astype(np.float32))[back].astype(float))), 1e-9, 1 - 1e-9)
                loss = -np.average(np.where(y[back] > 0, np.log(s), np.log(1 - s)), weights=weight[back])
                best = min(best, (loss, penalty))
        w = lasso_logistic(r1, y, best[1], w, weight)
        live = [k for k in range(len(rules)) if abs(w[k + 1]) > 1e-4]
        return cls([rules[k] for k in live], [float(w[k + 1]) for k in live], float(w[0]))

    def column(self) -> Column:
        """The score as a Spark column over the statistics of with_statistics()."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(_name(STATISTICS[f])) > cut if above else F.col(_name(STATISTICS[f])) <= cut for f, above, cut in rule]
            total = total + F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", learn: Column | None = None, sample=SAMPLE) -> RuleEnsemble:
    """Fits on documents with a non-null 0/1 label where `learn` holds: of at most `sample` ids, by their hash.

    An id with several labels counts as 1 if one of them is; repeated documents weigh as often as they occur. Of
    ids with several texts, at most `sample` documents (different in their statistics) count, again by hash. Without
    labelled documents the score is 0.5; with one class it is the smoothed share of that class.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    rows = rows.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(sample)
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), "_id")  # at most `sample` rows
    names = list(map(_name, STATISTICS))
    found = with_statistics(own, "text").drop("text").groupBy("_id", "_y", *names).agg(F.count("*").alias("_n"))
    found = found.orderBy(F.xxhash64(F.lit(SEED), "_id", *names), "_id", *names).limit(sample).toPandas().sort_values(["_id", *names])
    model = RuleEnsemble.fit(found[names].to_numpy(float), found["_y"].to_numpy(float), found["_n"].to_numpy(float))
    del found
    release()  # the driver's memory
    return model


def score(docs: DataFrame, model: RuleEnsemble, text="text", threshold=THRESHOLD) -> DataFrame:
    """docs and the columns score (0 to 1) and predicted (1 from the threshold on); clashing columns are replaced.

    One row for each row of docs. Null and empty texts have statistics of zero and are scored from those; equal texts
    have equal scores; an empty table gives no rows. Other columns, nulls included, pass through.
    """
    rated = with_statistics(docs, text).withColumn("score", model.column())
    return rated.drop(*map(_name, STATISTICS)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learned(fold_of: str = "doc_id") -> Column:
    """The rows that op8 may learn from."""
    return fold(fold_of, 5) != 0


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels, learn=learned())
    return score(docs, model).select("doc_id", (~learned()).alias("held_out"), "score", "predicted")
