"""Language identification by inference of multilingual mixtures.

Every language is a distribution over byte trigrams (letters only, ASCII case folded, hashed to 2^16 buckets). A
document is a mixture of languages: expectation-maximisation estimates the proportions from the likelihoods of
its trigrams; then the set of languages grows from the most likely one, in the order of proportions, as long as
the likelihood gained exceeds a penalty for each language more.

Scale: one pass counts trigrams by language (partial sums of at most languages x 2^16 numbers a task), one pass
predicts; neither shuffles a text. The model, languages x 2^16 numbers, is all that the driver holds (it comes as one
row a language) and each task gets; more than MOST_LANGUAGES different labels (which are then hardly languages) are an
error, before any count. A task works on texts by their length, and on a long text by parts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import CHARS_A_BLOCK, bounded_batches, fold, text_blocks

BUCKET_BITS = 16
MOST_LANGUAGES = 256
SMOOTHING = 0.2
STEPS = 8
#: Trigrams overlap: a third of them counts as independent. Nats that a further language must gain, and its least share.
INDEPENDENT, PENALTY, LEAST_SHARE = 1 / 3, 6.0, 0.02
UNKNOWN = "und"
#: The most texts that are worked on at once, bytes whose trigrams are, and numbers (languages x characters) that are.
_TEXTS, _BYTES, _NUMBERS = 128, 1 << 20, 16 * CHARS_A_BLOCK

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams around a letter, and the index of the text of each; texts in order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LETTER[np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    at = np.flatnonzero(data[1:-1] != 0x20)
    bucket = ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    begins = np.cumsum([0, *(len(r) + 2 for r in raw)])
    return bucket, np.searchsorted(begins, at, "right") - 1


def tallied(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text * 2^BUCKET_BITS + bucket, how often), in that order; long texts are counted part by part."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0, *(len(r) + 2 for r in raw)])
    whole = b"  " + b"  ".join(raw) + b"  "
    parts = []
    for lo in range(0, len(whole) - 2, _BYTES):
        data = _LETTER[np.frombuffer(whole, np.uint8, min(_BYTES + 2, len(whole) - lo), lo)].astype(np.uint32)
        at = np.flatnonzero(data[1:-1] != 0x20)
        code = (data[at] << np.uint32(16)) | (data[at + 1] << np.uint32(8)) | data[at + 2]
        bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        parts.append(np.unique(((np.searchsorted(begins, at + lo, "right") - 1) << BUCKET_BITS) | bucket, return_counts=True))
        if len(parts) > 16:
            parts = [_merged(parts)]
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, index, np.concatenate([n for _, n in parts]))
    return keys, times


def _count(batches):
    import pyarrow as pa

    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lo, texts in text_blocks(batch.column(0), most=_TEXTS):
            keys, times = tallied(texts)
            cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << BUCKET_BITS)
            for k, lang in enumerate(langs[lo : lo + len(texts)]):
                own = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                own[keys[cuts[k] : cuts[k + 1]] & ((1 << BUCKET_BITS) - 1)] += times[cuts[k] : cuts[k + 1]]
    for k, row in sums.items():
        live = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(live), pa.string()), pa.array(live, pa.int32()), pa.array(row[live], pa.int64())], ["lang", "bucket", "n"])


def _packed(own: pd.DataFrame) -> pd.DataFrame:
    """One row: the buckets and counts of a language as bytes."""
    own = own.sort_values("bucket")
    return pd.DataFrame({"lang": own["lang"].iloc[:1], "bucket": [own["bucket"].to_numpy("<i4").tobytes()], "n": [own["n"].to_numpy("<i8").tobytes()]})


class Model:
    """log and plain probabilities of buckets by language; languages in the order of code points."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + SMOOTHING
        self.p = (p / p.sum(axis=1, keepdims=True)).astype(np.float32) if len(langs) else np.zeros((0, 1 << BUCKET_BITS), np.float32)


def learn(docs: DataFrame, text="text", lang="lang") -> Model:
    """Counts over all rows of docs whose lang is not null. More than MOST_LANGUAGES labels raise ValueError."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sorted(found.groupBy("lang").applyInPandas(_packed, "lang string, bucket binary, n binary").collect(), key=lambda r: r["lang"].encode())
    langs, counts = [r["lang"] for r in found], np.zeros((len(found), 1 << BUCKET_BITS))
    for row, r in zip(counts, found, strict=True):
        row[np.frombuffer(r["bucket"], "<i4")] = np.frombuffer(r["n"], "<i8")
    return Model(langs, counts)


def mixtures(texts: list[str], model: Model) -> list[list[tuple[str, float]]]:
    """Languages of each text with their proportions, largest first; none for a text without trigrams."""
    n_langs, out = len(model.langs), [[] for _ in texts]
    keys, times = tallied(texts)
    if not n_langs or not len(keys):
        return out
    owner, times = keys >> BUCKET_BITS, times.astype(np.float32)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs, row = owner[starts], np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    p = model.p[:, keys & ((1 << BUCKET_BITS) - 1)]
    total = np.add.reduceat(times, starts)
    single = np.stack([np.add.reduceat(times * np.log(q), starts) for q in p])  # log-likelihood of each language alone

    def climb(share: np.ndarray, p: np.ndarray, times, row, starts, total, steps: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            joint = share[:, row] * p
            joint *= times / joint.sum(axis=0)
            share = np.add.reduceat(joint, starts, axis=1) / total
        return share, np.add.reduceat(times * np.log((share[:, row] * p).sum(axis=0)), starts)

    share, full = climb(np.full((n_langs, len(docs)), 1 / n_langs, np.float32), p, times, row, starts, total, STEPS)
    best = single.argmax(axis=0)
    order = np.argsort(-share, axis=0, kind="stable")
    chosen = np.zeros((n_langs, len(docs)), bool)
    chosen[best, np.arange(len(docs))] = True
    result, reached = chosen.astype(np.float32), single.max(axis=0)
    open_ = np.flatnonzero(INDEPENDENT * (full - reached) > PENALTY)
    rank = 0
    while len(open_) and rank < n_langs:
        grown = chosen[:, open_].copy()
        grown[order[rank, open_], np.arange(len(open_))] = True
        wider = grown.sum(axis=0) > chosen[:, open_].sum(axis=0)
        live = np.isin(row, open_)
        sub_row = np.searchsorted(open_, row[live])
        sub_starts = np.flatnonzero(np.r_[True, sub_row[1:] != sub_row[:-1]])
        begin = np.where(grown, np.maximum(share[:, open_], 1e-3), 0)
        mixed, ll = climb((begin / begin.sum(axis=0)).astype(np.float32), p[:, live], times[live], sub_row, sub_starts, total[open_], STEPS)
        newest = mixed[order[rank, open_], np.arange(len(open_))]
        better = wider & (INDEPENDENT * (ll - reached[open_]) > PENALTY) & (newest >= LEAST_SHARE)
        take = open_[better]
        chosen[:, take], result[:, take], reached[take] = grown[:, better], mixed[:, better], ll[better]
        rank += 1
        open_ = open_[(better | ~wider) & (INDEPENDENT * (full[open_] - reached[open_]) > PENALTY)]
    for k, d in enumerate(docs.tolist()):
        own = [(float(result[x, k]), x) for x in np.flatnonzero(chosen[:, k])]
        out[d] = [(model.langs[x], s) for s, x in sorted(own, key=lambda y: (-y[0], y[1]))]
    return out


def _predict(batches, model: Model, at: int):
    import pyarrow as pa

    for batch in batches:
        for lo, texts in text_blocks(batch.column(at), max(1, min(CHARS_A_BLOCK, _NUMBERS // max(len(model.langs), 1))), _TEXTS):
            part = batch.slice(lo, len(texts))
            found = mixtures(texts, model)
            found = [f if any(map(str.isalpha, t)) else [] for f, t in zip(found, texts, strict=True)]
            columns = [
                pa.array([f[0][0] if f else UNKNOWN for f in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                pa.array([",".join(f"{x}:{s:.3f}" for x, s in f) for f in found], pa.string()),
            ]
            kept = [c for k, c in enumerate(part.columns) if k != at]
            names = [c for k, c in enumerate(part.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*names, "lang_pred", "score", "mixture"])


def predict(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """docs without the text, and lang_pred, score (the proportion of lang_pred) and mixture (all, as text).

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing was learned.
    Columns of docs with these names are dropped first. Equal texts have equal predictions.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "mixture")
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    fields = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", StringType())])
    return docs.mapInArrow(partial(_predict, model=model, at=docs.columns.index(text)), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 4) == 2
    model = learn(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
