"""Document probability under a subword unigram model, summed over all segmentations.

The pieces are those of an existing public vocabulary; their scores are learned from the training documents. A
word's probability is the sum over all its segmentations into pieces, by a forward recursion in log space over
the lattice of pieces. Pieces never cross white space, so a text's probability is the product over its words and
its end, and each different word is computed once, wherever it occurs.

Scale: words are counted by partial aggregation. The most frequent ones (at most HOT words, a fixed bound) go to
every task, so no very frequent word is a join key; the others meet their counts in a join by word and return by
document as sums. What is gathered from the corpus is the table of its words, which grows with it; the driver
gets only the HOT words and one number for each piece of the vocabulary.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import partial
from itertools import chain
from math import exp, log, log1p

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import bounded_batches, fold, keep

#: Words that every task gets; words that a counting task holds at once; smoothing of piece counts.
HOT, HELD, SMOOTHING = 150_000, 400_000, 0.1
_LN10 = log(10)
_NEVER = float("-inf")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_processors: dict[str, object] = {}


def _processor(path: str):
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lowered: bytes.lower() and bytes.split() know ASCII only, as wanted."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Log probabilities of pieces as strings; prefixes of pieces map to None, so a search can stop early."""

    def __init__(self, path: str, scores: np.ndarray, end: float):
        sp = _processor(path)
        self.end, self.byte = end, [_NEVER] * 256
        self.pieces: dict[str, float | None] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = float(scores[i])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                for n in range(1, len(piece)):
                    self.pieces.setdefault(piece[:n], None)
                self.pieces[piece] = float(scores[i])

    def word(self, word: str) -> float:
        """Natural log of the word's probability, over all segmentations of its mark and characters."""
        text = "▁" + word
        n, get = len(text), self.pieces.get
        alpha = [_NEVER] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            here = alpha[i]
            if here == _NEVER:
                continue
            j = i + 1
            own = get(text[i:j], _NEVER)
            if own is None or own == _NEVER:  # no piece: the bytes of the character
                spelled = here + sum(self.byte[b] for b in text[i].encode("utf-8", "surrogatepass"))
                old = alpha[j]
                alpha[j] = spelled if old == _NEVER else max(old, spelled) + log1p(exp(-abs(old - spelled)))
            while own != _NEVER:
                if own is not None:
                    new, old = here + own, alpha[j]
                    alpha[j] = new if old == _NEVER else max(old, new) + log1p(exp(-abs(old - new)))
                j += 1
                if j > n:
                    break
                own = get(text[i:j], _NEVER)
        return alpha[n]


_lattices: dict[str, Lattice] = {}


def _lattice(key: str, path: str, scores: np.ndarray, end: float) -> Lattice:
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(path, scores, end)
    return _lattices[key]


# ---------------------------------------------------------------- counting


def _count(batches):
    import pyarrow as pa

    def flush(learned: Counter, others: Counter):
        words = [*learned, *(w for w in others if w not in learned)]
        counts = [learned[w] for w in learned] + [0] * (len(words) - len(learned))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

    learned, others = Counter(), Counter()
    for batch in batches:
        texts, training = batch.column(0), np.array(batch.column(1).to_pylist(), bool)
        for at in range(0, batch.num_rows, 128):
            part, own = texts.slice(at, 128).to_pylist(), training[at : at + 128]
            learned.update(chain.from_iterable(words_of(t) for t, k in zip(part, own, strict=True) if k))
            others.update(set(chain.from_iterable(words_of(t) for t, k in zip(part, own, strict=True) if not k)))
            if len(learned) + len(others) > HELD:
                yield flush(learned, others)
                learned, others = Counter(), Counter()
    yield flush(learned, others)


def _pieces(batches, path: str):
    import pyarrow as pa

    sp = _processor(path)
    sums = np.zeros(sp.get_piece_size(), np.int64)
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(words), 4096):
            ids = sp.encode([w.decode("utf-8", "replace") for w in words[at : at + 4096]], num_threads=1)
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            times = np.repeat(counts[at : at + 4096], [len(x) for x in ids])
            sums += np.bincount(flat, times, minlength=len(sums)).astype(np.int64)
    live = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(sums[live], pa.int64())], ["piece", "n"])


def _rate(batches, key: str, path: str, scores: np.ndarray, end: float):
    import pyarrow as pa

    lattice = _lattice(key, path, scores, end)
    for batch in batches:
        lp = [lattice.word(w.decode("utf-8", "replace")) / _LN10 for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64())], ["word", "c", "lp"])


# ---------------------------------------------------------------- scoring

_PARTS = "doc_id long, text_key long, held_out boolean, word binary, tf int, n int, n_tokens long, n_known long, base double, lp double"


def _sum_hot(batches, hot, end_base: float, end_lp: float, end_known: int):
    """Of each document: a row with the sums over its hot words and its end, and a row for each other word."""
    import pyarrow as pa

    known = hot.value
    for batch in batches:
        ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for at in range(0, batch.num_rows, 64):
            columns: list[list] = [[] for _ in range(10)]
            doc_id, text_key, out, word, tf, n, n_tokens, n_known, base, lp = columns
            for i, text in enumerate(batch.column(1).slice(at, 64).to_pylist(), at):
                words = words_of(text)
                key = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63
                counts = Counter(words)
                b, p, k, rest = end_base, end_lp, end_known, 0
                for w, c in counts.items():
                    v = known.get(w)
                    if v is None:
                        word.append(w)
                        tf.append(c)
                        rest += 1
                    else:
                        b += c * v[0]
                        p += c * v[1]
                        k += c
                # a word cannot hold a space: this key meets nothing and is spread evenly
                word.append(b" " + key.to_bytes(8, "little", signed=True) + str(ids[i]).encode())
                tf.append(0)
                doc_id += [ids[i]] * (rest + 1)
                text_key += [key] * (rest + 1)
                out += [held[i]] * (rest + 1)
                n += [0] * rest + [1]
                n_tokens += [0] * rest + [len(words) + 1]
                n_known += [0] * rest + [k]
                base += [0.0] * rest + [b]
                lp += [0.0] * rest + [p]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = ["doc_id", "text_key", "held_out", "word", "tf", "n", "n_tokens", "n_known", "base", "lp"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def score(docs: DataFrame, held_out, doc_id="doc_id", text="text", vocabulary: str | None = None, hot=HOT) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out`: a Boolean column over docs; other documents are learned from. Null and empty texts are their end
    alone. Without training documents every word is unknown. Repeated rows each get their row. An empty table
    gives no rows.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    bounded_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = source.select("text", ~F.col("held_out")).mapInArrow(_count, "word binary, c long")
    counted = keep(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    totals = counted.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = source.where(~F.col("held_out")).count()
    n, v = (totals[0] or 0) + ends, totals[1] + (ends > 0)
    norm = n + 1 * (v + 1)

    # learned scores of the vocabulary's pieces
    sums = counted.where("c > 0").mapInArrow(partial(_pieces, path=path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    size = _processor(path).get_piece_size()
    pieces = np.full(size + 1, SMOOTHING)
    for r in sums:
        pieces[r["piece"]] += r["n"]
    pieces[size] += ends
    logs = np.log(pieces / pieces.sum())
    rate = partial(_rate, key=uuid.uuid4().hex, path=path, scores=logs[:size], end=float(logs[size]))
    words = keep(counted.mapInArrow(rate, "word binary, c long, lp double"), "lm-words")

    # hot words: classes of nearly equal counts, from the largest on, as long as they fit
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(words.where("c > 0").groupBy(step.alias("step")).count().collect(), reverse=True)
    least, held = None, 0
    for r in sizes:
        if held + r["count"] > hot:
            break
        least, held = r["step"], held + r["count"]
    top = words.where((F.col("c") > 0) & (step >= least)).collect() if least is not None else []
    log10_norm = np.log10(norm)
    base_of = F.log10(F.coalesce("w.c", F.lit(0)) + 1.0) - F.lit(float(log10_norm))
    table = spark.sparkContext.broadcast({bytes(r["word"]): (float(np.log10(r["c"] + 1) - log10_norm), r["lp"]) for r in top})
    tail = words.where((F.col("c") == 0) | (step < least)) if least is not None else words
    parts = source.mapInArrow(partial(_sum_hot, hot=table, end_base=float(np.log10(ends + 1) - log10_norm), end_lp=float(logs[size]) / _LN10, end_known=int(ends > 0)), _PARTS)
    joined = parts.alias("p").join(tail.alias("w"), "word", "left").select(
        "doc_id",
        "text_key",
        "held_out",
        "n",
        "n_tokens",
        (F.col("n_known") + F.when(F.col("w.c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(F.col("tf") > 0, F.col("tf") * base_of).otherwise(0.0)).alias("base"),
        (F.col("p.lp") + F.when(F.col("tf") > 0, F.col("tf") * F.col("w.lp")).otherwise(0.0)).alias("lp"),
    )
    # equal rows add up to n times their sums, and return as n rows
    summed = joined.groupBy("doc_id", "text_key", "held_out").agg(*[F.sum(c).alias(c) for c in ("n", "n_tokens", "n_known", "base", "lp")])
    rows = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") / F.col("n")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("n")).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("n")).alias("base_score"),
        (F.col("lp") / F.col("n")).alias("score"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fold("doc_id", 7) == 2)
