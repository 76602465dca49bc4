"""The longest run of whole words that a verse shares with any passage: seeds, shifts, islands.

Every stretch of `least` words of a verse is a seed. Seeds meet those of passages in an equi-join on two hashes; a
match is (verse, passage, shift, position), where shift is how far apart the two positions lie. Along one shift,
consecutive positions are one run, so runs are islands of consecutive numbers. No share of a verse has to match and no
passage is left out: a run of `least` words anywhere is found.

Scale: a passage is read once and only numbers leave it. Equal verses count once. Where the verses' seeds are small
Spark broadcasts them (by size, at run time) and passages never move; beyond that both sides meet in a shuffle of
16-byte keys. Matches are grouped by (verse, passage, shift), which holds no more rows than the verse has words, so a
seed that a third of all passages share spreads over as many groups; runs are then reduced by partial maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.functions.overlap import MIN_RUN, bound
from citewell.functions.text import match_form


def words_of(text: Column) -> Column:
    """Words of the matching form; no words for null."""
    return F.filter(F.split(match_form(F.coalesce(text, F.lit(""))), " +"), lambda w: w != "")


def seeds(words: Column, least: int) -> Column:
    """array<struct<h, g>>: two hashes of every stretch of `least` words, in order; their index is the position.

    Words are hashed once each, and stretches from the hashes of their words, so no stretch becomes a string.
    """

    def stretches(x: Column) -> Column:
        own = lambda i: [F.get(x, i + k) for k in range(least)]
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - least, F.lit(0)))
        found = F.transform(starts, lambda i: F.struct(F.xxhash64(*own(i)).alias("h"), F.hash(*own(i)).alias("g")))
        return F.when(F.size(x) >= least, found).otherwise(F.array().cast("array<struct<h:bigint,g:int>>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), stretches)


def _seeded(texts: DataFrame, key: str, position: str, least: int) -> DataFrame:
    parted = texts.select(key, words_of(F.col("text")).alias("_w"))
    return parted.select(key, F.posexplode(seeds(F.col("_w"), least)).alias(position, "_s")).select(key, position, "_s.h", "_s.g")


def shared_runs(verses: DataFrame, passages: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """verse_id, passage_id, shift, start, run: every longest stretch of at least `least` words that both have.

    verses: verse_id, text; passages: passage_id, text. start is the first word's position in the verse (from 0), start +
    shift that in the passage. Ids are expected to be unique; a repeated passage gives each of its runs again.
    """
    v = verses.select("verse_id", words_of(F.col("text")).alias("_w")).withColumn("_whole", F.xxhash64(F.array_join("_w", " "))).withColumn("_text", F.array_join("_w", " "))
    classes = v.groupBy("_whole", "_text").agg(F.min("verse_id").alias("verse_id"))
    members = v.select("_whole", "_text", F.col("verse_id").alias("_member")).join(classes.withColumnRenamed("verse_id", "_class"), ["_whole", "_text"]).select("_class", "_member")
    own = _seeded(classes.select("verse_id", F.col("_text").alias("text")), "verse_id", "i", least)
    met = _seeded(passages, "passage_id", "j", least).join(own, ["h", "g"]).select("verse_id", "passage_id", (F.col("j") - F.col("i")).alias("shift"), "i")
    along = Window.partitionBy("verse_id", "passage_id", "shift").orderBy("i")
    islands = met.withColumn("_island", F.col("i") - F.row_number().over(along))
    runs = islands.groupBy("verse_id", "passage_id", "shift", "_island").agg(F.min("i").alias("start"), (F.count("*") + least - 1).alias("run"))
    return runs.join(members, F.col("verse_id") == F.col("_class")).select(F.col("_member").alias("verse_id"), "passage_id", F.col("shift").cast("long"), F.col("start").cast("long"), "run")


def longest_runs(verses: DataFrame, passages: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """verse_id, passage_id, run of every verse: its longest run in any passage, of equals in the smallest passage_id.

    A verse without a run of `least` words has run 0 and no passage.
    """
    runs = shared_runs(verses, passages, least)
    top = runs.groupBy("verse_id").agg(F.min_by(F.struct("passage_id", "run"), F.struct((-F.col("run")).alias("r"), "passage_id")).alias("t"))
    return verses.select("verse_id").join(top, "verse_id", "left").select("verse_id", F.col("t.passage_id").alias("passage_id"), F.coalesce("t.run", F.lit(0)).cast("long").alias("run"))
