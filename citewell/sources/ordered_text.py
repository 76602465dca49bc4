"""Text files in a defined order, written and compared without the driver holding them.

Lines are range-sorted and written as parts whose names follow the order; one file is then made of the parts by the file
system, copying bytes through a buffer of fixed size. A check
numbers the lines of the file that is there and compares them with the lines that would be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.operators.numbering import numbered
from citewell.sources.shared import folder, scratch

LINE, KEY = "line", "_key"


def lines_of(rows: DataFrame, order: list[str], texts: Column) -> DataFrame:
    """_key, line: the lines of every row (array<string>, or one string with line breaks), in order; null gives none."""
    kind = dict(rows.select(texts.alias("t")).dtypes)["t"]
    each = texts if kind.startswith("array") else F.split(texts, "\n", -1)
    return rows.select(F.struct(*order).alias("_row"), F.posexplode(each).alias("_i", LINE)).select(F.struct("_row", "_i").alias(KEY), LINE)


def headed(header: list[str], lines: DataFrame, footer: DataFrame | None = None) -> DataFrame:
    """Lines with a header before them and other lines (of lines_of) after them."""
    spark = lines.sparkSession
    kind = lines.schema[KEY].dataType.simpleString()
    first = spark.range(1).select(F.posexplode(F.array(*map(F.lit, header)) if header else F.array().cast("array<string>")).alias("_i", LINE))
    first = first.select(F.struct(F.lit(0).alias("p"), F.col("_i").alias("i"), F.lit(None).cast(kind).alias("k")).alias(KEY), LINE)
    body = lines.select(F.struct(F.lit(1).alias("p"), F.lit(0).alias("i"), F.col(KEY).alias("k")).alias(KEY), LINE)
    out = first.unionByName(body)
    if footer is not None:
        last = numbered(footer, [KEY], "_n").select(F.struct(F.lit(2).alias("p"), F.col("_n").cast("int").alias("i"), F.lit(None).cast(kind).alias("k")).alias(KEY), LINE)
        out = out.unionByName(last)
    return out


def write_text(lines: DataFrame, path: str) -> int:
    """Writes lines (_key, line) in the order of _key as one file; its length. An older file of that name is replaced."""
    spark = lines.sparkSession
    with scratch("text"):
        place = folder(spark, "text")
        lines.repartitionByRange(KEY).sortWithinPartitions(KEY).select(F.coalesce(LINE, F.lit("")).alias(LINE)).write.text(place)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        draft = target.suffix(".draft")
        out = fs.create(draft, True)
        try:
            for part in _parts(spark, place):
                source = part.getFileSystem(conf).open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
        finally:
            out.close()
        fs.delete(target, False)
        fs.rename(draft, target)
        return fs.getFileStatus(target).getLen()


def _parts(spark: SparkSession, place: str) -> list:
    """Part files in the order of their names, which is that of ranges."""
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((s.getPath() for s in found if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0), line of a text file; a file that is not there has no lines."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{LINE} string, n long")
    read = spark.read.text(path, lineSep="\n").select(F.col("value").alias(LINE), F.col("_metadata.file_block_start").alias("_at")).withColumn("_m", F.monotonically_increasing_id())
    return numbered(read, ["_at", "_m"], "n").select(LINE, "n")


def differences(lines: DataFrame, path: str, after: str | None = None) -> DataFrame:
    """n, is_there, should_be of the lines in which the file differs from what write_text would write.

    after: only what follows the first line with this text counts on both sides (the body below a header).
    """
    spark = lines.sparkSession
    new = numbered(lines.withColumn(LINE, F.coalesce(LINE, F.lit(""))), [KEY], "n").select(LINE, "n")
    old = read_lines(spark, path)
    if after is not None:
        new, old = (_below(x, after) for x in (new, old))
    both = old.select("n", F.col(LINE).alias("is_there")).join(new.select("n", F.col(LINE).alias("should_be")), "n", "full_outer")
    return both.where(~F.col("is_there").eqNullSafe(F.col("should_be")))


def _below(lines: DataFrame, after: str) -> DataFrame:
    found = lines.where(F.col(LINE) == after).agg(F.min("n").alias("_cut"))  # one row
    return lines.join(F.broadcast(found)).where(F.col("n") > F.col("_cut")).select(LINE, (F.col("n") - F.col("_cut")).alias("n"))


def corpus_lines(title: str, sections: DataFrame) -> DataFrame:
    """The lines of a Markdown corpus: a title, then every section (group_id, anchor, text) below its heading, by group and anchor."""
    own = lines_of(sections, ["group_id", "anchor"], F.concat(F.lit("## "), F.col("group_id").cast("string"), F.lit(":"), F.col("anchor").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")))
    return headed([f"# {title}", ""], own)


def digest_lines(title: str, header: dict[str, object], sections: DataFrame, verses: DataFrame) -> DataFrame:
    """The lines of a review digest: provenance, a separator, and a table of sections with their verses, weakest first.

    sections: group_id, anchor, run, coverage, verdict; verses: group_id, anchor, text. A section without its verse is an
    error. Below the separator the lines depend on the rows alone, so differences(..., after="---") compares bodies.
    """
    joined = sections.join(verses.select("group_id", "anchor", F.col("text").alias("_verse")), ["group_id", "anchor"], "left")
    place = F.concat(F.col("group_id").cast("string"), F.lit(":"), F.col("anchor").cast("string"))
    verse = F.when(F.col("_verse").isNull(), F.raise_error(F.concat(F.lit("no verse "), place)).cast("string")).otherwise(F.regexp_replace("_verse", r"\s+", " "))
    row = F.concat_ws(" | ", F.concat(F.lit("| "), place), F.col("run").cast("string"), F.format_number("coverage", 2), F.col("verdict"), F.concat(verse, F.lit(" |")))
    own = lines_of(joined, ["run", "group_id", "anchor"], F.array(row))
    return headed([*[f"{k}: {header[k]}" for k in sorted(header)], "", "---", f"# {title}", "", "| place | run | coverage | verdict | verse |", "| --- | --- | --- | --- | --- |"], own)
