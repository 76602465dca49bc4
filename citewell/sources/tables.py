"""Typed readers. Schemas are explicit, so no pass over the data infers them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark DDL of the entities.
SCHEMAS = {
    "anchors": "group_id int, anchor int, text string, text_simple string, corpus_version string, content_hash string",
    "anchor_groups": "group_id int, n int",
    "sources": "id string, title string, author string, language string, authority_tier int, licensing_status string, verification_status string, edition string, methodology_classification string, metadata map<string,string>, ingestion_status string, ingested_at timestamp, raw_text_ref string, current_version string",
    "source_versions": "id string, source_id string, edition string, version_label string, raw_text_ref string, content_hash string, created_at timestamp",
    "documents_registry": "id string, source_version_id string, raw_text_ref string, ingestion_status string, content_type string, group_id int, anchor_count int, created_at timestamp",
    "manifest": "id string, source_version string, language string, content_type string, group_id int, sections array<struct<ordinal:int,group_id:int,start:int,end:int,mapping_type:string,text:string>>",
    "editions": "id int, name string, author_name string, language_name string, slug string",
    "keyed_texts": "number int, text string",
    "reviews": "id string, item_id string, content_type string, reviewer_id string, decision string, comments string, created_at timestamp, source_version string, prompt_version string, model_version string",
    "media_items": "id string, media_source_id string, group_id int, anchor int, audio_url string, duration_seconds int",
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files that spread() moves at most: what a scan task reads by default.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table in fewer files than the session has cores, dealt over all cores.

    A file of one row group is one task's, however many splits it has. Only a table of at most SPREAD_BYTES is moved
    (checked), so the shuffle does not grow; any other table is returned as it is. Rows stay the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > SPREAD_BYTES or len(df.inputFiles()) >= cores else df.repartition(cores)


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a driver's table for work that takes long for each row."""
    return spread(driver_table(spark, sf_dir, name).select(*columns))


def read_json(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """A JSON array or one record a line; malformed input is an error, not a null row."""
    return spark.read.schema(SCHEMAS[entity]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """The documents of a manifest. No path, no file, or an empty file is the empty set; bad JSON is an error."""
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], SCHEMAS["manifest"])
    return read_json(spark, path, "manifest").where(F.col("id").isNotNull())


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sections_of(manifest: DataFrame, source_id: str) -> DataFrame:
    """One row a section, in the columns that build_chunks takes."""
    flat = manifest.select(F.col("id").alias("document_id"), "source_version", F.col("group_id").alias("doc_group_id"), F.explode("sections").alias("s"))
    return flat.select("document_id", F.lit(source_id).alias("source_id"), "source_version", "doc_group_id", "s.*")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"))


def raw_text_path(root: str, reference: str) -> str:
    """Where a registry's raw text reference points: absolute references and addresses stay, others are below root."""
    return reference if reference.startswith("/") or "://" in reference else os.path.join(root, reference)


def parse_corpus(texts: DataFrame, group_id: int) -> DataFrame:
    """anchor, text of each section of Markdown texts headed by lines `## group:anchor`; other groups are left out.

    texts: path, text. The first piece, before any heading, is not a section.
    """
    pieces = F.regexp_replace("text", r"(?m)^## +(\d+):(\d+)[ \t]*\r?$", "\u0001$1:$2\u0002")
    parts = texts.select("path", F.posexplode(F.split(pieces, "\u0001")).alias("pos", "part")).where("pos > 0")
    head, body = F.split_part("part", F.lit("\u0002"), F.lit(1)), F.split_part("part", F.lit("\u0002"), F.lit(2))
    rows = parts.select("path", "pos", F.split_part(head, F.lit(":"), F.lit(1)).cast("int").alias("group_id"), F.split_part(head, F.lit(":"), F.lit(2)).cast("int").alias("anchor"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))
    return rows.where(F.col("group_id") == group_id).select("path", "group_id", "anchor", "text")


#: Records of a window when headings are carried on, about.
_CARRY = 2_000


def read_corpus(spark: SparkSession, path: str, group_id: int) -> DataFrame:
    """path, group_id, anchor, text: the rows of parse_corpus over files of any size; a file is many tasks' work.

    Files are split at lines that begin with `## `. What such a line begins is a section if it is an anchored heading;
    anything else goes on with the last section before it, also where that lies in another task's part of the file: records are
    numbered in the order of the files, and the last heading is carried over windows of _CARRY records.
    """
    from citewell.operators.numbering import numbered

    records = spark.read.text(path, lineSep="\n## ").select(F.col("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at")).withColumn("_m", F.monotonically_increasing_id())
    records = numbered(records, ["path", "_at", "_m"], "_n")
    opens = F.when((F.col("_at") == 0) & F.startswith("value", F.lit("## ")), F.substring(F.col("value"), F.lit(4), F.length("value"))).when(F.col("_at") >= 0, F.col("value"))
    first = F.min("_n").alias("_first")
    starts = records.groupBy("path").agg(first)
    rows = records.join(starts, "path").withColumn("_body", F.when((F.col("_n") > F.col("_first")) | F.startswith("value", F.lit("## ")), F.when(F.col("_n") > F.col("_first"), F.col("value")).otherwise(opens)))
    heading = r"^ *(\d+):(\d+)[ \t]*\r?(?:\n|$)"
    rows = rows.withColumn("_h", F.when(F.col("_body").rlike(heading), F.col("_n"))).withColumn("_block", F.floor(F.col("_n") / _CARRY))
    blocks = rows.groupBy("path", "_block").agg(F.max("_h").alias("_last"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for _CARRY records
    blocks = blocks.select("path", "_block", F.max("_last").over(earlier).alias("_before"))
    here = Window.partitionBy("path", "_block").orderBy("_n")
    carried = rows.withColumn("_own", F.max("_h").over(here)).join(blocks, ["path", "_block"]).withColumn("_s", F.coalesce("_own", "_before")).where("_s is not null")
    parts = carried.groupBy("path", "_s").agg(F.array_sort(F.collect_list(F.struct("_n", "_body"))).alias("p"))  # a section is one row
    whole = F.array_join(F.transform("p", lambda x: x["_body"]), "\n## ")
    sections = parts.select("path", whole.alias("t")).select("path", F.regexp_extract("t", heading, 1).cast("int").alias("group_id"), F.regexp_extract("t", heading, 2).cast("int").alias("anchor"), F.regexp_replace(F.regexp_replace("t", heading, ""), r"^\s+|\s+$", "").alias("text"))
    return sections.where(F.col("group_id") == group_id)


def corpus_violations(sections: DataFrame, n: int) -> DataFrame:
    """group_id, violations: of a parsed corpus that should have anchors 1..n once each, none empty."""
    spark = sections.sparkSession
    found = sections.agg(F.count("*").alias("rows"), F.count_distinct("anchor").alias("kinds"), F.count_if(~F.col("anchor").between(1, n)).alias("outside"), F.count_if(F.col("text") == "").alias("empty"))
    gaps = spark.range(1, n + 1).select(F.col("id").cast("int").alias("anchor")).join(sections.select("anchor"), "anchor", "left_anti").agg(F.count("*").alias("gaps"))
    checks = F.array(
        F.when(F.col("rows") == 0, "no headings"), F.when(F.col("rows") > F.col("kinds"), "duplicate"), F.when(F.col("outside") > 0, "out of range"), F.when(F.col("empty") > 0, "empty section"), F.when(F.col("gaps") > 0, "gap"),
    )
    return found.crossJoin(gaps).select(F.lit("corpus").alias("document_id"), F.array_compact(checks).alias("violations"))  # two tables of one row


def positional_mismatches(records: DataFrame, group_id: int) -> DataFrame:
    """Records (position from 1, key) whose key is not group:position."""
    return records.where(~F.col("key").eqNullSafe(F.concat(F.lit(f"{group_id}:"), F.col("position").cast("string"))))


def read_editions(spark: SparkSession, path: str, edition_id: int | None = None) -> DataFrame:
    """The list of editions, or the one asked for, from a file that was fetched before."""
    rows = read_json(spark, path, "editions")
    return rows.orderBy("id") if edition_id is None else rows.where(F.col("id") == edition_id)


def read_secondary(spark: SparkSession, path: str) -> DataFrame:
    """anchor, text of a second source keyed by number; an opening folded into the first text is taken off."""
    from citewell.functions.text import strip_basmala

    rows = read_json(spark, path, "keyed_texts")
    return rows.select(F.col("number").alias("anchor"), F.when(F.col("number") == 1, strip_basmala(F.col("text"))).otherwise(F.col("text")).alias("text"))


def group_sizes(spark: SparkSession, counts: list[int]) -> DataFrame:
    """The constant dimension of groups, numbered from 1."""
    return spark.createDataFrame(list(enumerate(counts, 1)), SCHEMAS["anchor_groups"])


def size_of_group(group_id, counts: list[int]):
    """The size of a group as a column: 0 out of range."""
    found = F.try_element_at(F.array(*map(F.lit, counts)), F.greatest(group_id, F.lit(1)).cast("int"))
    return F.when((group_id >= 1) & (group_id <= len(counts)), found).otherwise(0)
