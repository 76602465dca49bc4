"""WARC fixity audit by Merkle trees over ordered offset ranges.

Each record of an archive is hashed with its place. Records are gathered into the offset range in which they
begin, ranges into ranges FANOUT times as wide, up to one root an archive; a node's hash covers its children in
the order of their offsets. Replicas are compared from the roots down: at each level only the children of nodes
that differ are looked at, and only records in differing ranges are compared one by one.

Scale: contents are hashed where they are read and not moved; the tables of records and nodes hold hashes and
places. Node hashes are aggregates by (archive, range), so a large archive is many groups; a range holds at most
as many records as fit into SPAN bytes. Nothing is collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.common import keep

#: Width in bytes of the narrowest ranges, children of a node (as a power of two), and levels of ranges.
SPAN, FANOUT_BITS, LEVELS = 1 << 14, 4, 5
#: Pages that go into one archive.
PAGES = 200


def record_bytes(url: Column, page_id: Column, html: Column) -> Column:
    """A page as a WARC response record: header lines, an empty line, the content, two line ends."""
    end = F.lit("\r\n")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), end,
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"), end,
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(F.coalesce(html, F.lit(""))).cast("string"), end, end,
        F.coalesce(html, F.lit("")), end, end,
    )


def archived(pages: DataFrame, page_id="page_id", url="url", html="html", per_archive=PAGES) -> DataFrame:
    """The pages written one after the other into archives of per_archive consecutive ids.

    archive, offset, length, sha256, page_id of each record. Null url and html count as empty; pages without an id
    are dealt by their hash into archives of their own, -1 and below, of about per_archive records. Repeated rows
    follow each other; pages of one id are ordered by their hash. An empty table gives no rows.
    """
    record = record_bytes(F.col(url), F.col(page_id), F.col(html))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("sha256"))
    return _placed(rows, "sha256", "length", per_archive).select("archive", "offset", "length", "sha256", "page_id")


def _placed(rows: DataFrame, order: str, size: str, per_archive: int) -> DataFrame:
    """rows with their archive and offset: the `size` of all earlier records, by page_id and then by the hash `order`.

    Running sums come from sums by (page, first two digits of the hash) plus a window inside one of these, so an id
    that very many pages share is dealt over 256 windows; equal rows are one row of the windows with a count.
    """
    spread = keep(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "fixity-records")
    lost = spread.where("page_id is null").agg(F.sum("_n")).first()[0] or 0
    own = F.floor(F.col("page_id") / per_archive)
    nowhere = -1 - F.pmod(F.conv(F.substring(order, -8, 8), 16, 10).cast("long"), F.lit(max(1, lost // per_archive)))
    spread = spread.withColumn("archive", F.coalesce(own, nowhere).cast("long")).withColumn("_p", F.substring(order, 1, 2)).withColumn("_of", F.coalesce("page_id", F.lit(0)))
    at = ["archive", "_of", "_p"]
    sums = spread.groupBy(*at).agg(F.sum(F.col(size) * F.col("_n")).alias("_s"))
    before = Window.partitionBy("archive").orderBy("_of", "_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*at, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("_here", F.coalesce(F.sum(F.col(size) * F.col("_n")).over(here), F.lit(0))).join(sums, at)
    copies = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    offset = F.col("_before") + F.col("_here") + F.col("_copy") * F.col(size)
    return copies.withColumn("offset", offset.cast("long")).drop("_n", "_p", "_of", "_before", "_here", "_copy")


def _ordered_hash(place: str, value: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("a"), F.col(value).alias("b"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["b"]), "").cast("binary"), 256)


def leaf_hash() -> Column:
    return F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("sha256")).cast("binary"), 256)


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of nodes from the narrowest ranges to the roots: archive, node (ordinal of its range), hash."""
    leaves = records.select("archive", "offset", leaf_hash().alias("hash")).withColumn("node", F.floor(F.col("offset") / SPAN).cast("long"))
    level = keep(leaves.groupBy("archive", "node").agg(_ordered_hash("offset", "hash").alias("hash")), "fixity-ranges")
    levels = [level]
    for _ in range(LEVELS - 1):
        up = level.withColumn("up", F.shiftright("node", FANOUT_BITS)).groupBy("archive", F.col("up").alias("node"))
        level = keep(up.agg(_ordered_hash("node", "hash").alias("hash")), "fixity-ranges")  # each level is hashed once
        levels.append(level)
    return [*levels, level.groupBy("archive").agg(_ordered_hash("node", "hash").alias("hash")).withColumn("node", F.lit(0).cast("long"))]


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("hash", "primary_hash").join(b.withColumnRenamed("hash", "replica_hash"), ["archive", "node"], "full_outer")
    return both.where(~F.col("primary_hash").eqNullSafe(F.col("replica_hash")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two replicas differ: archive, offset, page_id, kind, lengths, hashes and the archive's roots.

    Both tables have archive, offset, length, sha256 and page_id. kind is `altered`, `missing` (not in the replica)
    or `extra` (only there). A whole archive that one side lacks is found by its root. Records at one and the same
    place are compared as a multiset: equal ones cancel out as often as both sides have them, and those left are
    paired by (length, hash); a pair is one altered record. Equal tables, and empty ones, give no rows. Lengths and
    hashes are not null.
    """
    a, b = tree(primary), tree(replica)
    roots = keep(_differ(a[-1], b[-1]).select("archive", F.col("primary_hash").alias("primary_root"), F.col("replica_hash").alias("replica_root")), "fixity-roots")
    bad = roots.select("archive")
    for k in range(LEVELS - 1, -1, -1):
        if k == LEVELS - 1:
            below = lambda nodes, bad=bad: nodes.join(bad, "archive", "left_semi")
        else:
            up = bad.select("archive", F.col("node").alias("up"))
            below = lambda nodes, up=up: nodes.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(up, ["archive", "up"], "left_semi").drop("up")
        bad = keep(_differ(below(a[k]), below(b[k])).select("archive", "node"), "fixity-differing")
    at = ["archive", "offset"]

    def in_bad(records: DataFrame, side: str) -> DataFrame:
        """Records of differing ranges with how often each occurs."""
        near = records.withColumn("node", F.floor(F.col("offset") / SPAN).cast("long")).join(bad, ["archive", "node"], "left_semi")
        return near.groupBy(*at, "length", "sha256").agg(F.count("*").alias(f"{side}_n"), F.min("page_id").alias(f"{side}_page"))

    counted = in_bad(primary, "primary").join(in_bad(replica, "replica"), [*at, "length", "sha256"], "full_outer")
    more = F.coalesce("primary_n", F.lit(0)) - F.coalesce("replica_n", F.lit(0))  # what one side has beyond the other
    surplus = keep(counted.withColumn("more", more).where("more <> 0"), "fixity-surplus")

    def left(side: str, sign: int) -> DataFrame:
        own = surplus.where(F.col("more") * sign > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("more"))))
        here = Window.partitionBy(*at).orderBy("length", "sha256", "copy")
        return own.select(*at, F.row_number().over(here).alias("rank"), F.col("length").alias(f"{side}_length"), F.col("sha256").alias(f"{side}_sha256"), f"{side}_page")

    both = left("primary", 1).join(left("replica", -1), [*at, "rank"], "full_outer")
    kind = F.when(F.col("replica_length").isNull(), "missing").when(F.col("primary_length").isNull(), "extra").otherwise("altered")
    return both.join(roots, "archive").select(
        "archive", "offset", F.coalesce("primary_page", "replica_page").alias("page_id"), kind.alias("kind"), "primary_length", "replica_length", "primary_sha256", "replica_sha256", "primary_root", "replica_root"
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A stand-in for a second replica with faults at pages that a checksum of the id picks: archive to page_id as archived().

    Of 211 remainders, 7 loses its last character to `#`, 11 is lost as a record, 13 is cut in half, and 17 has a
    stray record one byte after it. Offsets are those of the intact archive, as in a file with bad blocks.
    """
    pick = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % 211
    html = F.coalesce(F.col("html"), F.lit(""))
    bad = F.when(pick == 7, F.concat(html.substr(F.lit(1), F.greatest(F.length(html) - 1, F.lit(0))), F.lit("#"))).when(pick == 13, html.substr(F.lit(1), F.floor(F.length(html) / 2).cast("int"))).otherwise(html)
    kept = pages.select("page_id", "url", "html", bad.alias("bad"), pick.alias("pick"))
    whole = record_bytes(F.col("url"), F.col("page_id"), F.col("html"))
    found = record_bytes(F.col("url"), F.col("page_id"), F.col("bad"))
    rows = kept.select(
        F.col("page_id").cast("long").alias("page_id"), "pick", F.octet_length(whole).cast("long").alias("whole"), F.sha2(whole.cast("binary"), 256).alias("order"), F.octet_length(found).cast("long").alias("length"), F.sha2(found.cast("binary"), 256).alias("sha256")
    )
    placed = _placed(rows, "order", "whole", PAGES)
    copies = F.when(F.col("pick") == 11, F.array().cast("array<int>")).when(F.col("pick") == 17, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return placed.withColumn("stray", F.explode(copies)).select("archive", (F.col("offset") + F.col("stray")).alias("offset"), "length", "sha256", "page_id")


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = audit(keep(archived(pages), "fixity-primary"), keep(damaged(pages), "fixity-replica"))
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("primary_length", "replica_length")})  # -1: no such record


def _oracle() -> str:
    levels = []
    for k in range(1, LEVELS):
        levels.append(f"n{k} AS (SELECT side, archive, node >> {FANOUT_BITS} AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM n{k - 1} GROUP BY side, archive, node >> {FANOUT_BITS})")
    record = lambda html: f"'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode({html})) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10)"
    return f"""
WITH checks AS (SELECT page_id, url, coalesce(html, '') AS html, crc32_of.c % 211 AS pick FROM pages JOIN ({CRC32_SQL}) crc32_of USING (page_id)),
written AS (SELECT *, CASE pick WHEN 7 THEN left(html, greatest(length(html) - 1, 0)) || '#' WHEN 13 THEN left(html, CAST(floor(length(html) / 2) AS BIGINT)) ELSE html END AS bad FROM checks),
records AS (SELECT page_id, pick, CAST(floor(page_id / {PAGES}) AS BIGINT) AS archive, {record('html')} AS whole, {record('bad')} AS found FROM written),
placed AS (SELECT page_id, pick, archive, octet_length(encode(whole)) AS wl, sha256(whole) AS ws, octet_length(encode(found)) AS fl, sha256(found) AS fs,
  CAST(coalesce(sum(octet_length(encode(whole))) OVER (PARTITION BY archive ORDER BY page_id, sha256(whole) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM records),
sides AS (
  SELECT 'p' AS side, archive, "offset", wl AS length, ws AS sha256, page_id FROM placed
  UNION ALL SELECT 'r', archive, "offset", fl, fs, page_id FROM placed WHERE pick <> 11
  UNION ALL SELECT 'r', archive, "offset" + 1, fl, fs, page_id FROM placed WHERE pick = 17),
leaves AS (SELECT *, sha256("offset" || ':' || length || ':' || sha256) AS leaf FROM sides),
n0 AS (SELECT side, archive, "offset" // {SPAN} AS node, sha256(string_agg(leaf, '' ORDER BY "offset")) AS hash FROM leaves GROUP BY side, archive, "offset" // {SPAN}),
{', '.join(levels)},
roots AS (SELECT side, archive, sha256(string_agg(hash, '' ORDER BY node)) AS root FROM n{LEVELS - 1} GROUP BY side, archive),
p AS (SELECT * FROM leaves WHERE side = 'p'), r AS (SELECT * FROM leaves WHERE side = 'r'),
both_sides AS (SELECT coalesce(p.archive, r.archive) AS archive, coalesce(p."offset", r."offset") AS "offset", coalesce(p.page_id, r.page_id) AS page_id,
  CASE WHEN r.leaf IS NULL THEN 'missing' WHEN p.leaf IS NULL THEN 'extra' ELSE 'altered' END AS kind,
  coalesce(p.length, -1) AS primary_length, coalesce(r.length, -1) AS replica_length, p.sha256 AS primary_sha256, r.sha256 AS replica_sha256
  FROM p FULL OUTER JOIN r ON p.archive = r.archive AND p."offset" = r."offset" WHERE p.leaf IS DISTINCT FROM r.leaf)
SELECT b.*, rp.root AS primary_root, rr.root AS replica_root FROM both_sides b
LEFT JOIN roots rp ON rp.side = 'p' AND rp.archive = b.archive LEFT JOIN roots rr ON rr.side = 'r' AND rr.archive = b.archive"""


#: crc32 in SQL: a fold over the id's digits with the standard reflected polynomial, four bits at a time.
CRC32_SQL = """
SELECT page_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) AS c FROM pages"""

ORACLE = _oracle()
