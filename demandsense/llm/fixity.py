"""Merkle fixity audit of archive files: records are leaves, ordered offset ranges are nodes.

A leaf is the SHA-256 of a record; a node covers ``RANGE * FANOUT ** level`` bytes of a file and hashes its
children's places and digests in order; a file's root covers all of it.  Roots of two replicas are compared, and only
the children of nodes that differ are looked at on the next level down, to the records that are changed, missing
or extra.  Records with the same offset in a file (a broken or repeated entry) are first folded into one leaf, so
a node has at most ``RANGE`` leaves or ``FANOUT`` children whatever the data.

A tree is written by level, so the descent reads each level once and of a level only what lies under a bad node is compared.

Defined results: a null payload is empty; files or records that only one replica has are reported; extra columns
are ignored; an empty replica makes every record of the other missing.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandsense.functions.lineage import checkpoint_dir, cut

#: The root's node covers RANGE * FANOUT ** (LEVELS - 1) bytes, a tebibyte; a longer file has more than one root.
RANGE, FANOUT, LEVELS = 1 << 16, 256, 4
#: Records of a file in the archive made from a table of pages.
FILE_RECORDS = 256
#: Copies of one row that one task writes out.
COPIES = 1 << 12


def leaves(records: DataFrame) -> DataFrame:
    """file, offset, digest from columns ``file``, ``offset``, ``leaf`` (hex SHA-256 of the record): one row per offset."""
    def lane(k: int) -> Column:
        return F.sum(F.conv(F.substring("leaf", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    got = records.groupBy("file", "offset").agg(F.count("*").alias("n"), F.min("leaf").alias("one"), F.concat_ws("/", *[lane(k) for k in range(8)]).alias("sum"))
    return got.select("file", "offset", F.when(F.col("n") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws("*", F.col("n").cast("string"), "sum").cast("binary"), 256)).alias("digest"))


def nodes(leaf: DataFrame) -> DataFrame:
    """level, file, place, digest: level 0 are records (place = offset), then ranges; the last level is the root."""
    def up(children: DataFrame, level: int, place: Column) -> DataFrame:
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda k: F.concat(k["place"].cast("string"), F.lit(":"), k["digest"])), ",")
        return children.groupBy("file", place.cast("long").alias("parent")).agg(F.sha2(kids.cast("binary"), 256).alias("digest")).select(
            F.lit(level).alias("level"), "file", F.col("parent").alias("place"), "digest")
    below = leaf.select(F.lit(0).alias("level"), "file", F.col("offset").alias("place"), "digest")
    every = below
    for level in range(1, LEVELS + 1):
        below = up(below, level, F.floor(F.col("place") / (RANGE if level == 1 else FANOUT)))
        every = every.unionByName(below)
    return every


def by_level(tree: DataFrame) -> DataFrame:
    """The tree written now, a folder for each level."""
    spark = tree.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    tree.write.partitionBy("level").parquet(path)
    return spark.read.schema(tree.schema).parquet(path)


def audit(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, damage): ``roots`` has file, place, first_root, second_root; ``damage`` has file, offset, state, one row per bad offset.

    ``first`` and ``second`` have columns file, offset, leaf.  State: changed, missing (not in second) or extra.
    """
    a, b = by_level(nodes(leaves(first))), by_level(nodes(leaves(second)))

    def at(t: DataFrame, level: int, name: str) -> DataFrame:
        return t.where(F.col("level") == level).select("file", "place", F.col("digest").alias(name))
    roots = at(a, LEVELS, "first_root").join(at(b, LEVELS, "second_root"), ["file", "place"], "full")
    bad = cut(roots.where(~F.col("first_root").eqNullSafe(F.col("second_root"))).select("file", F.col("place").alias("parent")))
    for level in range(LEVELS - 1, -1, -1):
        above = F.floor(F.col("place") / (FANOUT if level else RANGE)).cast("long")

        def beneath(t: DataFrame, name: str) -> DataFrame:
            return at(t, level, name).withColumn("parent", above).join(bad, ["file", "parent"], "left_semi").drop("parent")
        seen = beneath(a, "x").join(beneath(b, "y"), ["file", "place"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
        if level:
            bad = cut(seen.select("file", F.col("place").alias("parent")))
    state = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return roots, seen.select("file", F.col("place").alias("offset"), state.alias("state"))


def record_text(url: Column, body: Column) -> Column:
    """The record as it stands in the archive: header lines, a blank line, the payload, a blank line."""
    payload, crlf = F.coalesce(body, F.lit("")), "\r\n"
    return F.concat(F.lit(f"WARC/1.1{crlf}WARC-Type: response{crlf}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{crlf}Content-Length: "),
                    F.octet_length(payload).cast("string"), F.lit(crlf * 2), payload, F.lit(crlf * 2))


def archive_pair(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas (file, offset, leaf, page_id) of an archive of ``pages``; the second with damage that its records' digests decide.

    Of the digest's fifth byte: c3 changes the payload's first character, d5 cuts its second half, e7 drops the record.
    Records go to files by a digest of id, record and copy, so files are alike in size and the copies of a page that is
    repeated many times are spread; each copy is a record with an offset of its own.
    """
    body, digest = F.coalesce(F.col("html"), F.lit("")), lambda c: F.sha2(c.cast("binary"), 256)
    whole = pages.select("page_id", "url", body.alias("body"), record_text(F.col("url"), F.col("html")).alias("record")).withColumn("leaf", digest(F.col("record")))
    kind = F.substring("leaf", 9, 2)
    hurt = F.when(kind == "c3", digest(record_text(F.col("url"), F.concat(F.lit("~"), F.substring("body", 2, 2 ** 31 - 1))))).when(
        kind == "d5", digest(record_text(F.col("url"), F.expr("left(body, length(body) div 2)")))).when(kind == "e7", F.lit(None).cast("string")).otherwise(F.col("leaf"))
    alike = whole.select("page_id", "leaf", F.octet_length("record").cast("long").alias("size"), hurt.alias("hurt")).groupBy("page_id", "leaf").agg(
        F.min("size").alias("size"), F.min("hurt").alias("hurt"), F.count("*").alias("copies"))
    # copies of a row are dealt out before they are written one by one, so no task makes more than COPIES of one row
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("page_id", "leaf", "part")
    last = F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1
    kept = cut(parts.select("page_id", "leaf", "size", "hurt", F.explode(F.sequence(F.col("part") * COPIES, last)).alias("copy")))
    files = max(1, -(-kept.count() // FILE_RECORDS))
    seat = digest(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("leaf"), F.when(F.col("copy") > 0, F.concat(F.lit(":"), F.col("copy").cast("string"))).otherwise("")))
    in_file = Window.partitionBy("file").orderBy("page_id", "leaf", "copy")
    placed = kept.withColumn("file", F.pmod(F.conv(F.substring(seat, 1, 8), 16, 10).cast("long"), F.lit(files))).withColumn(
        "offset", F.sum("size").over(in_file) - F.col("size"))
    placed = cut(placed)
    return placed.select("file", "offset", "leaf", "page_id"), placed.where("hurt is not null").select("file", "offset", F.col("hurt").alias("leaf"), "page_id")


def fixity_report(pages: DataFrame) -> DataFrame:
    """file, records, first_root, second_root, n_bad, bad (``offset:state`` of each bad record in order), one row per file."""
    first, second = archive_pair(pages)
    roots, damage = audit(first, second)
    size = first.groupBy("file").agg(F.count("*").alias("records"))
    told = damage.groupBy("file").agg(F.count("*").alias("n_bad"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "state"))), lambda d: F.concat_ws(":", d["offset"].cast("string"), d["state"])), ",").alias("bad"))
    out = roots.join(size, "file", "left").join(told, "file", "left")
    return out.select("file", F.coalesce("records", F.lit(0)).alias("records"), "first_root", "second_root", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.coalesce("bad", F.lit("")).alias("bad"))
