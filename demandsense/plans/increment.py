"""Take in only what changed since the last run.

A run lists the raw files with their SHA-256 and compares the list with the manifest of the last run.  Files that are new or
changed are read and replace their own partition of the table (``source``, from the path); the others stay as they are.  The
manifest, written last as a new version, says which sources count, so a removed file's rows are gone with the next
manifest and a run that fails leaves the table of the last one readable: partitions are named by path and content.

Defined results: a file that was renamed is one removed and one new file; without any change nothing is read or written
but the manifest; an empty folder gives an empty manifest and no table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.sources import feeds

MANIFEST = "path string, length long, sha256 string"


def source_of(path: Column, sha256: Column) -> Column:
    """The partition of a file with this content."""
    return F.hex(F.xxhash64(path, sha256))


def last_manifest(spark: SparkSession, out: str) -> tuple[int, DataFrame]:
    """(version, manifest) of the last run; version 0 and no rows before the first."""
    every = feeds.existing_table(spark, f"{out}/manifest")
    top = None if every is None else every.agg(F.max("version").alias("v")).first()["v"]
    if top is None:
        return 0, spark.createDataFrame([], MANIFEST)
    return top, every.where((F.col("version") == top) & F.col("path").isNotNull()).select("path", "length", "sha256")


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, sha256 (now, else before), state: added, changed, removed or same."""
    a, b = before.select("path", F.col("sha256").alias("__a")), now.select("path", F.col("sha256").alias("__b"))
    state = (F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed").otherwise("same"))
    return a.join(b, "path", "full").select("path", F.coalesce("__b", "__a").alias("sha256"), state.alias("state"))


def sync(spark: SparkSession, raw: str, out: str, read: Callable[[list[str]], DataFrame], glob: str = "*.parquet") -> DataFrame:
    """Bring ``out`` up to date with the files under ``raw``; returns the differences.

    ``read`` turns a list of paths into rows and must keep the hidden column ``_metadata``.
    """
    version, before = last_manifest(spark, out)
    now = cut(feeds.file_manifest(spark, raw, glob))
    diff = cut(manifest_diff(before, now))
    fresh = [r["path"] for r in diff.where(F.col("state").isin("added", "changed")).select("path").collect()]  # a reader takes its paths from the driver
    if fresh:
        rows = read(fresh)
        named = diff.select(F.col("path").alias("__path"), source_of(F.col("path"), F.col("sha256")).alias("source"))
        rows = rows.withColumn("__path", F.col("_metadata.file_path")).join(named, "__path").drop("__path")
        feeds.write_blocks(rows, f"{out}/table", "source")
    listed = now.withColumn("version", F.lit(version + 1))
    if listed.isEmpty():  # a version without files is a row without a path
        listed = spark.createDataFrame([(None, None, None, version + 1)], f"{MANIFEST}, version int")
    feeds.write_blocks(listed, f"{out}/manifest", "version")
    return diff


def table(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the files in the last manifest."""
    _, now = last_manifest(spark, out)
    wanted = now.select(source_of(F.col("path"), F.col("sha256")).alias("source"))
    return spark.read.option("basePath", f"{out}/table").parquet(f"{out}/table").join(wanted, "source", "left_semi").drop("source")
