"""Feed scans and sinks: Parquet and CSV in; tables, quarantine, manifests, metrics out."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.functions.numeric import nan_to_null
from demandsense.functions.text import escape_formula_columns
from demandsense.operators.contracts import Contract


def read_parquet_feed(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Columnar scan of a table or of some files; filters and column pruning reach the files through Catalyst.  NaN is read as missing."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return without_nan(reader.parquet(*([path] if isinstance(path, str) else path)))


def existing_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where none was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with NULL for NaN; other columns and hidden metadata stay as they are."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(c).cast(df.schema[c].dataType) for c in floating}) if floating else df


def read_csv_feed(spark: SparkSession, path: str, contract: Contract, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV scan with declared types; lines that do not parse keep their text in
    ``_corrupt_record`` instead of being lost."""
    schema = contract.schema().add("_corrupt_record", "string")
    return (spark.read.schema(schema).option("header", True).option("dateFormat", date_format)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path).transform(without_nan))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, quarantined lines with reason ``unparsed``)."""
    bad = df.where(F.col("_corrupt_record").isNotNull())
    good = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, bad.withColumn("reason", F.lit("unparsed"))


def with_ingest_order(df: DataFrame, out: str = "ingest_ord") -> DataFrame:
    """Feed order of a Parquet scan: (file, row position in the file), stable under retries."""
    return df.withColumn(out, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_blocks(df: DataFrame, path: str, by: str = "block") -> None:
    """A table partitioned by ``by``; partitions that ``df`` holds are replaced, all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_split(annotated: DataFrame, clean_path: str, quarantine_path: str) -> None:
    """Write both sides of an annotated feed."""
    annotated.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(clean_path)
    annotated.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(quarantine_path)


def write_csv_export(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets, formula-like cells neutralised."""
    escape_formula_columns(df).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long (metric, key, value) rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 per file (binaryFile holds one file per row, up to 2 GB each)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame, *keys: Column) -> DataFrame:
    """Order-free content fingerprint of a table of any size: row count and the sum of
    row hashes (as decimal, so it cannot overflow)."""
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    agg = [F.count(F.lit(1)).alias("rows"), F.sum(row_hash).alias("hash_sum")]
    return df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)


def recent_history(panel: DataFrame, last_day: int, days: int = 91, values: tuple[str, ...] = ("units",),
                   node: str = "node_id") -> DataFrame:
    """Long (date, node, measure, value) rows of the last ``days`` days, missing dropped."""
    recent = panel.where(F.col("day_idx").between(last_day - days + 1, last_day))
    ids = [F.col("date"), F.col(node)]
    return (recent.select(*ids, *[F.col(v).cast("double") for v in values])
            .unpivot(["date", node], list(values), "measure", "value").where("value IS NOT NULL"))
