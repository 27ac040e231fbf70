"""Order review loop: validate decisions, guard them, append them, read the view."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandsense.functions.lineage import cut
from demandsense.operators import decisions as D
from demandsense.operators.contracts import Rule
from demandsense.sources import feeds

#: A decision that came before, in the same file, another file or an earlier run.
REPEATED = "repeated_id"


def process_decisions(incoming: DataFrame, orders: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every incoming decision with its outcome (``reason`` is NULL when accepted)."""
    return D.guard_decisions(D.validate_decisions(incoming, rules), orders)


def append_batch(incoming: DataFrame, number: int, orders: DataFrame, rules: Sequence[Rule], log: str, version: str) -> None:
    """Write the outcome of every decision of a batch to the log, as the log's partition ``batch=number``.

    A batch that is tried again replaces its own partition, so nothing is written twice.  Of decisions with one id the first (by
    ``ts``, then content) is judged; the others, and ids that an earlier batch holds, get the reason ``repeated_id``.
    """
    first = Window.partitionBy("id").orderBy("ts", *[c for c in incoming.columns if c not in ("id", "ts")])
    rows = incoming.withColumn("__nth", F.row_number().over(first))
    log_rows = feeds.existing_table(incoming.sparkSession, log)
    if log_rows is not None:
        known = log_rows.where(F.col("batch") < number).select("id").distinct().withColumn("__known", F.lit(True))
        rows = rows.join(known, "id", "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("boolean"))
    rows = cut(rows.withColumn("__again", (F.col("__nth") > 1) | F.coalesce("__known", F.lit(False))).drop("__nth", "__known"))
    judged = process_decisions(rows.where(~F.col("__again")).drop("__again"), orders, rules)
    again = rows.where("__again").drop("__again").withColumn("reason", F.lit(REPEATED)).withColumn("final_qty", F.lit(None).cast("bigint"))
    out = judged.unionByName(again, allowMissingColumns=True).withColumns({"model_version": F.lit(version), "batch": F.lit(number)})
    feeds.write_blocks(out, log, "batch")


def append_stream(spark: SparkSession, incoming: str, schema: T.StructType, orders: DataFrame, rules: Sequence[Rule], log: str, state: str, version: str) -> None:
    """Take in every file of ``incoming`` that ``state`` has not seen, then stop; a restart goes on where the last one ended."""
    stream = spark.readStream.schema(schema).parquet(incoming)
    writer = stream.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, orders, rules, log, version))
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def decision_log(spark: SparkSession, log: str) -> DataFrame:
    """The accepted decisions of a log."""
    return spark.read.parquet(log).where("reason IS NULL")
