"""Five-level hierarchy: nodes, membership, aggregate panel.

total -> region -> store -> store x category -> item x store, a strict tree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level names, top first.
LEVELS = ["total", "region", "store", "store_category", "item_store"]


def ancestor_ids() -> list[tuple[str, Column]]:
    """(level, node id) expressions from the top down for a leaf row."""
    return [("total", F.lit("total")),
            ("region", F.concat(F.lit("R:"), F.col("region"))),
            ("store", F.concat(F.lit("S:"), F.col("store_id"))),
            ("store_category", F.concat(F.lit("SC:"), F.col("store_id"), F.lit("|"), F.col("category")))]


def membership(series: DataFrame, leaf: str = "node_id") -> DataFrame:
    """(node_id, level, leaf_id): every node with the leaves under it, leaf itself included."""
    path = [*ancestor_ids(), ("item_store", F.col(leaf))]
    nodes = F.array(*[F.struct(F.lit(lv).alias("level"), e.alias("node_id")) for lv, e in path])
    return (series.select(F.col(leaf).alias("leaf_id"), F.explode(nodes).alias("n"))
            .select("n.node_id", "n.level", "leaf_id"))


def tree_edges(series: DataFrame, leaf: str = "node_id") -> DataFrame:
    """(node_id, parent_id, level, path): one row per node; the root has no parent and
    ``path`` lists the ids from the root down to the node."""
    path = [*ancestor_ids(), ("item_store", F.col(leaf))]
    pairs = F.array(*[
        F.struct(e.alias("node_id"), (path[i - 1][1] if i else F.lit(None).cast("string")).alias("parent_id"),
                 F.lit(lv).alias("level"), F.array(*[p for _, p in path[:i + 1]]).alias("path"))
        for i, (lv, e) in enumerate(path)])
    return series.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def aggregate_panel(panel: DataFrame) -> DataFrame:
    """Node-day rows of the four aggregate levels from a leaf panel.

    y is the sum of observed leaves (NULL only when all are missing), disc the mean over
    leaves with an observed y (0 if none).  One expand plus one partial aggregation: the
    total node is combined on the map side, so no task sees all leaves of a day.
    """
    nodes = F.array(*[F.struct(F.lit(lv).alias("level"), e.alias("node_id")) for lv, e in ancestor_ids()])
    rows = panel.select(F.explode(nodes).alias("n"), "day_idx", "y", "disc").select("n.*", "day_idx", "y", "disc")
    return (rows.groupBy("level", "node_id", "day_idx")
            .agg(F.sum("y").alias("y"),
                 F.coalesce(F.avg(F.when(F.col("y").isNotNull(), F.col("disc"))), F.lit(0.0)).alias("disc"))
            .withColumn("stockout", F.lit(False)).withColumn("post_promo", F.lit(0)))


def node_attributes(series: DataFrame, leaf: str = "node_id") -> DataFrame:
    """Static attributes of the aggregate nodes: mean price and pack size, child count."""
    members = membership(series, leaf).where("level <> 'item_store'")
    leaves = series.select(F.col(leaf).alias("leaf_id"), "price", "pack_size")
    return (members.join(leaves, "leaf_id").groupBy("node_id", "level")
            .agg(F.avg("price").alias("price"), F.avg("pack_size").alias("pack_size"),
                 F.count(F.lit(1)).alias("n_children"))
            .withColumn("level_idx", F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")).cast("int") - 1)
            .withColumn("launch_idx", F.lit(0)))
