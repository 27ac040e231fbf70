"""Hierarchical reconciliation on a strict tree, without node x node matrices.

With independent node errors the generalised least squares problem on a tree is solved by
one pass up (children combine their estimates) and one pass down (parents hand back what
is left).  A shrunk full covariance adds a low-rank part whose size is the number of
backtest cases; only that small system reaches the driver.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandsense.functions.lineage import cut
from demandsense.operators.hierarchy import LEVELS
from demandsense.operators.order_stats import group_median

CASE = ["origin", "day"]
NODE = ["node_id", "parent_id", "level", "path"]
MIN_SD, SD_SHARE = 1e-3, 0.05


def assemble(tree: DataFrame, cases: Sequence[tuple[int, int]], forecasts: DataFrame, value: str = "base") -> DataFrame:
    """(node_id, parent_id, level, path, origin, day, yhat): every node in every case; a node
    without a forecast counts as 0 (not launched yet)."""
    grid = F.array(*[F.struct(F.lit(int(o)).alias("origin"), F.lit(int(d)).alias("day")) for o, d in cases])
    nodes = tree.select("*", F.explode(grid).alias("c")).select(*NODE, "c.origin", "c.day")
    fc = forecasts.select("node_id", *CASE, F.col(value).alias("yhat"))
    return (nodes.join(fc, ["node_id", *CASE], "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0))))


def bottom_up(base: DataFrame, value: str = "yhat", out: str = "bottom_up", case: Sequence[str] = CASE) -> DataFrame:
    """(node_id, level, case, value): leaf values summed at every node.

    Each leaf row is expanded along its path and summed in one partial aggregation, so the
    root is combined on the map side."""
    leaves = base.where(F.col("level") == LEVELS[-1]).select(F.posexplode("path").alias("__i", "node_id"), *case, value)
    level = F.array(*[F.lit(lv) for lv in LEVELS])[F.col("__i")]
    return leaves.groupBy("node_id", level.alias("level"), *case).agg(F.sum(value).alias(out))


def non_negative(df: DataFrame, value: str, case: Sequence[str] = CASE) -> DataFrame:
    """Clip the leaves at 0 and sum again, so the result stays coherent."""
    return bottom_up(df.withColumn(value, F.greatest(F.col(value), F.lit(0.0))), value, value, case)


def tree_gls(base: DataFrame, weights: DataFrame, value: str = "yhat", out: str = "reconciled",
             case: Sequence[str] = CASE) -> DataFrame:
    """Least-squares coherent values for error variances ``weights`` (node_id, w).

    The leaf level is read twice (once up, once down).  What it sends up and what comes back
    down are written tables of one row per lowest aggregate node and case.
    """
    rows = base.select(*NODE, *case, F.col(value).alias("y")).join(weights, "node_id")
    none = F.lit(None).cast("double")
    leaf = LEVELS[-1]
    up = {leaf: rows.where(F.col("level") == leaf).select(*NODE, *case, F.col("y").alias("m"), F.col("w").alias("v"),
                                                         none.alias("mc"), none.alias("vc"))}
    for child, level in zip(reversed(LEVELS[1:]), reversed(LEVELS[:-1])):
        kids = up[child].groupBy(F.col("parent_id").alias("node_id"), *case).agg(F.sum("m").alias("mc"), F.sum("v").alias("vc"))
        v = 1.0 / (1.0 / F.col("vc") + 1.0 / F.col("w"))
        up[level] = rows.where(F.col("level") == level).join(kids, ["node_id", *case]).select(
            *NODE, *case, (v * (F.col("mc") / F.col("vc") + F.col("y") / F.col("w"))).alias("m"), v.alias("v"), "mc", "vc")
        if child == leaf:
            up[level] = cut(up[level])
    cols = [*NODE, *case, out, "mc", "vc"]
    down = up[LEVELS[0]].withColumn(out, F.col("m")).select(*cols)
    done = down
    for level in LEVELS[1:]:
        parent = down.select(F.col("node_id").alias("parent_id"), *case, F.col(out).alias("__f"), F.col("mc").alias("__mc"), F.col("vc").alias("__vc"))
        down = up[level].join(parent, ["parent_id", *case]).withColumn(
            out, F.col("m") + F.col("v") / F.col("__vc") * (F.col("__f") - F.col("__mc"))).select(*cols)
        if level == LEVELS[-2]:
            down = cut(down)
        done = done.unionByName(down)
    return done.select(*NODE, *case, out)


def coherence_error(df: DataFrame, tree: DataFrame, value: str, case: Sequence[str] = CASE) -> DataFrame:
    """One row: largest |sum of leaves - node|."""
    df = df.select("node_id", "level", *case, value)
    sums = bottom_up(df.join(tree.select("node_id", "path"), "node_id"), value, "__sum", case).select("node_id", *case, "__sum")
    return df.join(sums, ["node_id", *case]).agg(F.max(F.abs(F.col(value) - F.col("__sum"))).alias("coherence_error"))


def residuals(base: DataFrame, actuals: DataFrame) -> DataFrame:
    """(node_id, origin, day, e): actual minus forecast, 0 where the actual is missing."""
    act = actuals.select("node_id", "day", F.col("y").alias("__y"))
    return base.join(act, ["node_id", "day"], "left").select("node_id", *CASE, F.coalesce(F.col("__y") - F.col("yhat"), F.lit(0.0)).alias("e"))


def residual_scale(res: DataFrame) -> DataFrame:
    """(node_id, mean_e, sd): sample sd with a floor of 5 % of the median positive sd."""
    st = cut(res.groupBy("node_id").agg(F.avg("e").alias("mean_e"), F.stddev_samp("e").alias("__sd")))
    floor = group_median(st.where("__sd > 0"), [], "__sd", "__med").agg(
        F.greatest(F.lit(MIN_SD), F.coalesce(SD_SHARE * F.max("__med"), F.lit(MIN_SD))).alias("__floor"))
    return st.join(F.broadcast(floor)).select("node_id", "mean_e", F.greatest("__sd", "__floor").alias("sd"))   # one row


def variance_weights(scale: DataFrame) -> DataFrame:
    return scale.select("node_id", (F.col("sd") ** 2).alias("w"))


def case_vectors(res: DataFrame, scale: DataFrame, case: Sequence[str] = CASE) -> DataFrame:
    """(node_id, sd, z): standardised residuals of a node, one entry per case in case order.
    A node has as many entries as there are backtest cases."""
    z = (F.col("e") - F.col("mean_e")) / F.col("sd")
    rows = res.join(scale, "node_id").select("node_id", "sd", F.struct(*case, z.alias("z")).alias("c"))
    return rows.groupBy("node_id").agg(F.first("sd").alias("sd"), F.transform(F.array_sort(F.collect_list("c")), lambda c: c["z"]).alias("z"))


def cross_products(df: DataFrame, left: str, right: str) -> DataFrame:
    """(k, l, g): sum over nodes of left[k] * right[l].

    Each task multiplies its own nodes' vectors and emits one small matrix; the shuffle sees
    cases x cases values per task, never pairs per node."""
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = np.stack(pdf[left].to_numpy()).T @ np.stack(pdf[right].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            k, l = np.indices(total.shape)
            yield pd.DataFrame({"k": k.ravel(), "l": l.ravel(), "g": total.ravel()})

    parts = df.select(left, F.col(right).alias(right if right != left else "__r")).mapInPandas(
        _with_names(products, left, right), "k int, l int, g double")
    return parts.groupBy("k", "l").agg(F.sum("g").alias("g"))


def _with_names(fn, left, right):
    if right != left:
        return fn

    def renamed(batches):
        return fn(pdf.assign(**{right: pdf[left]}) for pdf in batches)
    return renamed


def shrinkage(vectors: DataFrame, n_cases: int) -> DataFrame:
    """One row (lambda, sum_r2): Schafer-Strimmer shrinkage intensity of the residual
    correlation, from the case x case Gram matrix only."""
    n = float(n_cases)
    sq = F.aggregate(F.col("z"), F.lit(0.0), lambda a, x: a + x * x)
    quad = F.aggregate(F.col("z"), F.lit(0.0), lambda a, x: a + x * x * x * x)
    per = vectors.agg(F.sum(sq * sq).alias("own"), F.sum(quad).alias("z4"))
    gram = cross_products(vectors, "z", "z").agg(
        F.sum(F.col("g") ** 2).alias("norm"), F.sum(F.when(F.col("k") == F.col("l"), F.col("g") ** 2)).alias("diag"))
    both = gram.join(F.broadcast(per))                        # one row each
    off = F.col("norm") - F.col("own")
    r2, w2, s2 = off / (n - 1) ** 2, off / n**2, F.col("diag") - F.col("z4")
    lam = n / (n - 1) ** 3 * (s2 - n * w2) / F.greatest(r2, F.lit(1e-12))
    return both.select(F.least(F.greatest(lam, F.lit(0.0)), F.lit(1.0)).alias("lambda"), r2.alias("sum_r2"))


def mint_shrink(base: DataFrame, res: DataFrame, cal_cases: Sequence[tuple[int, int]], cases: Sequence[tuple[int, int]]) -> DataFrame:
    """Reconcile with the shrunk full covariance W = D + LL'.

    T below is the tree pass with variances D.  The only dense object is a system with one
    row per calibration case, solved on the driver.
    """
    spark = base.sparkSession
    n = len(cal_cases)
    scale = residual_scale(res)
    vec = cut(case_vectors(res, scale))
    lam = float(shrinkage(vec, n).first()["lambda"])
    gain = float(np.sqrt((1 - lam) / (n - 1)))
    own = F.aggregate(F.col("z"), F.lit(0.0), lambda a, x: a + x * x) / (n - 1)
    d = F.col("sd") ** 2 * F.greatest(1 - (1 - lam) * own, F.lit(1e-12))
    low = cut(vec.select("node_id", d.alias("w"), F.transform("z", lambda x: x * F.col("sd") * gain).alias("l")))
    weights = low.select("node_id", "w")
    tree = base.select(*NODE).distinct()

    # columns of L pass through the tree like forecasts, one "case" per column
    cols = low.select("node_id", F.posexplode("l").alias("k", "yhat")).join(tree, "node_id")
    passed = tree_gls(cols, weights, "yhat", "t", ["k"])
    tl = passed.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda c: c["t"]).alias("tl"))
    ty = tree_gls(base, weights, "yhat", "t").join(base.select("node_id", *CASE, "yhat"), ["node_id", *CASE])
    dy = ty.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*CASE, (F.col("yhat") - F.col("t")).alias("x")))),
                                               lambda c: c["x"]).alias("dy"))
    all_ = cut(low.join(tl, "node_id").join(dy, "node_id").select(
        "node_id", F.transform("l", lambda x: x / F.col("w")).alias("lw"), "l",
        F.zip_with("l", "tl", lambda a, b: a - b).alias("dl"), "dy"))
    a = np.eye(n) + _matrix(cross_products(all_, "lw", "dl"), n, n)
    b = _matrix(cross_products(all_, "lw", "dy"), n, len(cases))
    f = _solve(a, b)                                           # cases x cases

    order = sorted((int(o), int(dd)) for o, dd in cases)
    moves = spark.createDataFrame([(o, dd, [float(x) for x in f[:, j]]) for j, (o, dd) in enumerate(order)],
                                  "origin int, day int, f array<double>")
    shift = F.aggregate(F.zip_with("l", "f", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    moved = (base.join(F.broadcast(moves), CASE).join(low.select("node_id", "l"), "node_id")   # one row per case
             .withColumn("yhat", F.col("yhat") - shift).drop("f", "l"))
    return tree_gls(moved, weights, "yhat", "reconciled")


def _matrix(cells: DataFrame, rows: int, cols: int) -> np.ndarray:
    """Small dense matrix (cases x cases) from its (k, l, g) cells."""
    out = np.zeros((rows, cols))
    pdf = cells.toPandas()
    out[pdf["k"], pdf["l"]] = pdf["g"]
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with partial pivoting, one vector operation per pivot: the system has one
    row per case and must not start a second thread pool beside the driver's."""
    m = np.hstack([a, b])
    n = len(a)
    for i in range(n):
        p = i + int(np.argmax(np.abs(m[i:, i])))
        m[[i, p]] = m[[p, i]]
        m[i] /= m[i, i]
        rows = np.arange(n) != i
        m[rows] -= m[rows, i][:, None] * m[i][None, :]
    return m[:, n:]


def node_forecasts(base: DataFrame, reconciled: DataFrame, actuals: DataFrame) -> DataFrame:
    """(node_id, level, origin, day, base, reconciled, y) of the aggregate nodes."""
    return (base.where(F.col("level") != LEVELS[-1]).select("node_id", "level", *CASE, F.col("yhat").alias("base"))
            .join(reconciled.select("node_id", *CASE, "reconciled"), ["node_id", *CASE])
            .join(actuals.select("node_id", "day", "y"), ["node_id", "day"], "left"))
