"""Consensus of several methods' proportion estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def common_spots(props: DataFrame, n_methods: int) -> DataFrame:
    """Rows of spots that every method has."""
    shared = props.groupBy("spot_id").agg(F.countDistinct("method").alias("k")).where(F.col("k") == n_methods).select("spot_id")
    return props.join(shared, "spot_id", "left_semi")


def weighted_median(rows: DataFrame, by: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Per group the least value at which the weights up to it reach half of their sum."""
    up = Window.partitionBy(*by).orderBy(value)
    share = F.sum(weight).over(up) / F.sum(weight).over(Window.partitionBy(*by))
    return rows.withColumn("__share", share).where(F.col("__share") >= 0.5).groupBy(*by).agg(F.min(value).alias(value))


def l1_to_consensus(props: DataFrame, consensus: DataFrame) -> DataFrame:
    """Per method the sum of absolute differences to ``consensus`` (spot_id, cell_type, consensus)."""
    return props.join(consensus, ["spot_id", "cell_type"]).groupBy("method").agg(F.sum(F.abs(F.col("value") - F.col("consensus"))).alias("l1"))


def median_of_array(values: Column, weights: list[float]) -> Column:
    """The weighted median of an array whose entries have fixed weights."""
    total = sum(weights)
    pairs = F.array_sort(F.array(*[F.struct(values[i].alias("v"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m"))

    def step(acc: Column, x: Column) -> Column:
        c = acc["c"] + x["w"]
        return F.struct(c.alias("c"), F.when(acc["m"].isNull() & (c / total >= 0.5), x["v"]).otherwise(acc["m"]).alias("m"))

    return F.aggregate(pairs, start, step, lambda acc: acc["m"])


def endecon(props: DataFrame, methods: list[str], quantile: float = 0.5, iterations: int = 100, tol: float = 1e-5) -> tuple[DataFrame, dict[str, float]]:
    """Consensus (spot_id, cell_type, value; rows sum to 1) and the methods' weights.

    Every (spot, type) holds its methods' values in one array, so an iteration is
    one narrow pass that returns a distance per method; the weights are literals
    of the next plan.  Starts from the mean; weights are softmax(-L1 / scale),
    the scale being the first distances' quantile; identical inputs (scale 0)
    keep equal weights.  Stops when the objective changes by less than ``tol``.
    """
    one = [F.max(F.when(F.col("method") == m, F.col("value"))) for m in methods]
    wide = props.groupBy("spot_id", "cell_type").agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in one]).alias("v")).persist()
    try:
        n = len(methods)
        weights = [1.0 / n] * n
        centre = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
        scale, before = None, 0.0
        for _ in range(iterations):
            row = wide.select(centre.alias("h"), "v").agg(*[F.sum(F.abs(F.col("v")[i] - F.col("h"))) for i in range(n)]).first()
            l1 = [float(x or 0.0) for x in row]
            if scale is None:
                s, at = sorted(l1), (n - 1) * quantile
                scale = s[int(at)] + (s[min(int(at) + 1, n - 1)] - s[int(at)]) * (at - int(at))
            if scale > 0:
                e = [math.exp(-(x - min(l1)) / scale) for x in l1]
                weights = [x / sum(e) for x in e]
            centre = median_of_array(F.col("v"), weights)
            loss = sum(a * b for a, b in zip(l1, weights)) + scale * sum(w * math.log(w + 1e-12) for w in weights)
            if abs(loss - before) < tol:
                break
            before = loss
        h = wide.select("spot_id", "cell_type", centre.alias("value"))
        total = F.sum("value").over(Window.partitionBy("spot_id"))
        out = h.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(0.0))
    finally:
        wide.unpersist()
    return out, dict(zip(methods, weights))
