"""Correlation, multiple testing and overlap tests over long tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType


def _paired(expression: DataFrame, target: DataFrame) -> DataFrame:
    """Each (gene, cell) entry that there is, with the cell's target."""
    return expression.join(target, "obs").select("obs", "gene", "value", "target")


def pearson_by_gene(expression: DataFrame, target: DataFrame) -> DataFrame:
    """gene, n and Pearson's r with the target over the cells of ``target``; absent entries are zeros, a constant gene has none.

    Sums over the entries suffice, as zeros add nothing; the target's own sums come once.
    """
    whole = target.agg(F.count("*").alias("n"), F.sum("target").alias("st"), F.sum(F.col("target") * F.col("target")).alias("stt"))
    v, t = F.col("value"), F.col("target")
    per = _paired(expression, target).groupBy("gene").agg(F.sum(v).alias("sv"), F.sum(v * v).alias("svv"), F.sum(v * t).alias("svt"))
    n = F.col("n")
    top = n * F.col("svt") - F.col("sv") * F.col("st")
    a, b = n * F.col("svv") - F.col("sv") * F.col("sv"), n * F.col("stt") - F.col("st") * F.col("st")
    r = F.when((a > 1e-9) & (b > 1e-9), top / F.sqrt(a * b))
    return per.join(whole, how="cross").select("gene", "n", r.alias("r"))


def spearman_by_gene(expression: DataFrame, target: DataFrame) -> DataFrame:
    """gene, n and Spearman's r over the cells of ``target``; absent entries are zeros and share their ranks.

    The zeros of a gene aren't made: their rank and number follow from the counts,
    and their targets' rank sum is what the entries leave of the whole.
    """
    every = with_global_rank(target, "target", "rt")
    whole = every.agg(F.count("*").alias("n"), F.sum("rt").alias("st"), F.sum(F.col("rt") * F.col("rt")).alias("stt"))
    held = with_global_rank(expression.where("value <> 0").join(every.select("obs", "rt"), "obs"), "value", "own", by=["gene"])
    sizes = held.groupBy("gene").agg(F.count(F.when(F.col("value") < 0, 1)).alias("low"), F.count("*").alias("filled"))
    held = held.select("gene", "value", "rt", "own").join(sizes, "gene").join(whole, how="cross")
    zeros = F.col("n") - F.col("filled")
    held = held.withColumn("rv", F.col("own") + F.when(F.col("value") > 0, zeros).otherwise(0)).withColumn("rz", F.col("low") + (zeros + 1) / 2).withColumn("zeros", zeros)
    per = held.groupBy("gene", "n", "st", "stt", "rz", "zeros").agg(F.sum("rv").alias("sv"), F.sum(F.col("rv") * F.col("rv")).alias("svv"), F.sum(F.col("rv") * F.col("rt")).alias("svt"), F.sum("rt").alias("part"))
    sv = F.col("sv") + F.col("zeros") * F.col("rz")
    svv = F.col("svv") + F.col("zeros") * F.col("rz") * F.col("rz")
    svt = F.col("svt") + F.col("rz") * (F.col("st") - F.col("part"))
    a, b = F.col("n") * svv - sv * sv, F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    r = F.when((a > 1e-9) & (b > 1e-9), (F.col("n") * svt - sv * F.col("st")) / F.sqrt(a * b))
    return per.select("gene", "n", r.alias("r"))


def _value_buckets(rows: DataFrame, value: str, by: list[str], buckets: int) -> DataFrame:
    """by, value, n, b and before: every distinct value's rows, its bucket (between quantile bounds of all values), and the group's rows in lower buckets."""
    cuts = sorted(set(rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.01)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__b", bucket)
    lower = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    past = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__s")).select(*by, "__b", F.coalesce(F.sum("__s").over(lower), F.lit(0)).alias("__past"))
    return counts.join(past, [*by, "__b"])


def with_global_rank(rows: DataFrame, value: str, name: str, buckets: int = 64, by: list[str] | None = None) -> DataFrame:
    """``rows`` with their average rank over all rows, or over those of equal ``by``; null values are left out.

    Quantile bounds cut the values into buckets; a value's rank is its place in
    the bucket plus the rows of the buckets before, so no window holds more than
    a bucket's distinct values.
    """
    by = by or []
    rows = rows.where(F.col(value).isNotNull())
    inner = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__past") + F.coalesce(F.sum("__n").over(inner), F.lit(0)) + (F.col("__n") + 1) / 2
    return rows.join(_value_buckets(rows, value, by, buckets).select(*by, value, rank.alias(name)), [*by, value])


def _betacf(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for k in (0, 1):
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom."""
    out = []
    for x, m in zip(r, n):
        if x is None or x != x or m < 3:
            out.append(None)
        else:
            out.append(beta_inc((m - 2) / 2, 0.5, max(0.0, 1 - x * x)))
    return pd.Series(out, dtype="float64")


def benjamini_hochberg(tests: DataFrame, p: str = "p", by: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """``tests`` with ``p_adjust``; null p are left out of the count and stay null.  ``by``: families of tests."""
    fam = by or []
    ranked = tests.where(F.col(p).isNotNull())
    # Equal p share a value: the greatest rank of a tie gives the least product.  Buckets of p keep windows small, with families or without.
    each = _value_buckets(ranked, p, fam, buckets)
    up = Window.partitionBy(*fam, "__b").orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*fam, "__b").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = each.groupBy(*fam).agg(F.sum("__n").alias("__m"))
    each = each.join(sizes, fam) if fam else each.join(sizes, how="cross")
    each = each.withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__past") + F.sum("__n").over(up)))
    above = Window.partitionBy(*fam).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    least = each.groupBy(*fam, "__b").agg(F.min("__raw").alias("__l")).select(*fam, "__b", F.min("__l").over(above).alias("__above"))
    each = each.join(least, [*fam, "__b"]).select(*fam, p, F.least(F.lit(1.0), F.min("__raw").over(down), "__above").alias("p_adjust"))
    out = ranked.join(each, [*fam, p]).select(*tests.columns, "p_adjust")
    return out.unionByName(tests.where(F.col(p).isNull()).withColumn("p_adjust", F.lit(None).cast("double")))


@F.pandas_udf(DoubleType())
def hypergeometric_tail(x: pd.Series, universe: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
    """P(X >= x) for m draws from a universe that holds k successes."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
    out = []
    for xi, n, ki, mi in zip(x, universe, k, m):
        at = np.arange(max(xi, 0, mi + ki - n), min(ki, mi) + 1)
        out.append(1.0 if xi <= 0 else float(min(1.0, np.exp(choose(ki, at) + choose(n - ki, mi - at) - choose(n, mi)).sum())) if len(at) else 0.0)
    return pd.Series(out)


def overlap_test(sets: DataFrame, hits: DataFrame, universe: int) -> DataFrame:
    """Per gene set: its size, the hits' size, their overlap, its p and its adjusted p.  ``sets``: set_id, gene; ``hits``: gene.

    Sizes count list entries as given, the overlap counts distinct genes.
    """
    n_hits = hits.agg(F.count("*").alias("n_hits"))
    sizes = sets.groupBy("set_id").agg(F.count("*").alias("set_size"))
    shared = sets.select("set_id", "gene").distinct().join(hits.select("gene").distinct(), "gene").groupBy("set_id").agg(F.count("*").alias("overlap"))
    rows = sizes.join(shared, "set_id", "left").fillna(0, ["overlap"]).join(n_hits, how="cross")
    rows = rows.withColumn("p", hypergeometric_tail("overlap", F.lit(universe), "set_size", "n_hits"))
    return benjamini_hochberg(rows)


def significant(tests: DataFrame, level: float = 0.05, p: str = "p_adjust") -> DataFrame:
    """The tests whose adjusted p is below the level; null ones aren't."""
    return tests.where(F.col(p) < level)
