"""One assignment of any number of rows to types with quotas, of the greatest total score.

Rows that prefer their type at some prices of the types are assigned optimally
for the quotas that come out; what differs from those wanted moves along the
cheapest paths of types, and stays optimal.  A path takes the row of least loss
between two types, so so many paths need no more than the first so many rows of
each pair of types: only these reach the driver.  Prices from a bounded sample
leave few paths to go; they decide how long it takes, not the score.  Rows of
equal scores are one class that moves in bulk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import kernels
from ..sources.io import cut_lineage

#: Rows of the sample that gives prices, classes per pair of types that a round may move, and rows of a split class ranked in one window.
SAMPLE, CLASSES, RANKED = 2_000, 500, 100_000


def prices(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Prices at which no row of an optimal assignment prefers another type: the middle of the least and the greatest."""
    k = score.shape[1]
    cost = np.full((k, k), np.inf)
    for a in range(k):
        if (at == a).any():
            cost[a] = (score[at == a][:, [a]] - score[at == a]).min(0)
    low, high = np.zeros(k), np.zeros(k)
    for _ in range(k):
        low, high = np.minimum(low, (low[None, :] + cost).min(1)), np.minimum(high, (high[:, None] + cost).min(0))
    return (low - high) / 2


def moves(classes: list[tuple[int, np.ndarray, int]], over: np.ndarray, most: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(class, from, to, number) of up to ``most`` paths from types over their quota to those under it, and what is over then.

    ``classes``: type, scores and number of rows, the cheapest of each pair of types.
    """
    k = len(over)
    score = np.array([c[1] for c in classes]).reshape(-1, k)
    number = np.zeros((len(classes), k), np.int64)
    number[np.arange(len(classes)), [c[0] for c in classes]] = [c[2] for c in classes]
    start, over = number.copy(), over.copy()
    for _ in range(most):
        if not (over > 0).any():
            break
        cost, via = np.full((k, k), np.inf), np.zeros((k, k), int)
        for a in range(k):
            rows = np.flatnonzero(number[:, a])
            if len(rows):
                loss = score[rows, a][:, None] - score[rows]
                first = loss.argmin(0)
                cost[a], via[a] = loss[first, np.arange(k)], rows[first]
                cost[a, a] = np.inf
        dist, past = np.where(over > 0, 0.0, np.inf), np.full(k, -1)
        for _ in range(k):
            new = dist[:, None] + cost
            best = new.argmin(0)
            better = new[best, np.arange(k)] < dist - 1e-12
            if not better.any():
                break
            past[better], dist[better] = best[better], new[best, np.arange(k)][better]
        to = int(np.argmin(np.where(over < 0, dist, np.inf)))
        if not np.isfinite(dist[to]):
            raise ValueError("the quotas can't be met")
        path = [to]
        while past[path[-1]] >= 0 and len(path) <= k:
            path.append(int(past[path[-1]]))
        steps = [(a, b, via[a, b]) for b, a in zip(path[:-1], path[1:])]
        much = min(over[path[-1]], -over[to], *(number[c, a] for a, _, c in steps))
        for a, b, c in steps:
            number[c, a] -= much
            number[c, b] += much
        over[path[-1]] -= much
        over[to] += much
    gone = []
    for c, (a, _, _) in enumerate(classes):
        gone += [(c, a, b, int(number[c, b] - start[c, b])) for b in range(k) if b != a and number[c, b] > start[c, b]]
    return gone, over


def _cheapest(classes: DataFrame, s: list[str]) -> pd.DataFrame:
    """The ``CLASSES`` classes of least loss of every ordered pair of types, each once: per task first, then of all tasks."""
    k = len(s)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        score, keep = pdf[s].to_numpy(float), set()
        for a in range(k):
            rows = np.flatnonzero(pdf["at"].to_numpy() == a)
            for b in range(k):
                if b != a and len(rows):
                    loss = score[rows, a] - score[rows, b]
                    order = np.lexsort((*score[rows].T, loss))[:CLASSES]
                    keep.update(rows[order].tolist())
        return pdf.iloc[sorted(keep)]

    def local(batches):
        held = None
        for pdf in batches:
            held = best(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
        if held is not None:
            yield held

    schema = classes.schema
    rows = classes.mapInPandas(local, schema)
    for parts in (64, 8):
        rows = rows.coalesce(parts).mapInPandas(local, schema)
    return best(rows.toPandas())


def assign(rows: DataFrame, s: list[str], quota: np.ndarray) -> DataFrame:
    """cell_id and ``at``, the place of its type in ``s``, of every row: ``quota[k]`` rows have the k-th.

    ``rows``: cell_id and the columns of scores; the quotas sum to their number.
    Of rows of equal scores, those that come first by a hash of the id take the
    first types.  As many rounds as 500 classes per pair of types and round need.
    """
    k = len(s)
    rows = cut_lineage(rows.select("cell_id", *[F.col(c).cast("double").alias(c) for c in s]))
    n = int(quota.sum())
    known = rows.orderBy(F.xxhash64(F.col("cell_id").cast("string")), "cell_id").limit(SAMPLE).select(*s).toPandas().to_numpy(float)
    price = np.zeros(k)
    if len(known):
        few = kernels.deal_quotas(quota, np.array([len(known), n - len(known)], np.int64))[0]
        price = prices(known, kernels.assign_with_quota(known, few))
    worth = F.array(*[F.struct((F.col(c) - F.lit(float(p))).alias("v"), F.lit(-i).alias("i")) for i, (c, p) in enumerate(zip(s, price))])
    classes = cut_lineage(rows.groupBy(*s).agg(F.count("*").alias("n")).withColumn("at", (-F.array_max(worth)["i"]).cast("int")))
    held = {r[0]: r[1] for r in classes.groupBy("at").agg(F.sum("n")).collect()}
    over = np.array([held.get(i, 0) for i in range(k)], np.int64) - quota
    spark = rows.sparkSession
    schema = ", ".join([*(f"{c} double" for c in s), "at int", "to int", "much bigint"])
    while (over > 0).any():
        near = _cheapest(classes, s)
        gone, over = moves(list(zip(near["at"].tolist(), near[s].to_numpy(float), near["n"].tolist())), over, CLASSES)
        change = spark.createDataFrame([(*map(float, near[s].iloc[c]), a, b, much) for c, a, b, much in gone], schema)
        left = classes.join(F.broadcast(change.groupBy(*s, "at").agg(F.sum("much").alias("gone"))), [*s, "at"], "left").select(*s, (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"), "at")
        came = change.select(*s, F.col("much").alias("n"), F.col("to").alias("at"))
        classes = cut_lineage(left.unionByName(came).groupBy(*s, "at").agg(F.sum("n").alias("n")).where("n > 0"))
    kinds = classes.groupBy(*s).agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("kinds"))
    named = rows.join(kinds, s)
    whole = named.where(F.size("kinds") == 1).select("cell_id", F.col("kinds")[0]["at"].alias("at"))
    # Classes of several types: a rank from counts per bucket of the ids' hashes, so no window holds a whole class.
    split = named.where(F.size("kinds") > 1).withColumn("h", F.xxhash64(F.col("cell_id").cast("string")))
    split = cut_lineage(split.withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("all") / RANKED))))
    size = split.groupBy(*s, "bucket").agg(F.count("*").alias("size"))
    before = size.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(*s).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*s, "bucket").orderBy("h", "cell_id"))
    ranked = split.join(before.drop("size"), [*s, "bucket"]).withColumn("rank", rank)
    ends = F.aggregate("kinds", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("int").alias("at")), lambda acc, x: F.struct((acc["sum"] + x["n"]).alias("sum"), F.when(acc["at"].isNull() & (F.col("rank") <= acc["sum"] + x["n"]), x["at"]).otherwise(acc["at"]).alias("at")))
    return whole.unionByName(ranked.select("cell_id", ends["at"].alias("at")))
