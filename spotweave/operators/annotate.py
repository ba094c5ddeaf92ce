"""Cell-type annotation: quotas, scores, morphology transfer and constrained assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import kernels
from ..sources.io import cut_lineage, small_pandas
from . import assign, spatial

#: The detector's classes and the names under which priors know them.
MORPHOLOGY = {0: "nolabel", 1: "Neoplastic cells", 2: "Inflammatory", 3: "Connective/Soft tissue cells", 4: "Dead Cells", 5: "Epithelial"}
DROPPED = ("nolabel", "Dead Cells")
#: Types by morphologies that the driver solves.
TRANSFER_CELLS = 10_000


def morphology_types(cells: DataFrame, code: str = "img_type") -> DataFrame:
    """``cells`` with ``morphology``, without unlabelled and dead ones."""
    name = F.create_map(*[F.lit(x) for kv in MORPHOLOGY.items() for x in kv])[F.col(code).cast("int")]
    return cells.withColumn("morphology", name).where(F.col("morphology").isNotNull() & ~F.col("morphology").isin(*DROPPED))


def largest_remainder(rows: DataFrame, group: list[str], kind: str = "cell_type", share: str = "value", total: str = "total") -> DataFrame:
    """``rows`` with ``quota``: each group's total dealt in proportion to its shares in whole numbers.

    Floors, then one more for the largest remainders; equal ones by ``kind``.
    Negative shares count as 0; a group without positive shares is dealt evenly.
    """
    held = Window.partitionBy(*group)
    p = F.greatest(F.col(share), F.lit(0.0))
    s = F.sum(p).over(held)
    raw = F.when(s > 0, p / s).otherwise(1 / F.count("*").over(held)) * F.col(total)
    rows = rows.withColumn("__raw", raw).withColumn("quota", F.floor("__raw").cast("bigint"))
    left = F.col(total) - F.sum("quota").over(held)
    place = F.row_number().over(held.orderBy(F.desc(F.round(F.col("__raw") - F.col("quota"), 9)), kind))
    return rows.withColumn("__left", left).withColumn("__place", place).withColumn("quota", F.col("quota") + (F.col("__place") <= F.col("__left")).cast("bigint")).drop("__raw", "__left", "__place")


def segment_scores(membership: DataFrame, ratios: DataFrame) -> DataFrame:
    """Per segment and type the ratios of its super-resolution points, each point's shared out evenly over its segments.

    ``membership``: point_id, cell_id; ``ratios``: point_id, cell_type, value.
    """
    n = membership.groupBy("point_id").agg(F.count("*").alias("n"))
    return membership.join(n, "point_id").join(ratios, "point_id").groupBy("cell_id", "cell_type").agg(F.sum(F.col("value") / F.col("n")).alias("score"))


def blend_morphology(scores: DataFrame, cells: DataFrame, transfer: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(1 - alpha) score + alpha P(type | morphology).  ``cells``: cell_id, morphology; ``transfer``: cell_type, morphology, p."""
    rows = cells.join(transfer, "morphology").select("cell_id", "cell_type", "p")
    both = scores.join(rows, ["cell_id", "cell_type"], "full")
    return both.select("cell_id", "cell_type", ((1 - alpha) * F.coalesce("score", F.lit(0.0)) + alpha * F.coalesce("p", F.lit(0.0))).alias("score"))


def cosine_cost(types: DataFrame, morphologies: DataFrame, priors: DataFrame | None = None, factor: float = 2.0) -> DataFrame:
    """1 - cosine of each type's and each morphology's vector over spots, divided by ``factor`` for preferred pairs.

    ``types``: spot_id, cell_type, value; ``morphologies``: spot_id, morphology, value; ``priors``: cell_type, morphology.
    """
    a = types.groupBy("cell_type").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("na"))
    b = morphologies.groupBy("morphology").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("nb"))
    dot = types.withColumnRenamed("value", "u").join(morphologies.withColumnRenamed("value", "v"), "spot_id").groupBy("cell_type", "morphology").agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    # Types and morphologies are two short lists; their grid is the cost matrix itself.
    grid = a.join(b, how="cross").join(dot, ["cell_type", "morphology"], "left")
    norm = F.col("na") * F.col("nb")
    cost = grid.select("cell_type", "morphology", (1 - F.when(norm > 0, F.coalesce("dot", F.lit(0.0)) / norm).otherwise(0.0)).alias("cost"))
    if priors is None:
        return cost
    liked = priors.select("cell_type", "morphology", F.lit(True).alias("liked")).distinct()
    return cost.join(liked, ["cell_type", "morphology"], "left").select("cell_type", "morphology", F.when(F.col("liked"), F.col("cost") / factor).otherwise(F.col("cost")).alias("cost"))


def type_transfer(cost: DataFrame, type_share: DataFrame, morphology_share: DataFrame, method: str = "emd", reg: float = 0.01) -> DataFrame:
    """P(cell_type | morphology) from the transport between both shares, the exact one or with ``method`` sinkhorn the entropic one.

    Types by morphologies are a table of at most ``TRANSFER_CELLS`` entries, solved on the driver.
    """
    if method not in ("emd", "sinkhorn"):
        raise ValueError("method must be emd or sinkhorn")
    c = small_pandas(cost, TRANSFER_CELLS, "cost table").pivot(index="cell_type", columns="morphology", values="cost")
    a = small_pandas(type_share, TRANSFER_CELLS, "table of types").set_index("cell_type")["value"].reindex(c.index).fillna(0).to_numpy(float)
    b = small_pandas(morphology_share, TRANSFER_CELLS, "table of morphologies").set_index("morphology")["value"].reindex(c.columns).fillna(0).to_numpy(float)
    a = a / a.sum() if a.sum() > 0 else np.full(len(a), 1 / len(a))
    b = b / b.sum() if b.sum() > 0 else np.full(len(b), 1 / len(b))
    plan = kernels.transport(a, b, c.to_numpy(float)) if method == "emd" else kernels.sinkhorn(a, b, c.to_numpy(float), reg)
    p = plan / np.where(plan.sum(0) > 0, plan.sum(0), 1)[None, :]
    rows = [(t, m, float(p[i, j])) for i, t in enumerate(c.index) for j, m in enumerate(c.columns)]
    return cost.sparkSession.createDataFrame(rows, "cell_type string, morphology string, p double")


def constrained_assignment(scores: DataFrame, membership: DataFrame, quotas: DataFrame, types: list[str], totals: DataFrame | None = None) -> DataFrame:
    """cell_id, pred_cell_type, spot_id: each spot's cells take its quota of every type at the greatest total score.

    Spots that share no cell are independent, so each is solved exactly on its
    own: a group is one spot's cells.  ``totals`` (cell_type, quota) bind all
    cells: those of no spot then share what the spots leave, at the greatest
    total score however many they are; without ``totals`` they take their best
    type.
    ``scores``: cell_id, cell_type, score (absent ones are 0); ``membership``:
    cell_id, spot_id (one spot per cell); ``quotas``: spot_id, cell_type, quota.
    Quotas that can't be met raise.
    """
    pivot = scores.groupBy("cell_id").agg(*[F.coalesce(F.max(F.when(F.col("cell_type") == t, F.col("score"))), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(types)])
    want = quotas.groupBy("spot_id").agg(*[F.coalesce(F.max(F.when(F.col("cell_type") == t, F.col("quota"))), F.lit(0)).alias(f"q{i}") for i, t in enumerate(types)])
    s, q = [f"s{i}" for i in range(len(types))], [f"q{i}" for i in range(len(types))]
    inside = membership.join(pivot, "cell_id").join(want, "spot_id", "left").fillna(0, q)
    kind = membership.schema["cell_id"].dataType.simpleString(), membership.schema["spot_id"].dataType.simpleString()
    rest = pivot.join(membership, "cell_id", "left_anti")
    if totals is not None:
        pivot, inside, rest = None, cut_lineage(inside), cut_lineage(rest)
        held = inside.groupBy("spot_id").agg(F.count("*").alias("cells"), *[F.first(c).alias(c) for c in q])
        held = cut_lineage(held.withColumn("whole", sum((F.col(c) for c in q), F.lit(0))))
        bad = held.where("cells <> whole").limit(1).collect()
        if bad:
            raise ValueError(f"spot {bad[0]['spot_id']} has {bad[0]['cells']} cells but quotas of {bad[0]['whole']}")
        used = held.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in q]).first()
        given = {r["cell_type"]: int(r["quota"]) for r in totals.where(F.col("cell_type").isin(types)).collect()}
        left = np.array([given.get(t, 0) - int(used[c]) for t, c in zip(types, q)], np.int64)
        if (left < 0).any():
            raise ValueError("the spots' quotas exceed the totals: " + ", ".join(f"{t} by {-n}" for t, n in zip(types, left) if n < 0))
        n = rest.count()
        if left.sum() != n:
            raise ValueError(f"the totals leave {left.sum()} places to {n} cells outside the spots")
        placed = assign.assign(rest, s, left) if n else None

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cell_id")
        at = kernels.assign_with_quota(g[s].to_numpy(float), g[q].iloc[0].to_numpy(int))
        return pd.DataFrame({"cell_id": g["cell_id"], "pred_cell_type": [types[i] for i in at], "spot_id": g["spot_id"]})

    inside = inside.select("spot_id", "cell_id", *s, *q)
    solved = inside.groupBy("spot_id").applyInPandas(solve, f"cell_id {kind[0]}, pred_cell_type string, spot_id {kind[1]}")
    if totals is not None:
        name = F.array(*[F.lit(t) for t in types])
        return solved if placed is None else solved.unionByName(placed.select("cell_id", name[F.col("at")].alias("pred_cell_type"), F.lit(None).cast(kind[1]).alias("spot_id")))
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(len(types))]))["i"]
    rest = rest.select("cell_id", F.array(*[F.lit(t) for t in types])[-best].alias("pred_cell_type"), F.lit(None).cast(kind[1]).alias("spot_id"))
    return solved.unionByName(rest)


def annotate_cells(cells: DataFrame, spots: DataFrame, spot_ratios: DataFrame, points: DataFrame, point_ratios: DataFrame, radius: float, point_radius: float, types: list[str], alpha: float | None = None, priors: DataFrame | None = None, factor: float = 2.0, method: str = "emd") -> DataFrame:
    """cell_id, pred_cell_type, spot_id of every cell near a super-resolution point: the annotator as a whole.

    Cells with a point within ``point_radius`` (Chebyshev) stay; each belongs to
    the nearest spot within ``radius`` (ties to the smaller id), if there is one.
    A spot's cells are dealt to the types by its ratios, all cells by the sum of
    these; scores are the points' ratios, with ``alpha`` blended with the
    transport of the detector's classes (column img_type) to the types.
    ``cells``: cell_id, x, y; ``spots``: spot_id, x, y; ``spot_ratios``: spot_id,
    cell_type, value; ``points``: point_id, x, y; ``point_ratios``: point_id, cell_type, value.
    """
    at = lambda df, id_col, name: df.select(F.col(id_col).alias(name), "x", "y")
    pairs = spatial.radius_join(at(cells, "cell_id", "query_id"), at(points, "point_id", "base_id"), point_radius, "chebyshev")
    member = cut_lineage(pairs.select(F.col("base_id").alias("point_id"), F.col("query_id").alias("cell_id")))
    kept = cut_lineage(cells.join(member.select("cell_id").distinct(), "cell_id", "left_semi"))
    near = spatial.nearest_within(at(kept, "cell_id", "query_id"), at(spots, "spot_id", "base_id"), radius)
    inside = cut_lineage(near.select(F.col("query_id").alias("cell_id"), F.col("base_id").alias("spot_id")))
    counts = inside.groupBy("spot_id").agg(F.count("*").alias("total"))
    if counts.isEmpty():
        raise ValueError("no spot holds a cell")
    # Every spot that holds cells has a ratio of every type.
    names = cells.sparkSession.createDataFrame([(t,) for t in types], "cell_type string")
    ratios = counts.join(F.broadcast(names), how="cross").join(spot_ratios, ["spot_id", "cell_type"], "left").fillna(0.0, ["value"])
    quotas = cut_lineage(largest_remainder(ratios, ["spot_id"]).select("spot_id", "cell_type", "quota"))
    whole = quotas.groupBy("cell_type").agg(F.sum("quota").alias("value")).withColumns({"g": F.lit(1), "total": F.lit(kept.count())})
    totals = cut_lineage(largest_remainder(whole, ["g"]).select("cell_type", "quota"))
    scores = segment_scores(member, point_ratios)
    if alpha is not None:
        seen = morphology_types(kept.join(inside, "cell_id"), "img_type")
        per = cut_lineage(seen.groupBy("spot_id", "morphology").agg(F.count("*").cast("double").alias("value")))
        cost = cosine_cost(quotas.select("spot_id", "cell_type", F.col("quota").cast("double").alias("value")), per, priors, factor)
        share = per.groupBy("morphology").agg(F.sum("value").alias("value"))
        transfer = type_transfer(cost, totals.select("cell_type", F.col("quota").cast("double").alias("value")), share, method)
        scores = blend_morphology(scores, morphology_types(kept, "img_type").select("cell_id", "morphology"), transfer, alpha)
    # A cell without any score still takes part.
    scores = scores.unionByName(kept.select("cell_id", F.lit(types[0]).alias("cell_type"), F.lit(0.0).alias("score"))).groupBy("cell_id", "cell_type").agg(F.sum("score").alias("score"))
    return constrained_assignment(scores, inside, quotas, types, totals)
