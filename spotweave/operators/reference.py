"""Expression signatures of reference cells by negative binomial regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.counts import GeneCounts
from ..sources.io import cut_lineage, small_pandas, spread

#: Types by batches that every task holds.
GROUPS = 100_000


def nb_reference(counts: DataFrame, labels: DataFrame, rounds: int = 10, steps: int = 60, background: float = 0.1) -> tuple[DataFrame, DataFrame, list[float]]:
    """Means (cell_type, gene, mean), genes (gene, dispersion, additive: an array by batch) and the objective of every round.

    A count of gene g in a cell of type f and batch e has the mean
    (mean_fg + additive_eg) detection_e and the gene's overdispersion (variance:
    mean + mean^2 / dispersion).  Priors: means and detections exponential of mean
    1, additive ones of mean ``background``, the inverse root of the dispersion
    exponential of rate 3.  The result is the most probable one, not a sample.

    ``counts``: obs, gene, value >= 0, absent ones are 0; ``labels``: obs,
    cell_type, and batch if there are several; cells without a label take no part.
    A gene's likelihood needs its number of cells by type, batch and value only:
    Spark counts them, so a gene's row grows with the values it has, not with the
    cells.  Each round improves every gene by itself (``steps`` of expectation-
    maximisation), then the batches' detections by sums over all genes; neither
    lowers the objective.  With one batch, whose detection is 1, it ends once no
    gene gains a millionth of its objective.
    """
    batch = F.col("batch").cast("string") if "batch" in labels.columns else F.lit("")
    cells = cut_lineage(labels.where("cell_type is not null").select("obs", F.col("cell_type").cast("string").alias("cell_type"), F.coalesce(batch, F.lit("")).alias("batch")))
    table = small_pandas(cells.groupBy("cell_type", "batch").agg(F.count("*").alias("n")), GROUPS, "table of types and batches")
    types, batches = sorted(set(table["cell_type"])), sorted(set(table["batch"]))
    spark, kind = counts.sparkSession, counts.schema["gene"].dataType.simpleString()
    sizes = np.zeros((len(types), len(batches)))
    sizes[[types.index(t) for t in table["cell_type"]], [batches.index(b) for b in table["batch"]]] = table["n"]
    places = spark.createDataFrame([(t, b, i, j) for i, t in enumerate(types) for j, b in enumerate(batches)], "cell_type string, batch string, f int, e int")
    told = cells.join(F.broadcast(places), ["cell_type", "batch"]).select("obs", "f", "e")
    rows = counts.where("value > 0").join(told, "obs").groupBy("gene", "f", "e", F.col("value").cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    fields = {c: f"{c} array<{t}>" for c, t in (("f", "int"), ("e", "int"), ("v", "double"), ("n", "double"), ("mu", "double"), ("add", "double"))}
    schema = f"gene {kind}, {', '.join(fields.values())}, kappa double, objective double, done boolean, num array<double>, den array<double>"
    lists = rows.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("f", "e", "v", "n"))).alias("x")).select("gene", *[F.col(f"x.{c}").alias(c) for c in "fevn"])
    none = F.lit(None)
    state = lists.select("gene", *"fevn", none.cast("array<double>").alias("mu"), none.cast("array<double>").alias("add"), none.cast("double").alias("kappa"), none.cast("double").alias("objective"), F.lit(False).alias("done"))
    state, detection, held = cut_lineage(spread(state, "gene")), np.ones(len(batches)), []

    def run(y):
        def improved(parts):
            for pdf in parts:
                out = []
                for gene, f, e, v, n, mu, add, kappa, before, done in pdf.itertuples(index=False):
                    g = GeneCounts(np.asarray(f, int), np.asarray(e, int), np.asarray(v, float), np.asarray(n, float), sizes)
                    now = g.start() if mu is None else (np.asarray(mu, float), np.asarray(add, float), kappa)
                    if not done:
                        now = g.improve(*now, y, background, steps)
                    value = g.objective(*now, y, background)
                    # With one batch nothing else moves a gene that has come to rest.
                    done = len(batches) == 1 and mu is not None and value - before < 1e-6 * abs(value)
                    out.append((gene, f, e, v, n, *now, value, done, *g.detection(*now, y)))
                if out:
                    yield pd.DataFrame(out, columns=["gene", *"fevn", "mu", "add", "kappa", "objective", "done", "num", "den"])

        return improved

    for _ in range(rounds):
        state = cut_lineage(state.select("gene", *"fevn", "mu", "add", "kappa", "objective", "done").mapInPandas(run(detection), schema))
        total = state.agg(F.sum("objective"), F.min("done"), *[F.sum(F.col(c)[j]) for c in ("num", "den") for j in range(len(batches))]).first()
        if total is None or total[0] is None:
            break
        held.append(total[0] - (float(detection.sum()) if len(batches) > 1 else 0.0))
        if len(batches) > 1:
            num, den = np.array(total[2:], float).reshape(2, -1)
            detection = num / (den + 1)
        elif total[1]:
            break
    names = spark.createDataFrame(list(enumerate(types)), "place int, cell_type string")
    means = state.select("gene", F.posexplode("mu").alias("place", "mean")).join(F.broadcast(names), "place").select("cell_type", "gene", "mean")
    return means, state.select("gene", (1 / F.col("kappa") ** 2).alias("dispersion"), F.col("add").alias("additive")), held
