"""Which genes of one cell type follow the surroundings by another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import matrix, spatial, stats


def environment_features(cells: DataFrame, radius: float, types: list[str]) -> DataFrame:
    """cell_id, cell_type and the number of neighbours of each type (``n_<type>``, the cell itself included)."""
    return spatial.neighborhood_composition(cells, radius, types).join(cells.select("cell_id", "cell_type"), "cell_id")


def interaction_target(features: DataFrame, source: str, neighbour: str) -> DataFrame:
    """obs, target: the ``source`` cells and their number of ``neighbour`` neighbours."""
    return features.where(F.col("cell_type") == source).select(F.col("cell_id").alias("obs"), F.col(f"n_{neighbour}").cast("double").alias("target"))


def analyze_interaction(cells: DataFrame, expression: DataFrame, source: str, neighbour: str, radius: float, types: list[str], threshold: float | None = 3.0) -> DataFrame:
    """gene, n, r for the highly expressed genes (all with ``threshold`` None) of ``source`` cells against their ``neighbour`` counts.

    ``expression``: obs, gene, value in log1p space.
    """
    near = spatial.neighborhood_composition(cells, radius, [neighbour], only=source)
    target = near.select(F.col("cell_id").alias("obs"), F.col(f"n_{neighbour}").cast("double").alias("target")).persist()
    try:
        own = expression.join(target.select("obs"), "obs", "left_semi")
        if threshold is not None:
            own = own.join(matrix.high_expression_genes(own, max(1, target.count()), threshold).select("gene"), "gene", "left_semi")
        return stats.pearson_by_gene(own, target)
    finally:
        target.unpersist()


def correlation_analysis(expression: DataFrame, target: DataFrame, method: str = "pearson") -> DataFrame:
    """gene, n, r, p, p_adjust, strongest first; constant genes have null p and don't count in the adjustment."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")
    r = (stats.pearson_by_gene if method == "pearson" else stats.spearman_by_gene)(expression, target)
    return stats.benjamini_hochberg(r.withColumn("p", stats.correlation_p("r", "n"))).orderBy(F.desc_nulls_last("r"), "gene")
