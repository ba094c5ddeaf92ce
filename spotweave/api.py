"""The engine's public functions and its registry of deconvolution backends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .operators import abundance, annotate, deconv, detect, ensemble, instances, interaction, predict, superres
from .sources.io import cached, cut_lineage

#: Backends take (spot counts, type means) and give obs, cell_type, value.
_BACKENDS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "nnls": deconv.nnls_deconv,
    "dwls": deconv.dwls_deconv,
    "rctd": deconv.rctd_full,
    "cell2location": lambda counts, means: abundance.spatial_abundance(counts, means)[0].select("obs", "cell_type", F.col("q05").alias("value")),
}
#: Networks whose weights this engine doesn't have; their outputs are read as tables.
_OUTSIDE = {
    "cellvit": "needs network weights: pass its prediction maps to detect_cells",
    "dinov2": "needs network weights: pass its features to superres_celltype",
}


def register_backend(name: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    _BACKENDS[name] = run


def list_available_backends() -> list[str]:
    return sorted(_BACKENDS)


def get_backend_error(name: str) -> str | None:
    """Why a backend can't run, or None if it can."""
    return None if name in _BACKENDS else _OUTSIDE.get(name, f"no backend is called {name!r}")


def _backend(name: str):
    if why := get_backend_error(name):
        raise RuntimeError(f"{name}: {why}")
    return _BACKENDS[name]


def validate_proportions(props: DataFrame) -> None:
    """Raise if a proportion is null, not finite or negative, or a (spot, type) comes twice."""
    v = F.col("value")
    bad = props.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)).limit(1).count()
    twice = props.groupBy("obs", "cell_type").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("proportions must be finite, non-negative and unique per observation and type")


def deconv_celltype(counts: DataFrame, means: DataFrame, methods: list[str], strict: bool = False, min_methods: int = 2, cache: str | None = None) -> tuple[DataFrame, dict[str, float], dict[str, str]]:
    """Consensus proportions (spot_id, cell_type, value), the methods' weights, and the errors of methods that failed.

    Fewer than ``min_methods`` successes give the first one as it is; none raise.
    With a ``cache`` folder a method runs once on the same counts and means; its
    entry also depends on the function's name, so rename a backend that changes.
    """

    def run(m: str) -> DataFrame:
        out = cut_lineage(_backend(m)(counts, means))
        validate_proportions(out)
        return out

    def proportions(m: str) -> DataFrame:
        if cache is None:
            return run(m)
        function = _backend(m)
        return cached(cache, [counts, means], {"method": m, "function": f"{function.__module__}.{function.__qualname__}"}, lambda: run(m))

    done, errors = {}, {}
    for m in methods:
        try:
            done[m] = proportions(m)
        except Exception as e:
            if strict:
                raise
            errors[m] = str(e)
    if not done:
        raise RuntimeError(f"no method succeeded: {errors}")
    if len(done) < min_methods:
        first, out = next(iter(done.items()))
        return out.select(F.col("obs").alias("spot_id"), "cell_type", "value"), {first: 1.0}, errors
    props = None
    for m, out in done.items():
        rows = out.select(F.col("obs").alias("spot_id"), F.lit(m).alias("method"), "cell_type", "value")
        props = rows if props is None else props.unionByName(rows)
    shared, weights = ensemble.endecon(ensemble.common_spots(props, len(done)), list(done))
    return shared, weights, errors


celltype_annotator = annotate.annotate_cells
genexp_predictor = predict.predict_expression
analyze_interaction = interaction.analyze_interaction
compute_environment_features = interaction.environment_features
correlation_analysis = interaction.correlation_analysis


def spatial_enrichment(sets: DataFrame, hits: DataFrame, universe: int) -> DataFrame:
    """Over-representation of hits in gene sets given as a table (no web service is asked)."""
    from .operators.stats import overlap_test

    return overlap_test(sets, hits, universe)


def detect_cells(tiles: DataFrame, tile: int = 256, overlap: int = 64, least: int = 10) -> DataFrame:
    """Cells of all tiles' prediction maps (as ``instances_from_maps`` takes them), in global coordinates, each once.

    cell_id follows from the tile and the instance's number in it.
    """
    found = instances.instances_from_maps(tiles, least).withColumn("cell_id", F.xxhash64("patch_row", "patch_col", "instance"))
    kept = detect.edge_filter(detect.instance_records(found, tile, overlap))
    boxes = kept.select("cell_id", "rmin", "cmin", "rmax", "cmax")
    return kept.join(detect.overlap_dedup(boxes).select("cell_id"), "cell_id", "left_semi")


def superres_celltype(features: DataFrame, labels: DataFrame, points: DataFrame, **training) -> DataFrame:
    """Shares of each type at ``points`` (point_id, vector), learned from spots' ``features`` and ``labels``; see ``superres.fit_head``."""
    return superres.predict_shares(points, superres.fit_head(features, labels, **training))
