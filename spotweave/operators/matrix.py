"""Sparse expression matrices as long tables (obs, gene, value); absent entries are zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import stats


def gene_align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to the genes that they share."""
    shared = left.select("gene").distinct().join(right.select("gene").distinct(), "gene")
    return left.join(shared, "gene", "left_semi"), right.join(shared, "gene", "left_semi")


def row_normalize(rows: DataFrame, row: str = "obs", value: str = "value") -> DataFrame:
    """Negative values count as 0; each row is divided by its sum, or by 1 if that is below 1e-12."""
    v = F.greatest(F.col(value), F.lit(0.0))
    total = F.sum(v).over(Window.partitionBy(row))
    return rows.withColumn(value, v / F.when(total < 1e-12, 1.0).otherwise(total))


def one_hot(labels: DataFrame, types: list[str], label: str = "cell_type") -> DataFrame:
    """A 0/1 column ``is_<type>`` per type."""
    return labels.select("*", *[F.coalesce((F.col(label) == t).cast("int"), F.lit(0)).alias(f"is_{t}") for t in types])


def gene_qc_filter(counts: DataFrame, n_cells: int, least_cells: float = 5, least_share: float = 0.03, least_mean: float = 1.12) -> DataFrame:
    """Genes in more than ``least_share`` of the cells, or in more than ``least_cells`` with a non-zero mean above ``least_mean``."""
    per = counts.where("value > 0").groupBy("gene").agg(F.count("*").alias("n_cells"), (F.sum("value") / F.count("*")).alias("nonzero_mean"))
    return per.where((F.col("n_cells") > n_cells * least_share) | ((F.col("n_cells") > least_cells) & (F.col("nonzero_mean") > least_mean)))


def drop_rare_types(labels: DataFrame, least: int = 2, label: str = "cell_type") -> DataFrame:
    """Cells whose type has at least ``least`` cells."""
    common = labels.groupBy(label).count().where(F.col("count") >= least).select(label)
    return labels.join(common, label, "left_semi")


def umi_filter(counts: DataFrame, low: float = 100, high: float = 20_000_000) -> DataFrame:
    """obs and n_umi of observations whose total lies within the bounds, both included."""
    return counts.groupBy("obs").agg(F.sum("value").alias("n_umi")).where(F.col("n_umi").between(low, high))


def bulk_vector(counts: DataFrame) -> DataFrame:
    """Total and number of observations of every gene."""
    return counts.groupBy("gene").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") != 0, 1)).alias("n_obs"))


def log_normalize(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p of values scaled to ``target`` per observation; observations of total 0 stay 0."""
    total = F.sum("value").over(Window.partitionBy("obs"))
    return counts.withColumn("value", F.log1p(F.when(total > 0, F.col("value") / total * target).otherwise(0.0)))


def type_means(counts: DataFrame, labels: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Mean of each gene over all cells of a type, absent entries as zeros.  ``labels``: obs, cell_type.

    Types without a cell have no row; with ``genes`` every (type, gene) has one.
    """
    cells = labels.groupBy("cell_type").agg(F.count("*").alias("n_cells"))
    sums = counts.join(labels, "obs").groupBy("cell_type", "gene").agg(F.sum("value").alias("total"))
    if genes is not None:
        # Types and genes are dimensions; their grid is the result's own size.
        grid = cells.select("cell_type").join(genes.select("gene").distinct(), how="cross")
        sums = grid.join(sums, ["cell_type", "gene"], "left").fillna(0.0, ["total"])
    return sums.join(cells, "cell_type").select("cell_type", "gene", (F.col("total") / F.col("n_cells")).alias("mean"))


def per_umi(counts: DataFrame) -> DataFrame:
    """Values divided by their observation's total."""
    total = F.sum("value").over(Window.partitionBy("obs"))
    return counts.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(0.0))


def type_means_numi(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean over the cells of a type of counts divided by the cell's total."""
    return type_means(per_umi(counts), labels)


def signature_means(lognorm: DataFrame, labels: DataFrame) -> DataFrame:
    """Type means on the expm1 of log-normalised values."""
    return type_means(lognorm.withColumn("value", F.expm1("value")), labels)


def de_genes(means: DataFrame, bulk: DataFrame, least_fold: float = 0.5, least_mean: float = 0.000125, least_obs: float = 3, prefix: str = "mt-") -> DataFrame:
    """(cell_type, gene, log_fold) whose log ratio of the type's mean to the mean of the other types' exceeds ``least_fold``.

    ``means``: cell_type, gene, mean for every type and gene (absent ones are 0).
    Genes that start with ``prefix`` or whose bulk total is below ``least_obs`` are left out.
    """
    n_types = means.select(F.countDistinct("cell_type").alias("k"))
    held = Window.partitionBy("gene")
    # A gene's absent types are zeros, so the sum over the rows there are is the whole sum.
    rows = means.withColumn("others", F.sum("mean").over(held) - F.col("mean")).join(n_types, how="cross")
    fold = F.log(F.col("mean") + 1e-9) - F.log(F.col("others") / F.greatest(F.col("k") - 1, F.lit(1)) + 1e-9)
    rows = rows.withColumn("log_fold", fold).where((F.col("log_fold") > least_fold) & (F.col("mean") > least_mean))
    ok = bulk.where(F.col("total") >= least_obs).select("gene")
    return rows.where(~F.col("gene").cast("string").startswith(prefix)).join(ok, "gene", "left_semi").select("cell_type", "gene", "log_fold")


def high_expression_genes(lognorm: DataFrame, n_obs: int, threshold: float = 3.0) -> DataFrame:
    """Genes whose log1p of the mean of 100 expm1(value) over all observations reaches the threshold."""
    per = lognorm.groupBy("gene").agg(F.log1p(F.sum(100 * F.expm1("value")) / F.lit(float(n_obs))).alias("level"))
    return per.where(F.col("level") >= threshold)


def quantiles(values: DataFrame, by: list[str], q: list[float], value: str = "value") -> DataFrame:
    """Exact linear quantiles per group, one column ``q<percent>`` each."""
    return values.groupBy(*by).agg(*[F.percentile(value, F.lit(x)).alias(f"q{round(100 * x):02d}") for x in q])


def page_enrichment(lognorm: DataFrame, signatures: DataFrame, n_obs: int) -> DataFrame:
    """z of each signature in each observation: (mean over its genes - mean over all) sqrt(m) / sd of the fold changes.

    Fold change: the log value less log2 of the gene's mean expm1 plus 1; the
    deviation is the population's.  ``lognorm`` holds every gene of an
    observation (zeros too).  ``signatures``: cell_type, gene.
    """
    base = lognorm.groupBy("gene").agg(F.log2(F.sum(F.expm1("value")) / F.lit(float(n_obs)) + 1).alias("base"))
    folds = lognorm.join(base, "gene").select("obs", "gene", (F.col("value") - F.col("base")).alias("fold"))
    every = folds.groupBy("obs").agg(F.avg("fold").alias("mean_all"), F.stddev_pop("fold").alias("sd_all"))
    own = folds.join(signatures, "gene").groupBy("obs", "cell_type").agg(F.avg("fold").alias("mean_sig"), F.count("*").alias("m"))
    z = (F.col("mean_sig") - F.col("mean_all")) * F.sqrt("m") / F.col("sd_all")
    return own.join(every, "obs").select("obs", "cell_type", F.when(F.col("sd_all") > 0, z).alias("z"))


def highly_variable_genes(lognorm: DataFrame, n_obs: int, top: int = 2000, bins: int = 20) -> DataFrame:
    """gene, mean, dispersion, score and rank of the ``top`` genes by dispersion normalised within bins of the mean.

    Mean and variance are of expm1(value) with absent entries as zeros; log1p of
    the mean is cut into ``bins`` of equal width, and the log dispersion is
    centred and scaled by its bin's mean and sample deviation (a bin of one gene
    scores 1).  Ties go to the smaller gene.
    """
    n = F.lit(float(n_obs))
    x = F.expm1("value")
    per = lognorm.groupBy("gene").agg((F.sum(x) / n).alias("mu"), F.sum(x * x).alias("sq"))
    per = per.withColumn("var", (F.col("sq") - n * F.col("mu") * F.col("mu")) / F.greatest(n - 1, F.lit(1.0))).where("mu > 0 and var > 0")
    per = per.select("gene", F.log1p("mu").alias("mean"), F.log(F.col("var") / F.col("mu")).alias("dispersion"))
    span = per.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    per = per.join(span, how="cross").withColumn("bin", F.least(F.floor((F.col("mean") - F.col("low")) / ((F.col("high") - F.col("low")) / bins + 1e-12)), F.lit(bins - 1)))
    stats = per.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("s"))
    scored = per.join(stats, "bin").withColumn("score", F.when(F.col("s") > 0, (F.col("dispersion") - F.col("m")) / F.col("s")).otherwise(1.0))
    best = scored.orderBy(F.desc("score"), "gene").limit(top)
    return best.select("gene", "mean", "dispersion", "score")


def marker_types(means: DataFrame) -> DataFrame:
    """gene, cell_type of its greatest mean; ties go to the first type."""
    place = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("mean"), "cell_type"))
    return means.withColumn("__p", place).where("__p = 1").select("gene", "cell_type")


def candidate_types(scores: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """``scores``: cluster, cell_type, z per observation.  Types whose greatest z in a cluster exceeds the cutoff, or its two best where fewer than two do."""
    top = scores.groupBy("cluster", "cell_type").agg(F.max("z").alias("z"))
    held = Window.partitionBy("cluster")
    above = F.count(F.when(F.col("z") > cutoff, 1)).over(held)
    ranked = top.withColumn("__n", above).withColumn("__p", F.row_number().over(held.orderBy(F.desc("z"), "cell_type")))
    return ranked.where(((F.col("__n") >= 2) & (F.col("z") > cutoff)) | ((F.col("__n") < 2) & (F.col("__p") <= 2))).select("cluster", "cell_type", "z")


def stratified_sample(rows: DataFrame, by: str, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """Up to ``most`` rows of every stratum, the least by a seeded hash of the id: the same for any partitioning."""
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(by).orderBy(order, id_col))).where(F.col("__p") <= most).drop("__p")


def drop_empty(counts: DataFrame, least_cells: int = 1, least_genes: int = 1) -> DataFrame:
    """``counts`` of genes that ``least_cells`` observations hold, then of observations that hold ``least_genes`` of these; zeros don't count."""
    held = counts.where("value <> 0")
    genes = held.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= least_cells).select("gene")
    kept = counts.join(genes, "gene", "left_semi")
    cells = kept.where("value <> 0").groupBy("obs").agg(F.count("*").alias("n")).where(F.col("n") >= least_genes).select("obs")
    return kept.join(cells, "obs", "left_semi")


def qc_metrics(counts: DataFrame, n_obs: int) -> tuple[DataFrame, DataFrame]:
    """Per observation n_genes, total and log1p_total; per gene n_cells, mean (over ``n_obs``), total and the percentage of observations without it."""
    some = F.count(F.when(F.col("value") > 0, 1))
    obs = counts.groupBy("obs").agg(some.alias("n_genes"), F.sum("value").alias("total")).withColumn("log1p_total", F.log1p("total"))
    gene = counts.groupBy("gene").agg(some.alias("n_cells"), F.sum("value").alias("total"))
    return obs, gene.select("gene", "n_cells", "total", (F.col("total") / n_obs).alias("mean"), (100 * (1 - F.col("n_cells") / n_obs)).alias("pct_dropout"))


def expected_expression(abundance: DataFrame, signature: DataFrame, scale: DataFrame, additive: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """obs, cell_type, gene, part and expected: each type's part w g m y of the expected count, and the whole, (sum of w g m + s) y.

    ``abundance``: obs, cell_type, value (w); ``signature``: cell_type, gene, mean
    (g); ``scale``: gene, m; ``additive``: gene, s; ``sensitivity``: obs, y.
    """
    rows = abundance.join(signature, "cell_type").join(scale.join(additive, "gene"), "gene").join(sensitivity, "obs")
    rows = rows.withColumn("part", F.col("value") * F.col("mean") * F.col("m") * F.col("y"))
    whole = F.sum("part").over(Window.partitionBy("obs", "gene")) + F.col("s") * F.col("y")
    return rows.select("obs", "cell_type", "gene", "part", whole.alias("expected"))


def split_by_expectation(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """obs, cell_type, gene, value: each count shared out by the types' parts of its expectation."""
    rows = counts.join(expected, ["obs", "gene"])
    return rows.select("obs", "cell_type", "gene", F.when(F.col("expected") > 0, F.col("value") * F.col("part") / F.col("expected")).otherwise(0.0).alias("value"))


def wilcoxon_markers(expression: DataFrame, labels: DataFrame, top: int = 100) -> DataFrame:
    """cell_type, gene, z and place: the ``top`` genes of each type by the rank sum of its cells against all others.

    Absent entries are zeros that share their ranks; they aren't made, as their
    rank and number follow from the counts.  z is without a correction for ties.
    ``labels``: obs, cell_type; cells without a label take no part.  Ties go to the smaller gene.
    """
    sizes = labels.groupBy("cell_type").agg(F.count("*").alias("n1"))
    n = labels.agg(F.count("*").alias("n"))
    held = expression.where("value <> 0").join(labels, "obs")
    held = stats.with_global_rank(held, "value", "own", by=["gene"])
    per = held.groupBy("gene").agg(F.count(F.when(F.col("value") < 0, 1)).alias("low"), F.count("*").alias("filled"))
    zeros = F.col("n") - F.col("filled")
    shift = F.col("own") + F.when(F.col("value") > 0, F.col("n") - F.col("filled")).otherwise(0)
    sums = held.join(per, "gene").join(n, how="cross").groupBy("gene", "cell_type").agg(F.sum(shift).alias("r"), F.count("*").alias("k"))
    # Types and genes are the result's own size.
    grid = per.join(sizes, how="cross").join(n, how="cross").join(sums, ["gene", "cell_type"], "left").fillna(0, ["r", "k"])
    whole = F.col("r") + (F.col("n1") - F.col("k")) * (F.col("low") + (zeros + 1) / 2)
    z = (whole - F.col("n1") * (F.col("n") + 1) / 2) / F.sqrt(F.col("n1").cast("double") * (F.col("n") - F.col("n1")) * (F.col("n") + 1) / 12.0)
    rows = grid.where("n1 < n").select("cell_type", "gene", z.alias("z"))
    place = F.row_number().over(Window.partitionBy("cell_type").orderBy(F.desc("z"), "gene"))
    return rows.withColumn("place", place).where(F.col("place") <= top)
