"""Registered queries of the engine's operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import matrix, spatial, stats
from . import roles as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

C, S = R.CELLS_SQL, R.SPOTS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # The sum with 0.0 turns a negative zero into zero.
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _ids(df: DataFrame, id_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), "x", "y")


# --- spatial ---------------------------------------------------------------


@query(f"""WITH c AS ({C}), s AS ({S}) SELECT c.cell_id AS query_id, s.spot_id AS base_id, round(sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), 6) AS distance
FROM c JOIN s ON sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= {R.SPOT_RADIUS}""")
def radius_join_euclidean(spark, d):
    return rounded(spatial.radius_join(_ids(R.cells(spark, d), "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), R.SPOT_RADIUS), "distance")


@query(f"""WITH c AS ({C}), s AS ({S}) SELECT c.cell_id AS query_id, s.spot_id AS base_id, round(greatest(abs(c.x - s.x), abs(c.y - s.y)), 6) AS distance
FROM c JOIN s ON greatest(abs(c.x - s.x), abs(c.y - s.y)) <= {R.SPOT_RADIUS}""")
def radius_join_chebyshev(spark, d):
    return rounded(spatial.radius_join(_ids(R.cells(spark, d), "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), R.SPOT_RADIUS, "chebyshev"), "distance")


@query(f"""WITH c AS ({C}), s AS ({S}) SELECT c.cell_id AS query_id, s.spot_id AS base_id, round(sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), 6) AS distance
FROM c JOIN s ON sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= 2 + c.cell_id % 9""")
def radius_join_per_query(spark, d):
    q = R.cells(spark, d).select(F.col("cell_id").alias("query_id"), "x", "y", (2 + F.col("cell_id") % 9).cast("double").alias("reach"))
    return rounded(spatial.radius_join(q, _ids(R.spots(spark, d), "spot_id", "base_id"), "reach"), "distance")


@query(f"""WITH c AS ({C}) SELECT a.cell_id, {", ".join(f"count(*) FILTER (b.cell_type = '{t}') AS n_{t}" for t in R.TYPES)}
FROM c a JOIN c b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25 GROUP BY 1""")
def neighborhood_composition(spark, d):
    return spatial.neighborhood_composition(R.cells(spark, d), 5.0, R.TYPES)


@query(f"""WITH c AS ({C}), s AS ({S}) SELECT cell_id AS query_id FROM c WHERE EXISTS (SELECT 1 FROM s WHERE greatest(abs(c.x - s.x), abs(c.y - s.y)) <= 7)""")
def covered_cells(spark, d):
    return spatial.covered(_ids(R.cells(spark, d), "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), 7.0).select("query_id")


@query(f"""WITH c AS ({C}), s AS ({S}) SELECT cell_id AS query_id FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= {R.SPOT_RADIUS})""")
def uncovered_cells(spark, d):
    return spatial.uncovered(_ids(R.cells(spark, d), "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), R.SPOT_RADIUS).select("query_id")


@query(f"""WITH c AS ({C}), s AS ({S}), p AS (SELECT cell_id, spot_id, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS dist FROM c JOIN s ON greatest(abs(c.x - s.x), abs(c.y - s.y)) <= 40)
SELECT cell_id AS query_id, spot_id AS base_id, round(dist, 6) AS distance FROM p WHERE dist <= 40 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY dist, spot_id) = 1""")
def nearest_spot(spark, d):
    return rounded(spatial.nearest_within(_ids(R.cells(spark, d), "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), 40.0), "distance")


@query(f"""WITH b AS (SELECT CAST(trunc(min(x)) AS BIGINT) AS x0, CAST(trunc(max(x)) AS BIGINT) AS x1, CAST(trunc(min(y)) AS BIGINT) AS y0, CAST(trunc(max(y)) AS BIGINT) AS y1 FROM ({C})),
gx AS (SELECT unnest(range(x0, x1, 5)) AS x FROM b), gy AS (SELECT unnest(range(y0, y1, 5)) AS y FROM b)
SELECT CAST((x - x0) // 5 * len(range(y0, y1, 5)) + (y - y0) // 5 AS BIGINT) AS point_id, x, y FROM gx, gy, b""")
def sr_grid(spark, d):
    return spatial.sr_grid(R.cells(spark, d), 5)


TILES_SQL = f"""SELECT cell_type AS image_id, CAST(ceil(max(x)) AS BIGINT) AS width, CAST(ceil(max(y)) AS BIGINT) AS height FROM ({C}) GROUP BY 1"""


@query(f"""WITH e AS ({TILES_SQL}), t AS (SELECT image_id, width, height, unnest(range(0, height, 192)) AS y0 FROM e), u AS (SELECT *, unnest(range(0, width, 192)) AS x0 FROM t)
SELECT image_id, 1 + y0 // 192 AS row, 1 + x0 // 192 AS col, x0, y0, least(256, width - x0) AS w, least(256, height - y0) AS h FROM u""")
def tile_grid(spark, d):
    e = R.cells(spark, d).groupBy(F.col("cell_type").alias("image_id")).agg(F.ceil(F.max("x")).alias("width"), F.ceil(F.max("y")).alias("height"))
    return spatial.tile_grid(e)


# --- matrices ----------------------------------------------------------------

SC, PC, RC, RL = R.SPOT_COUNTS_SQL, R.PART_COUNTS_SQL, R.REF_COUNTS_SQL, R.REF_LABELS_SQL


@query(f"""SELECT obs, gene, value FROM ({PC}) WHERE gene IN (SELECT user_id FROM events)""")
def gene_align(spark, d):
    """Parts as genes in the suppliers' lines, users as genes in the events: those that both tables hold."""
    events = R.table(spark, d, "events").select(F.col("event_id").alias("obs"), F.col("user_id").alias("gene"), "value")
    return matrix.gene_align(R.part_counts(spark, d), events)[0].select("obs", "gene", "value")


@query(f"""WITH v AS (SELECT obs, gene, greatest(value, 0) AS v FROM ({R.VECTORS_SQL})), t AS (SELECT obs, sum(v) AS s FROM v GROUP BY 1)
SELECT obs, gene, round(v / CASE WHEN s < 1e-12 THEN 1 ELSE s END, 6) AS value FROM v JOIN t USING (obs)""")
def row_normalize(spark, d):
    return rounded(matrix.row_normalize(R.vectors(spark, d)).select("obs", "gene", "value"), "value")


@query(f"""SELECT cell_id, {", ".join(f"CAST(cell_type = '{t}' AS INTEGER) AS is_{t}" for t in R.TYPES)} FROM ({C})""")
def one_hot(spark, d):
    return matrix.one_hot(R.cells(spark, d), R.TYPES).select("cell_id", *[f"is_{t}" for t in R.TYPES])


@query(f"""WITH g AS (SELECT gene, count(*) AS n_cells, sum(value) / count(*) AS nonzero_mean FROM ({RC}) WHERE value > 0 GROUP BY 1), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT gene, n_cells, round(nonzero_mean, 6) AS nonzero_mean FROM g, n WHERE n_cells > n * 0.078 OR (n_cells > 5 AND nonzero_mean > 25.8)""")
def gene_qc_filter(spark, d):
    c = R.ref_counts(spark, d)
    n = c.select("obs").distinct().count()
    return rounded(matrix.gene_qc_filter(c, n, 5, 0.078, 25.8), "nonzero_mean")


@query("SELECT o_orderkey AS obs FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM orders GROUP BY 1 HAVING count(*) >= 6)")
def drop_rare_types(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderdate").alias("cell_type"))
    return matrix.drop_rare_types(o, 6).select("obs")


@query(f"SELECT obs, sum(value) AS n_umi FROM ({RC}) GROUP BY 1 HAVING sum(value) BETWEEN 100 AND 20000000")
def umi_filter(spark, d):
    return matrix.umi_filter(R.ref_counts(spark, d))


@query(f"SELECT gene, sum(value) AS total, count(*) FILTER (value <> 0) AS n_obs FROM ({PC}) GROUP BY 1")
def bulk_vector(spark, d):
    return matrix.bulk_vector(R.part_counts(spark, d))


LN = lambda sql: f"SELECT obs, gene, ln(1 + value / sum(value) OVER (PARTITION BY obs) * 1e4) AS value FROM ({sql})"


@query(f"SELECT obs, gene, round(value, 6) AS value FROM ({LN(PC)})")
def log_normalize(spark, d):
    return rounded(matrix.log_normalize(R.part_counts(spark, d)), "value").select("obs", "gene", "value")


MEANS = lambda counts: f"SELECT cell_type, gene, sum(value) / any_value(n) AS mean FROM ({counts}) JOIN ({RL}) USING (obs) JOIN (SELECT cell_type, count(*) AS n FROM ({RL}) GROUP BY 1) USING (cell_type) GROUP BY 1, 2"


@query(f"SELECT cell_type, gene, round(mean, 6) AS mean FROM ({MEANS(RC)})")
def type_means(spark, d):
    return rounded(matrix.type_means(R.ref_counts(spark, d), R.ref_labels(spark, d)), "mean")


PER_UMI = f"SELECT obs, gene, value / sum(value) OVER (PARTITION BY obs) AS value FROM ({RC})"


@query(f"SELECT cell_type, gene, round(mean, 8) AS mean FROM ({MEANS(PER_UMI)})")
def type_means_numi(spark, d):
    return rounded(matrix.type_means_numi(R.ref_counts(spark, d), R.ref_labels(spark, d)), "mean", digits=8)


@query(f"SELECT cell_type, gene, round(mean, 4) AS mean FROM ({MEANS('SELECT obs, gene, exp(value) - 1 AS value FROM (' + LN(RC) + ')')})")
def signature_means(spark, d):
    return rounded(matrix.signature_means(matrix.log_normalize(R.ref_counts(spark, d)), R.ref_labels(spark, d)), "mean", digits=4)


@query(f"""WITH m AS ({MEANS(PER_UMI)}), k AS (SELECT count(DISTINCT cell_type) AS k FROM m), f AS (
SELECT cell_type, gene, mean, ln(mean + 1e-9) - ln((sum(mean) OVER (PARTITION BY gene) - mean) / (k - 1) + 1e-9) AS log_fold FROM m, k), b AS (SELECT gene FROM ({SC}) GROUP BY 1 HAVING sum(value) >= 3)
SELECT cell_type, gene, round(log_fold, 6) AS log_fold FROM f WHERE log_fold > 0.02 AND mean > 0.000125 AND gene IN (SELECT gene FROM b)""")
def de_genes(spark, d):
    means = matrix.type_means_numi(R.ref_counts(spark, d), R.ref_labels(spark, d))
    return rounded(matrix.de_genes(means, matrix.bulk_vector(R.spot_counts(spark, d)), least_fold=0.02), "log_fold")


@query(f"""WITH n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) SELECT gene, round(ln(1 + sum(100 * (exp(value) - 1)) / any_value(n)), 6) AS level FROM ({LN(SC)}), n GROUP BY 1
HAVING ln(1 + sum(100 * (exp(value) - 1)) / any_value(n)) >= 9.9""")
def high_expr_genes(spark, d):
    c = R.spot_counts(spark, d)
    return rounded(matrix.high_expression_genes(matrix.log_normalize(c), c.select("obs").distinct().count(), 9.9), "level")


@query(f"SELECT label, gene, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM ({R.VECTORS_SQL}) GROUP BY 1, 2")
def posterior_quantiles(spark, d):
    return rounded(matrix.quantiles(R.vectors(spark, d), ["label", "gene"], [0.05, 0.5, 0.95]), "q05", "q50", "q95")


DENSE = "SELECT obs, gene, abs(value) * 10 AS value FROM (" + R.VECTORS_SQL + ")"


@query(f"""WITH v AS ({DENSE}), n AS (SELECT count(DISTINCT obs) AS n FROM v), b AS (SELECT gene, log2(sum(exp(value) - 1) / any_value(n) + 1) AS base FROM v, n GROUP BY 1),
f AS (SELECT obs, v.gene, value - base AS fold FROM v JOIN b USING (gene)), e AS (SELECT obs, avg(fold) AS ma, stddev_pop(fold) AS sa FROM f GROUP BY 1)
SELECT obs, CAST(gene % 4 AS VARCHAR) AS cell_type, round((avg(fold) - any_value(ma)) * sqrt(count(*)) / any_value(sa), 6) AS z FROM f JOIN e USING (obs) GROUP BY 1, 2""")
def page_enrichment(spark, d):
    v = R.vectors(spark, d).select("obs", "gene", (F.abs("value") * 10).alias("value"))
    sig = v.select("gene").distinct().withColumn("cell_type", (F.col("gene") % 4).cast("string"))
    return rounded(matrix.page_enrichment(v, sig, v.select("obs").distinct().count()), "z")


HVG = f"""WITH v AS (SELECT l_suppkey AS obs, l_partkey AS gene, ln(1 + sum(l_quantity)) AS value FROM lineitem GROUP BY 1, 2), n AS (SELECT count(DISTINCT obs) AS n FROM v),
p AS (SELECT gene, sum(exp(value) - 1) / any_value(n) AS mu, sum((exp(value) - 1) ** 2) AS sq, any_value(n) AS n FROM v, n GROUP BY 1),
q AS (SELECT gene, ln(1 + mu) AS mean, ln((sq - n * mu * mu) / (n - 1) / mu) AS dispersion FROM p WHERE mu > 0 AND sq - n * mu * mu > 0),
b AS (SELECT *, least(floor((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20 + 1e-12)), 19) AS bin FROM q),
s AS (SELECT gene, mean, dispersion, CASE WHEN stddev_samp(dispersion) OVER w > 0 THEN (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w ELSE 1 END AS score FROM b WINDOW w AS (PARTITION BY bin))
SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(score, 5) AS score FROM s ORDER BY s.score DESC, gene LIMIT 500"""


@query(HVG)
def hvg_topk(spark, d):
    li = R.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("obs"), F.col("l_partkey").alias("gene")).agg(F.log1p(F.sum("l_quantity")).alias("value"))
    out = matrix.highly_variable_genes(li, li.select("obs").distinct().count(), 500)
    return rounded(rounded(out, "mean", "dispersion"), "score", digits=5)


# --- statistics ----------------------------------------------------------------

TARGET = "SELECT s_suppkey AS obs, s_acctbal AS target FROM supplier"
PEARSON = f"""SELECT gene, any_value(n) AS n, round(corr(coalesce(value, 0), target), 6) AS r FROM (SELECT DISTINCT gene FROM ({PC})) g CROSS JOIN ({TARGET}) t LEFT JOIN ({PC}) c USING (obs, gene), (SELECT count(*) AS n FROM supplier) GROUP BY 1"""


def _target(spark, d):
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs"), F.col("s_acctbal").alias("target"))


@query(PEARSON)
def pearson_by_gene(spark, d):
    return rounded(stats.pearson_by_gene(R.part_counts(spark, d), _target(spark, d)), "r")


@query(f"""WITH f AS (SELECT gene, obs, coalesce(value, 0) AS value, target FROM (SELECT DISTINCT gene FROM ({PC})) g CROSS JOIN ({TARGET}) t LEFT JOIN ({PC}) c USING (obs, gene)),
r AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY gene ORDER BY target) + (count(*) OVER (PARTITION BY gene, target) - 1) / 2 AS rt FROM f)
SELECT gene, count(*) AS n, round(corr(rv, rt), 6) AS r FROM r GROUP BY 1""")
def spearman_by_gene(spark, d):
    return rounded(stats.spearman_by_gene(R.part_counts(spark, d), _target(spark, d)), "r")


@query()
def correlation_significance(spark, d):
    """gene, r, p and adjusted p, the strongest first; its p needs Student's t, which SQL lacks."""
    r = stats.pearson_by_gene(R.part_counts(spark, d), _target(spark, d)).withColumn("p", stats.correlation_p("r", "n"))
    return rounded(stats.benjamini_hochberg(r), "r", "p", "p_adjust").orderBy(F.desc("r"), "gene")


P_SQL = "SELECT o_custkey % 10 AS family, o_orderkey AS test, round(o_totalprice / 600000, 3) AS p FROM orders"


@query(f"""WITH t AS ({P_SQL}), r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / (rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1) AS raw FROM t)
SELECT family, test, p, round(least(1, min(raw) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS p_adjust FROM r""")
def bh_adjust(spark, d):
    t = R.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("family"), F.col("o_orderkey").alias("test"), F.round(F.col("o_totalprice") / 600000, 3).alias("p"))
    return rounded(stats.benjamini_hochberg(t, "p", ["family"]), "p_adjust", digits=8)


SETS = "SELECT p_brand AS set_id, p_partkey AS gene FROM part"
HITS = "SELECT p_partkey AS gene FROM part WHERE p_size >= 45 OR (p_brand = 'Brand#7' AND p_size >= 30)"
ORA = f"""WITH sets AS ({SETS}), hits AS ({HITS}), u AS (SELECT count(*) AS n FROM part), m AS (SELECT count(*) AS m FROM hits),
o AS (SELECT set_id, count(*) AS set_size, count(*) FILTER (gene IN (SELECT gene FROM hits)) AS overlap FROM sets GROUP BY 1),
x AS (SELECT set_id, set_size, overlap, m AS n_hits, n, unnest(generate_series(greatest(overlap, 0), least(set_size, m))) AS i FROM o, u, m),
p AS (SELECT set_id, set_size, overlap, n_hits, CASE WHEN overlap = 0 THEN 1.0 ELSE least(1.0, sum(exp(lgamma(set_size + 1) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(n - set_size + 1) - lgamma(n_hits - i + 1) - lgamma(n - set_size - n_hits + i + 1) - lgamma(n + 1) + lgamma(n_hits + 1) + lgamma(n - n_hits + 1)))) END AS p FROM x GROUP BY ALL)"""


@query(ORA.replace("GROUP BY ALL)", "GROUP BY set_id, set_size, overlap, n_hits, n)") + """
SELECT set_id, set_size, overlap, n_hits, round(p, 6) AS p FROM p""")
def gene_overlap_hypergeom(spark, d):
    return _ora(spark, d).select("set_id", "set_size", "overlap", "n_hits", "p")


@query(ORA.replace("GROUP BY ALL)", "GROUP BY set_id, set_size, overlap, n_hits, n)") + """,
r AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS raw FROM p)
SELECT set_id, set_size, overlap, n_hits, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjust FROM r""")
def ora_enrichment(spark, d):
    return _ora(spark, d)


def _ora(spark, d):
    part = R.table(spark, d, "part")
    hits = part.where("p_size >= 45 or (p_brand = 'Brand#7' and p_size >= 30)").select(F.col("p_partkey").alias("gene"))
    sets = part.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("gene"))
    return rounded(stats.overlap_test(sets, hits, part.count()), "p", "p_adjust")


# --- small operators ----------------------------------------------------------------


@query(f"""WITH g AS (SELECT gene FROM ({SC}) WHERE value <> 0 GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT * FROM ({SC}) WHERE gene IN (SELECT gene FROM g))
SELECT obs, gene, value FROM k WHERE obs IN (SELECT obs FROM k WHERE value <> 0 GROUP BY 1 HAVING count(*) >= 20)""")
def drop_empty(spark, d):
    return matrix.drop_empty(R.spot_counts(spark, d), 5, 20).select("obs", "gene", "value")


@query(f"SELECT obs, count(*) FILTER (value > 0) AS n_genes, sum(value) AS total, round(ln(1 + sum(value)), 6) AS log1p_total FROM ({RC}) GROUP BY 1")
def qc_by_cell(spark, d):
    return rounded(matrix.qc_metrics(R.ref_counts(spark, d), 1)[0], "log1p_total")


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders) SELECT gene, count(*) FILTER (value > 0) AS n_cells, sum(value) AS total, round(sum(value) / any_value(n), 6) AS mean, round(100 * (1 - count(*) FILTER (value > 0) / any_value(n)), 6) AS pct_dropout FROM ({RC}), n GROUP BY 1""")
def qc_by_gene(spark, d):
    return rounded(matrix.qc_metrics(R.ref_counts(spark, d), R.table(spark, d, "orders").count())[1], "mean", "pct_dropout")


WILCOXON = f"""WITH l AS ({RL}), g AS (SELECT DISTINCT gene FROM ({RC})), f AS (SELECT gene, cell_type, coalesce(value, 0) AS value FROM g CROSS JOIN l LEFT JOIN ({RC}) USING (obs, gene)),
r AS (SELECT gene, cell_type, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS k, count(*) OVER (PARTITION BY gene) AS n FROM f),
z AS (SELECT cell_type, gene, (sum(k) - count(*) * (any_value(n) + 1) / 2) / sqrt(count(*) * (any_value(n) - count(*)) * (any_value(n) + 1) / 12.0) AS z FROM r GROUP BY 1, 2)
SELECT cell_type, gene, round(z, 6) AS z, row_number() OVER (PARTITION BY cell_type ORDER BY z DESC, gene) AS place FROM z QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY z DESC, gene) <= 100"""


@query(WILCOXON)
def wilcoxon_markers(spark, d):
    return rounded(matrix.wilcoxon_markers(R.ref_counts(spark, d), R.ref_labels(spark, d)), "z")


PARTS = f"""SELECT s.obs, cell_type, gene, s.value * mean * m * y AS part, sum(s.value * mean * m * y) OVER (PARTITION BY s.obs, gene) + a * y AS expected
FROM (SELECT l_suppkey AS obs, o_orderpriority AS cell_type, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) s JOIN ({MEANS(RC)}) USING (cell_type)
JOIN (SELECT l_partkey % 50 AS gene, avg(l_discount) + 1 AS m, avg(l_tax) AS a FROM lineitem GROUP BY 1) USING (gene) JOIN (SELECT s_suppkey AS obs, 1 + s_nationkey / 25 AS y FROM supplier) USING (obs)"""


def _expected(spark, d):
    li, orders = R.table(spark, d, "lineitem"), R.table(spark, d, "orders")
    abundance = li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).groupBy(F.col("l_suppkey").alias("obs"), F.col("o_orderpriority").alias("cell_type")).agg(F.count("*").alias("value"))
    per = li.groupBy((F.col("l_partkey") % 50).alias("gene")).agg((F.avg("l_discount") + 1).alias("m"), F.avg("l_tax").alias("s"))
    y = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs"), (1 + F.col("s_nationkey") / 25).alias("y"))
    return matrix.expected_expression(abundance, matrix.type_means(R.ref_counts(spark, d), R.ref_labels(spark, d)), per.select("gene", "m"), per.select("gene", "s"), y)


@query(f"SELECT obs, cell_type, gene, round(part, 6) AS part, round(expected, 6) AS expected FROM ({PARTS})")
def expected_expression(spark, d):
    return rounded(_expected(spark, d), "part", "expected")


@query(f"SELECT obs, cell_type, gene, round(CASE WHEN expected > 0 THEN c.value * part / expected ELSE 0 END, 6) AS value FROM ({PARTS}) JOIN ({SC}) c USING (obs, gene)")
def expectation_split(spark, d):
    return rounded(matrix.split_by_expectation(_expected(spark, d), R.spot_counts(spark, d)), "value")


MASK = "SELECT DISTINCT CAST(floor(value) AS BIGINT) AS x, CAST(60 * hour(ts) + minute(ts) AS BIGINT) AS y FROM events"


@query(f"""WITH b AS (SELECT CAST(trunc(min(x)) AS BIGINT) AS x0, CAST(trunc(max(x)) AS BIGINT) AS x1, CAST(trunc(min(y)) AS BIGINT) AS y0, CAST(trunc(max(y)) AS BIGINT) AS y1 FROM ({C}))
SELECT x, y FROM (SELECT unnest(range(x0, x1, 5)) AS x, y0, y1 FROM b), LATERAL (SELECT unnest(range(y0, y1, 5)) AS y) WHERE x < 300 AND y < 1000 AND (x, y) IN ({MASK})""")
def inside_mask(spark, d):
    mask = R.table(spark, d, "events").select(F.floor("value").alias("x"), (60 * F.hour("ts") + F.minute("ts")).alias("y")).distinct()
    return spatial.inside_mask(spatial.sr_grid(R.cells(spark, d), 5), mask, 300, 1000).select("x", "y")


@query(f"SELECT a.cell_type AS first, b.cell_type AS second FROM (SELECT DISTINCT cell_type FROM ({C})) a JOIN (SELECT DISTINCT cell_type FROM ({C})) b ON a.cell_type < b.cell_type")
def type_pairs(spark, d):
    return spatial.type_pairs(R.cells(spark, d))


@query(f"SELECT c.cell_id, c.cell_type, s.spot_id FROM ({C}) c LEFT JOIN (SELECT cell_id, min(spot_id) AS spot_id FROM ({C}) c JOIN ({S}) s ON sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= {R.SPOT_RADIUS} GROUP BY 1) s USING (cell_id)")
def onto_cells(spark, d):
    cells = R.cells(spark, d)
    near = spatial.radius_join(_ids(cells, "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), R.SPOT_RADIUS)
    spot = near.groupBy(F.col("query_id").alias("cell_id")).agg(F.min("base_id").alias("spot_id"))
    return spatial.onto_cells(cells.select("cell_id", "cell_type"), spot)
