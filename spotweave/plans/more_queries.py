"""Registered queries of annotation, prediction, deconvolution and detection."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import annotate, deconv, detect, ensemble, interaction, matrix, predict, spatial
from ..sources.io import cut_lineage
from . import roles as R
from .queries import C, S, _ids, query, rounded

M = R.METHODS_SQL
METHODS = ["lines", "price", "quantity"]

# --- ensemble ------------------------------------------------------------------


@query(f"""WITH w AS (SELECT *, CASE method WHEN 'quantity' THEN 0.5 WHEN 'price' THEN 0.3 ELSE 0.2 END AS w FROM ({M})),
s AS (SELECT *, sum(w) OVER (PARTITION BY spot_id, cell_type ORDER BY value) / sum(w) OVER (PARTITION BY spot_id, cell_type) AS share FROM w)
SELECT spot_id, cell_type, round(min(value), 6) AS value FROM s WHERE share >= 0.5 GROUP BY 1, 2""")
def weighted_median(spark, d):
    w = F.when(F.col("method") == "quantity", 0.5).when(F.col("method") == "price", 0.3).otherwise(0.2)
    return rounded(ensemble.weighted_median(R.method_proportions(spark, d).withColumn("weight", w), ["spot_id", "cell_type"]), "value")


@query(f"""WITH m AS ({M}), h AS (SELECT spot_id, cell_type, avg(value) AS h FROM m GROUP BY 1, 2) SELECT method, round(sum(abs(value - h)), 6) AS l1 FROM m JOIN h USING (spot_id, cell_type) GROUP BY 1""")
def l1_to_consensus(spark, d):
    m = R.method_proportions(spark, d)
    return rounded(ensemble.l1_to_consensus(m, m.groupBy("spot_id", "cell_type").agg(F.avg("value").alias("consensus"))), "l1")


THREE = """SELECT l_suppkey AS spot_id, 'lines' AS method, l_returnflag AS cell_type, count(*) AS value FROM lineitem GROUP BY 1, 3 UNION ALL
SELECT user_id, 'events', event_type, count(*) FROM events GROUP BY 1, 3 UNION ALL SELECT o_custkey, 'orders', o_orderpriority, count(*) FROM orders GROUP BY 1, 3"""


@query(f"""WITH m AS ({THREE}) SELECT spot_id, method, cell_type, value FROM m WHERE spot_id IN (SELECT spot_id FROM m GROUP BY 1 HAVING count(DISTINCT method) = 3)""")
def common_spots(spark, d):
    """Ids that suppliers' lines, users' events and customers' orders share."""
    m = None
    for name, at, kind, method in (("lineitem", "l_suppkey", "l_returnflag", "lines"), ("events", "user_id", "event_type", "events"), ("orders", "o_custkey", "o_orderpriority", "orders")):
        rows = R.table(spark, d, name).groupBy(F.col(at).cast("bigint").alias("spot_id"), F.lit(method).alias("method"), F.col(kind).alias("cell_type")).agg(F.count("*").alias("value"))
        m = rows if m is None else m.unionByName(rows)
    return ensemble.common_spots(m, 3).select("spot_id", "method", "cell_type", "value")


def _endecon_sql(rounds: int) -> str:
    v = ", ".join(f"coalesce(max(value) FILTER (method = '{m}'), 0) AS v{i}" for i, m in enumerate(METHODS))
    out = [f"b AS (SELECT spot_id, cell_type, {v} FROM ({M}) GROUP BY 1, 2)", "h0 AS (SELECT *, (v0 + v1 + v2) / 3 AS h FROM b)"]
    for k in range(1, rounds + 1):
        out.append(f"l{k} AS (SELECT sum(abs(v0 - h)) AS a, sum(abs(v1 - h)) AS b, sum(abs(v2 - h)) AS c FROM h{k - 1})")
        out.append(f"e{k} AS (SELECT exp(-(l{k}.a - least(l{k}.a, l{k}.b, l{k}.c)) / s) AS a, exp(-(l{k}.b - least(l{k}.a, l{k}.b, l{k}.c)) / s) AS b, exp(-(l{k}.c - least(l{k}.a, l{k}.b, l{k}.c)) / s) AS c FROM l{k}, (SELECT list_sort([a, b, c])[2] AS s FROM l1))")
        out.append(f"w{k} AS (SELECT a / (a + b + c) AS w0, b / (a + b + c) AS w1, c / (a + b + c) AS w2 FROM e{k})")
        out.append(f"s{k} AS (SELECT spot_id, cell_type, v0, v1, v2, list_sort([{{'v': v0, 'w': w0}}, {{'v': v1, 'w': w1}}, {{'v': v2, 'w': w2}}]) AS s, w0 + w1 + w2 AS t FROM b, w{k})")
        out.append(f"h{k} AS (SELECT spot_id, cell_type, v0, v1, v2, CASE WHEN s[1].w / t >= 0.5 THEN s[1].v WHEN (s[1].w + s[2].w) / t >= 0.5 THEN s[2].v ELSE s[3].v END AS h FROM s{k})")
    return f"WITH {', '.join(out)} SELECT spot_id, cell_type, round(h / sum(h) OVER (PARTITION BY spot_id), 6) AS value FROM h{rounds}"


@query(_endecon_sql(3))
def endecon_ensemble(spark, d):
    return rounded(ensemble.endecon(R.method_proportions(spark, d), METHODS, iterations=3, tol=0.0)[0], "value")


@query()
def endecon_consensus(spark, d):
    """The converged consensus; ends by its objective, so without SQL (``endecon_ensemble`` holds three rounds of it against SQL)."""
    return rounded(ensemble.endecon(R.method_proportions(spark, d), METHODS)[0], "value")


# --- annotation ------------------------------------------------------------------

#: Each cell's spot (the nearest within the radius).
IN_SPOT = f"SELECT cell_id, min(spot_id) AS spot_id, any_value(cell_type) AS cell_type, any_value(x) AS x FROM (SELECT c.*, s.spot_id FROM ({C}) c JOIN ({S}) s ON sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= {R.SPOT_RADIUS}) GROUP BY 1"


def in_spot(spark, d):
    cells = R.cells(spark, d)
    near = spatial.radius_join(_ids(cells, "cell_id", "query_id"), _ids(R.spots(spark, d), "spot_id", "base_id"), R.SPOT_RADIUS)
    one = near.groupBy(F.col("query_id").alias("cell_id")).agg(F.min("base_id").alias("spot_id"))
    return one.join(cells.select("cell_id", "cell_type", "x"), "cell_id")


#: Per spot and type: cells in the spot, and the type's share of their total value.
SHARES = f"SELECT spot_id, cell_type, sum(v) OVER (PARTITION BY spot_id) AS total, value FROM (SELECT spot_id, cell_type, count(*) AS v, sum(x) AS value FROM ({IN_SPOT}) GROUP BY 1, 2)"


def shares(spark, d):
    per = in_spot(spark, d).groupBy("spot_id", "cell_type").agg(F.count("*").alias("v"), F.sum("x").alias("value"))
    return per.select("spot_id", "cell_type", F.sum("v").over(Window.partitionBy("spot_id")).alias("total"), "value")


def _quota_sql(rows: str, part: str) -> str:
    over = f"OVER (PARTITION BY {part})"
    return f"""SELECT * EXCLUDE (raw, f, l, total, value), f + CAST(row_number() OVER (PARTITION BY {part} ORDER BY round(raw - f, 9) DESC, cell_type) <= l AS BIGINT) AS quota FROM (
SELECT *, CAST(total - sum(f) {over} AS BIGINT) AS l FROM (SELECT *, CAST(floor(raw) AS BIGINT) AS f FROM (SELECT *, value / sum(value) {over} * total AS raw FROM ({rows}))))"""


QUOTAS = _quota_sql(SHARES, "spot_id")


@query(QUOTAS)
def largest_remainder_quota(spark, d):
    return annotate.largest_remainder(shares(spark, d), ["spot_id"]).select("spot_id", "cell_type", "quota")


@query(f"SELECT cell_type, quota FROM ({_quota_sql(f'SELECT 1 AS g, cell_type, sum(count(*)) OVER () AS total, sum(x) AS value FROM ({C}) GROUP BY 2', 'g')})")
def global_quota(spark, d):
    per = R.cells(spark, d).groupBy("cell_type").agg(F.count("*").alias("n"), F.sum("x").alias("value")).withColumn("g", F.lit(1))
    per = per.withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    return annotate.largest_remainder(per, ["g"]).select("cell_type", "quota")


SR = f"SELECT DISTINCT CAST(floor(x / 8) AS BIGINT) * 10000 + CAST(floor(y / 8) AS BIGINT) AS point_id, floor(x / 8) * 8 + 4 AS x, floor(y / 8) * 8 + 4 AS y FROM ({C})"
SR_IN = f"SELECT p.point_id, c.cell_id, c.cell_type FROM ({SR}) p JOIN ({C}) c ON greatest(abs(c.x - p.x), abs(c.y - p.y)) <= 8"
SCORES = f"""SELECT cell_id, r.cell_type, sum(r.value / n) AS score FROM ({SR_IN}) m JOIN (SELECT point_id, count(*) AS n FROM ({SR_IN}) GROUP BY 1) USING (point_id)
JOIN (SELECT point_id, cell_type, count(*) / sum(count(*)) OVER (PARTITION BY point_id) AS value FROM ({SR_IN}) GROUP BY 1, 2) r USING (point_id) GROUP BY 1, 2"""


def scores(spark, d):
    cells = R.cells(spark, d)
    at = cells.select(F.floor(F.col("x") / 8).alias("gx"), F.floor(F.col("y") / 8).alias("gy")).distinct()
    points = at.select((F.col("gx") * 10000 + F.col("gy")).alias("base_id"), (F.col("gx") * 8 + 4).cast("double").alias("x"), (F.col("gy") * 8 + 4).cast("double").alias("y"))
    pairs = spatial.radius_join(_ids(cells, "cell_id", "query_id"), points, 8.0, "chebyshev")
    member = pairs.select(F.col("base_id").alias("point_id"), F.col("query_id").alias("cell_id"))
    per = member.join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("point_id", "cell_type").agg(F.count("*").alias("k"))
    ratios = per.select("point_id", "cell_type", (F.col("k") / F.sum("k").over(Window.partitionBy("point_id"))).alias("value"))
    return annotate.segment_scores(member, ratios)


@query(f"SELECT cell_id, cell_type, round(score, 6) AS score FROM ({SCORES})")
def segment_scores(spark, d):
    # Sums of k / n^2 can lie halfway between two results; the first rounding takes away what the order of a sum leaves in its last bits.
    return rounded(rounded(scores(spark, d), "score", digits=12), "score")


MORPH = f"SELECT *, CASE cell_id % 6 WHEN 1 THEN 'Neoplastic cells' WHEN 2 THEN 'Inflammatory' WHEN 3 THEN 'Connective/Soft tissue cells' WHEN 5 THEN 'Epithelial' END AS morphology FROM ({IN_SPOT}) WHERE cell_id % 6 IN (1, 2, 3, 5)"


def morphologies(spark, d):
    return annotate.morphology_types(in_spot(spark, d).withColumn("img_type", F.col("cell_id") % 6))


@query(f"SELECT morphology, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({MORPH}) GROUP BY 1")
def morphology_counts(spark, d):
    n = morphologies(spark, d).groupBy("morphology").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))), "share")


COST = f"""WITH t AS (SELECT spot_id, cell_type, CAST(quota AS DOUBLE) AS u FROM ({QUOTAS})), m AS (SELECT spot_id, morphology, CAST(count(*) AS DOUBLE) AS v FROM ({MORPH}) GROUP BY 1, 2),
a AS (SELECT cell_type, sqrt(sum(u * u)) AS na FROM t GROUP BY 1), b AS (SELECT morphology, sqrt(sum(v * v)) AS nb FROM m GROUP BY 1), d AS (SELECT cell_type, morphology, sum(u * v) AS dot FROM t JOIN m USING (spot_id) GROUP BY 1, 2)
SELECT cell_type, morphology, round((1 - coalesce(dot, 0) / (na * nb)) / CASE WHEN cell_type = 'click' AND morphology = 'Epithelial' THEN 2 ELSE 1 END, 6) AS cost FROM a CROSS JOIN b LEFT JOIN d USING (cell_type, morphology)"""


def cost_table(spark, d):
    types = annotate.largest_remainder(shares(spark, d), ["spot_id"]).select("spot_id", "cell_type", F.col("quota").cast("double").alias("value"))
    morph = morphologies(spark, d).groupBy("spot_id", "morphology").agg(F.count("*").cast("double").alias("value"))
    priors = types.where("cell_type = 'click'").select("cell_type").distinct().withColumn("morphology", F.lit("Epithelial"))
    return annotate.cosine_cost(types, morph, priors)


@query(COST)
def morphology_cost(spark, d):
    return rounded(cost_table(spark, d), "cost")


@query()
def ot_transfer(spark, d):
    """P(type | morphology) by entropic transport; iterative, so without SQL."""
    share = R.cells(spark, d).groupBy("cell_type").agg(F.count("*").cast("double").alias("value"))
    morph = morphologies(spark, d).groupBy("morphology").agg(F.count("*").cast("double").alias("value"))
    return rounded(annotate.type_transfer(cost_table(spark, d), share, morph), "p")


@query()
def constrained_assignment(spark, d):
    """Exact assignment under each spot's quotas; an optimisation, so without SQL."""
    quotas = annotate.largest_remainder(shares(spark, d), ["spot_id"]).select("spot_id", "cell_type", "quota")
    return annotate.constrained_assignment(scores(spark, d), in_spot(spark, d).select("cell_id", "spot_id"), quotas, R.TYPES)


@query(f"SELECT spot_id, cell_type, quota AS n FROM ({QUOTAS}) WHERE quota > 0")
def assignment_counts(spark, d):
    """How many cells of each type the exact assignment puts into each spot: its quotas."""
    out = constrained_assignment(spark, d).where("spot_id is not null")
    return out.groupBy("spot_id", F.col("pred_cell_type").alias("cell_type")).agg(F.count("*").alias("n"))


# --- prediction ------------------------------------------------------------------

SPLIT = f"""WITH p AS (SELECT spot_id, cell_type, value AS beta FROM ({M}) WHERE method = 'quantity'),
mu AS (SELECT l_returnflag AS cell_type, l_partkey % 50 AS gene, avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2), y AS (SELECT obs AS spot_id, gene, value AS y FROM ({R.SPOT_COUNTS_SQL})),
r AS (SELECT cell_type, spot_id, gene, beta * mean * y / sum(beta * mean) OVER (PARTITION BY spot_id, gene) AS v FROM y JOIN mu USING (gene) JOIN p USING (spot_id, cell_type))
SELECT cell_type, spot_id, gene, round(ln(1 + v / (sum(v) OVER (PARTITION BY cell_type, spot_id) + 1e-3) * 1e4), 6) AS value FROM r"""


@query(SPLIT)
def spot_expression_split(spark, d):
    props = R.method_proportions(spark, d).where("method = 'quantity'").select("spot_id", "cell_type", "value")
    li = R.table(spark, d, "lineitem")
    means = li.groupBy(F.col("l_returnflag").alias("cell_type"), (F.col("l_partkey") % 50).alias("gene")).agg(F.avg("l_quantity").alias("mean"))
    return rounded(predict.split_expression(props, means, R.spot_counts(spark, d).withColumnRenamed("obs", "spot_id")), "value")


GRAPH = f"""WITH c AS ({C}), e AS (SELECT a.cell_id AS src, b.cell_id AS dst, 1 / (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) + 1e-6) AS w FROM c a JOIN c b ON a.cell_type = b.cell_type AND a.cell_id <> b.cell_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6),
f AS (SELECT * FROM e UNION ALL SELECT src, src, avg(w) FROM e GROUP BY 1), g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM f UNION ALL SELECT cell_id, cell_id, 1.0 FROM c WHERE cell_id NOT IN (SELECT src FROM e))"""


@query(GRAPH + " SELECT src, dst, round(w, 6) AS w FROM g")
def neighbor_graph(spark, d):
    return rounded(predict.radius_graph(R.cells(spark, d), 6.0), "w")


START = f"""v0 AS (SELECT c.cell_id, t.gene, s.spot_id IS NOT NULL AS labeled, CASE WHEN s.spot_id IS NULL THEN 0.0 ELSE CAST(coalesce(n.k, 0) AS DOUBLE) END AS value
FROM c CROSS JOIN (SELECT DISTINCT event_type AS gene FROM events) t LEFT JOIN ({IN_SPOT}) s USING (cell_id) LEFT JOIN (SELECT spot_id, cell_type AS gene, count(*) AS k FROM ({IN_SPOT}) GROUP BY 1, 2) n ON n.spot_id = s.spot_id AND n.gene = t.gene)"""
STEP = "v{k} AS (SELECT v.cell_id, v.gene, labeled, CASE WHEN labeled THEN v.value / 1.1 + (1 - 1 / 1.1) * m.mean ELSE m.mean END AS value FROM v{p} v JOIN (SELECT src AS cell_id, gene, sum(w * value) AS mean FROM g JOIN v{p} ON dst = cell_id GROUP BY 1, 2) m USING (cell_id, gene))"


def diffusion_start(spark, d):
    """The cells with the counts of each type in their spot (``v``), and whether they are in one."""
    inside = cut_lineage(in_spot(spark, d).select("cell_id", "spot_id", "cell_type"))
    counts = inside.groupBy("spot_id").agg(F.array(*[F.count(F.when(F.col("cell_type") == t, 1)).cast("double") for t in R.TYPES]).alias("k"))
    rows = R.cells(spark, d).join(inside.select("cell_id", "spot_id"), "cell_id", "left").join(counts, "spot_id", "left")
    return rows.select("cell_id", "cell_type", "x", "y", F.col("spot_id").isNotNull().alias("labeled"), F.coalesce("k", F.array(*[F.lit(0.0)] * len(R.TYPES))).alias("v"))


def _by_gene(values):
    genes = F.array(*[F.lit(t) for t in R.TYPES])
    return rounded(values.select("cell_id", "labeled", F.inline(F.arrays_zip(genes.alias("gene"), F.col("v").alias("value")))), "value").select("cell_id", "gene", "labeled", "value")


@query(GRAPH + ", " + START + ", " + STEP.format(k=1, p=0) + ", " + STEP.format(k=2, p=1) + " SELECT cell_id, gene, labeled, round(value, 6) AS value FROM v2")
def label_diffusion(spark, d):
    return _by_gene(predict.near_step(predict.near_step(diffusion_start(spark, d), 6.0), 6.0))


@query()
def label_diffusion_full(spark, d):
    """Diffusion to its end; ends by its change, so without SQL (``label_diffusion`` holds two steps of it against SQL)."""
    return _by_gene(predict.diffuse_near(diffusion_start(spark, d), 6.0))


@query()
def delaunay_graph(spark, d):
    """The weighted Delaunay graph of each type's cells, in tiles with a halo; a triangulation, so without SQL."""
    return rounded(predict.delaunay_graph(R.cells(spark, d), 120.0, 60.0), "w")


# --- deconvolution ------------------------------------------------------------------


def _signature(spark, d, numi=False):
    f = matrix.type_means_numi if numi else matrix.type_means
    return f(R.ref_counts(spark, d), R.ref_labels(spark, d))


@query()
def nnls_deconv(spark, d):
    """Supplier proportions by non-negative least squares (a numeric solver, so without SQL, as the next two)."""
    return rounded(deconv.nnls_deconv(R.spot_counts(spark, d), _signature(spark, d)), "value")


@query()
def dwls_deconv(spark, d):
    return rounded(deconv.dwls_deconv(R.spot_counts(spark, d), _signature(spark, d)), "value")


@query()
def rctd_full(spark, d):
    return rounded(deconv.rctd_full(R.spot_counts(spark, d), _signature(spark, d, True)), "value")


@query(f"SELECT gene, arg_max(cell_type, mean) AS cell_type FROM (SELECT cell_type, gene, mean FROM ({{}}) ORDER BY gene, mean DESC, cell_type) GROUP BY 1".format("SELECT cell_type, gene, sum(value) / any_value(n) AS mean FROM (" + R.REF_COUNTS_SQL + ") JOIN (" + R.REF_LABELS_SQL + ") USING (obs) JOIN (SELECT cell_type, count(*) AS n FROM (" + R.REF_LABELS_SQL + ") GROUP BY 1) USING (cell_type) GROUP BY 1, 2"))
def marker_types(spark, d):
    return matrix.marker_types(_signature(spark, d))


@query(f"""WITH t AS (SELECT cell_id % 7 AS cluster, cell_type, max(x) / 100 AS z FROM ({C}) GROUP BY 1, 2), n AS (SELECT *, count(*) FILTER (z > 3.5) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, cell_type) AS p FROM t)
SELECT cluster, cell_type, z FROM n WHERE (n >= 2 AND z > 3.5) OR (n < 2 AND p <= 2)""")
def candidate_types(spark, d):
    rows = R.cells(spark, d).select((F.col("cell_id") % 7).alias("cluster"), "cell_type", (F.col("x") / 100).alias("z"))
    return matrix.candidate_types(rows, 3.5)


@query(f"SELECT cell_id, cell_type FROM ({C}) QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY md5(CAST(cell_id AS VARCHAR) || '|7'), cell_id) <= 300")
def stratified_sample(spark, d):
    return matrix.stratified_sample(R.cells(spark, d), "cell_type", "cell_id", 300, 7).select("cell_id", "cell_type")


# --- interaction ------------------------------------------------------------------

ENV = f"SELECT a.cell_id, a.cell_type, count(*) FILTER (b.cell_type = 'error') AS target FROM ({C}) a JOIN ({C}) b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25 WHERE a.cell_type = 'click' GROUP BY 1, 2"


@query(f"""WITH t AS ({ENV}), v AS (SELECT event_id AS cell_id, user_id % 20 AS gene, ln(1 + value) AS value FROM events WHERE event_type = 'click'),
h AS (SELECT gene FROM v GROUP BY 1 HAVING ln(1 + sum(100 * (exp(value) - 1)) / (SELECT count(*) FROM t)) >= 5.5)
SELECT gene, count(*) AS n, round(corr(coalesce(value, 0), CAST(target AS DOUBLE)), 6) AS r FROM h CROSS JOIN t LEFT JOIN v USING (cell_id, gene) GROUP BY 1""")
def interaction_pairs(spark, d):
    expression = R.table(spark, d, "events").select(F.col("event_id").alias("obs"), (F.col("user_id") % 20).alias("gene"), F.log1p("value").alias("value"))
    return rounded(interaction.analyze_interaction(R.cells(spark, d), expression, "click", "error", 5.0, R.TYPES, 5.5), "r")


# --- detection ------------------------------------------------------------------

BOXES = """SELECT event_id AS cell_id, CAST(1 + floor(y / 192) AS BIGINT) AS patch_row, CAST(1 + floor(x / 192) AS BIGINT) AS patch_col, r AS rmin, c AS cmin, least(256, r + 10 + event_id % 80) AS rmax, least(256, c + 8 + user_id % 70) AS cmax FROM (
SELECT event_id, user_id, value AS x, 60 * hour(ts) + minute(ts) AS y, CAST(60 * hour(ts) + minute(ts) AS BIGINT) % 192 AS r, CAST(floor(value) AS BIGINT) % 192 AS c FROM events)"""


def boxes(spark, d):
    y = (60 * F.hour("ts") + F.minute("ts")).cast("bigint")
    e = R.table(spark, d, "events").select("event_id", "user_id", (y % 192).alias("r"), (F.floor("value") % 192).alias("c"), F.col("value").alias("x"), y.alias("y"))
    return e.select(
        F.col("event_id").alias("cell_id"),
        (1 + F.floor(F.col("y") / 192)).alias("patch_row"),
        (1 + F.floor(F.col("x") / 192)).alias("patch_col"),
        F.col("r").alias("rmin"),
        F.col("c").alias("cmin"),
        F.least(F.lit(256), F.col("r") + 10 + F.col("event_id") % 80).alias("rmax"),
        F.least(F.lit(256), F.col("c") + 8 + F.col("user_id") % 70).alias("cmax"),
    ).withColumn("centroid_x", (F.col("cmin") + F.col("cmax")) / 2).withColumn("centroid_y", (F.col("rmin") + F.col("rmax")) / 2)


STATUS = """CASE WHEN NOT (greatest(rmin, cmin, rmax, cmax) > 192 OR least(rmin, cmin, rmax, cmax) < 64) THEN 0
WHEN rmin < 64 THEN CASE WHEN cmin < 64 THEN 1 WHEN cmax > 192 THEN 3 ELSE 2 END WHEN cmax > 192 THEN CASE WHEN rmax > 192 THEN 5 ELSE 4 END
WHEN rmax > 192 THEN CASE WHEN cmin < 64 THEN 7 ELSE 6 END WHEN cmin < 64 THEN 8 END"""


@query(f"""SELECT cell_id, rmin + (patch_row - 1) * 192 AS rmin, cmin + (patch_col - 1) * 192 AS cmin, rmax + (patch_row - 1) * 192 AS rmax, cmax + (patch_col - 1) * 192 AS cmax,
(cmin + cmax) / 2 + (patch_col - 1) * 192 AS centroid_x, (rmin + rmax) / 2 + (patch_row - 1) * 192 AS centroid_y FROM ({BOXES})""")
def instance_global_coords(spark, d):
    return detect.instance_records(boxes(spark, d)).select("cell_id", "rmin", "cmin", "rmax", "cmax", "centroid_x", "centroid_y")


@query(f"SELECT cell_id, {STATUS} AS cell_status, greatest(rmin, cmin, rmax, cmax) = 256 OR least(rmin, cmin, rmax, cmax) = 0 AS edge_position FROM ({BOXES})")
def cell_status(spark, d):
    return detect.instance_records(boxes(spark, d)).select("cell_id", "cell_status", "edge_position")


EDGE = f"""SELECT *, {STATUS} AS st, greatest(rmin, cmin, rmax, cmax) = 256 OR least(rmin, cmin, rmax, cmax) = 0 AS edge,
concat(CAST(rmin = 0 AS INT), CAST(cmax = 256 AS INT), CAST(rmax = 256 AS INT), CAST(cmin = 0 AS INT)) AS pos FROM ({BOXES})"""
FIRST = {"1000": (-1, 0), "1100": (-1, 0), "0100": (0, 1), "0110": (0, 1), "0010": (1, 0), "0011": (1, 0), "0001": (0, -1), "1001": (0, -1)}


@query(f"""WITH r AS ({EDGE}), e AS (SELECT *, CASE pos {" ".join(f"WHEN '{k}' THEN patch_row + {a}" for k, (a, b) in FIRST.items())} END AS er, CASE pos {" ".join(f"WHEN '{k}' THEN patch_col + {b}" for k, (a, b) in FIRST.items())} END AS ec FROM r)
SELECT cell_id FROM e WHERE st = 0 OR NOT edge OR NOT EXISTS (SELECT 1 FROM r WHERE r.st <> 0 AND r.patch_row = e.er AND r.patch_col = e.ec)""")
def edge_filter(spark, d):
    return detect.edge_filter(detect.instance_records(boxes(spark, d))).select("cell_id")


GLOBAL = f"SELECT cell_id, rmin + (patch_row - 1) * 192 AS rmin, cmin + (patch_col - 1) * 192 AS cmin, rmin + (patch_row - 1) * 192 + 3 + cell_id % 4 AS rmax, cmin + (patch_col - 1) * 192 + 2 + cell_id % 3 AS cmax FROM ({BOXES})"


def small_boxes(spark, d):
    r = detect.instance_records(boxes(spark, d))
    return r.select("cell_id", "rmin", "cmin", (F.col("rmin") + 3 + F.col("cell_id") % 4).alias("rmax"), (F.col("cmin") + 2 + F.col("cell_id") % 3).alias("cmax"))


@query(f"""WITH g AS ({GLOBAL}), p AS (SELECT a.cell_id, b.cell_id AS b_cell_id, greatest(least(a.rmax, b.rmax) - greatest(a.rmin, b.rmin), 0) * greatest(least(a.cmax, b.cmax) - greatest(a.cmin, b.cmin), 0) AS common,
(a.rmax - a.rmin) * (a.cmax - a.cmin) AS area, (b.rmax - b.rmin) * (b.cmax - b.cmin) AS b_area FROM g a JOIN g b ON a.cell_id < b.cell_id AND a.rmin <= b.rmax AND b.rmin <= a.rmax AND a.cmin <= b.cmax AND b.cmin <= a.cmax)
SELECT cell_id, b_cell_id, area, b_area FROM p WHERE common > 0.01 * area OR common > 0.01 * b_area""")
def overlap_pairs(spark, d):
    return detect.overlap_pairs(small_boxes(spark, d), cell=16.0)


@query()
def overlap_dedup(spark, d):
    """Cells left when greater ones displace those they overlap; repeated rounds, so without SQL."""
    return detect.overlap_dedup(small_boxes(spark, d), cell=16.0).select("cell_id")


@query("""WITH c AS (SELECT user_id AS instance, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS type, count(*) AS k FROM events GROUP BY 1, 2),
p AS (SELECT *, sum(k) OVER w AS n, row_number() OVER (PARTITION BY instance ORDER BY k DESC, type) AS place, count(*) OVER w AS kinds FROM c WINDOW w AS (PARTITION BY instance)),
q AS (SELECT *, max(CAST(place = 1 AND type = 0 AND kinds > 1 AS INT)) OVER (PARTITION BY instance) AS b FROM p)
SELECT instance, type, round(k / (n + 1e-6), 6) AS share FROM q WHERE place = 1 + b""")
def majority_type(spark, d):
    kinds = F.create_map(*[x for i, t in enumerate(["view", "click", "error", "purchase", "signup"]) for x in (F.lit(t), F.lit(i))])
    pixels = R.table(spark, d, "events").select(F.col("user_id").alias("instance"), kinds[F.col("event_type")].alias("type"))
    return rounded(detect.majority_type(pixels), "share")


@query()
def polygon_overlap(spark, d):
    """Pairs of diamonds with a common area; an intersection of polygons, so without SQL."""
    b = small_boxes(spark, d)
    mid = lambda a, z: (F.col(a) + F.col(z)) / 2
    diamonds = b.select("cell_id", F.array(F.col("cmin"), mid("cmin", "cmax"), F.col("cmax"), mid("cmin", "cmax")).alias("xs"), F.array(mid("rmin", "rmax"), F.col("rmax"), mid("rmin", "rmax"), F.col("rmin")).alias("ys"))
    return rounded(detect.polygon_overlap_pairs(diamonds, cell=16.0), "area", "b_area", "common")


PIXELS = "SELECT user_id AS instance, CAST(floor(value) AS BIGINT) AS x, CAST(60 * hour(ts) + minute(ts) AS BIGINT) AS y FROM events"


@query(f"""WITH s AS (SELECT instance, count(*) AS n_pixels, min(y) AS rmin, min(x) AS cmin, max(y) + 1 AS rmax, max(x) + 1 AS cmax, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y FROM ({PIXELS}) WHERE instance <> 0 GROUP BY 1 HAVING count(*) >= 10)
SELECT *, row_number() OVER (ORDER BY instance) AS label FROM s""")
def instance_shapes(spark, d):
    pixels = R.table(spark, d, "events").select(F.col("user_id").alias("instance"), F.floor("value").alias("x"), (60 * F.hour("ts") + F.minute("ts")).cast("bigint").alias("y"))
    return rounded(detect.instance_shapes(pixels, 10), "centroid_x", "centroid_y")


# --- the entries -------------------------------------------------------------------


@query()
def annotator(spark, d):
    """The whole annotator: spot and global quotas, blended scores, greatest total score; an optimisation, so without SQL."""
    cells = R.cells(spark, d)
    at = cells.select(F.floor(F.col("x") / 8).alias("gx"), F.floor(F.col("y") / 8).alias("gy"), "cell_type")
    seen = at.groupBy("gx", "gy", "cell_type").agg(F.count("*").cast("double").alias("k"))
    point = (F.col("gx") * 10000 + F.col("gy")).alias("point_id")
    points = at.select("gx", "gy").distinct().select(point, (F.col("gx") * 8 + 4).cast("double").alias("x"), (F.col("gy") * 8 + 4).cast("double").alias("y"))
    ratios = seen.select(point, "cell_type", (F.col("k") / F.sum("k").over(Window.partitionBy("gx", "gy"))).alias("value"))
    spot_ratios = shares(spark, d).select("spot_id", "cell_type", "value")
    segments = cells.select("cell_id", "x", "y", (F.col("cell_id") % 6).alias("img_type"))
    return annotate.annotate_cells(segments, R.spots(spark, d), spot_ratios, points, ratios, R.SPOT_RADIUS, 8.0, R.TYPES, alpha=0.3)


NEAREST = f"SELECT c.cell_id, s.spot_id FROM ({C}) c JOIN ({S}) s ON sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= {R.SPOT_RADIUS} QUALIFY row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), s.spot_id) = 1"
SPOT_QUOTAS = _quota_sql(f"SELECT spot_id, cell_type, total, coalesce(value, 0) AS value FROM (SELECT spot_id, count(*) AS total FROM ({NEAREST}) GROUP BY 1) CROSS JOIN (SELECT DISTINCT cell_type FROM ({C})) LEFT JOIN (SELECT spot_id, cell_type, value FROM ({SHARES})) USING (spot_id, cell_type)", "spot_id")
TOTALS = _quota_sql(f"SELECT 1 AS g, cell_type, (SELECT count(*) FROM ({C})) AS total, CAST(sum(quota) AS DOUBLE) AS value FROM ({SPOT_QUOTAS}) GROUP BY 2", "g")


@query(f"SELECT cell_type, quota AS n FROM ({TOTALS}) WHERE quota > 0")
def annotator_totals(spark, d):
    """How many cells the annotator gives each type: the global quotas."""
    return annotator(spark, d).groupBy(F.col("pred_cell_type").alias("cell_type")).agg(F.count("*").alias("n"))


@query(f"SELECT spot_id, cell_type, quota AS n FROM ({SPOT_QUOTAS}) WHERE quota > 0")
def annotator_spots(spark, d):
    """How many cells of each type the annotator puts into each spot: the spots' quotas."""
    out = annotator(spark, d).where("spot_id is not null")
    return out.groupBy("spot_id", F.col("pred_cell_type").alias("cell_type")).agg(F.count("*").alias("n"))


@query()
def predictor(spark, d):
    """The whole predictor: split, labels, fallback radius, Delaunay graph, diffusion by type; iterative, so without SQL."""
    cells, inside = R.cells(spark, d), in_spot(spark, d)
    counts = inside.groupBy("spot_id", F.dayofweek(F.date_from_unix_date((F.col("cell_id") % 7).cast("int"))).alias("gene")).agg(F.sum("x").alias("value"))
    props = shares(spark, d).select("spot_id", "cell_type", (F.col("value") / F.sum("value").over(Window.partitionBy("spot_id"))).alias("value"))
    means = cells.groupBy("cell_type", F.dayofweek(F.date_from_unix_date((F.col("cell_id") % 7).cast("int"))).alias("gene")).agg(F.avg("x").alias("mean"))
    return rounded(predict.predict_expression(R.spots(spark, d), counts, props, means, cells, R.SPOT_RADIUS, tile=120.0, halo=60.0), "value")


def _clusters(spark, d):
    """Suppliers' nations as clusters, and their log-normalised counts with all zeros."""
    clusters = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs"), F.col("s_nationkey").alias("cluster"))
    counts = R.spot_counts(spark, d)
    grid = counts.select("obs").distinct().join(F.broadcast(counts.select("gene").distinct()), how="cross")
    return clusters, matrix.log_normalize(grid.join(counts, ["obs", "gene"], "left").fillna(0.0, ["value"]))


@query()
def dwls_clusters(spark, d):
    """Supplier proportions by dampened least squares per nation, with its candidate types and their markers; a solver, so without SQL."""
    clusters, log = _clusters(spark, d)
    return rounded(deconv.dwls_deconv(R.spot_counts(spark, d), _signature(spark, d), clusters, log, cutoff=1.0), "value")


@query()
def rctd_pipeline(spark, d):
    """Supplier proportions with the platform's effect and the deviation fitted; a solver, so without SQL."""
    means, genes = _signature(spark, d, True), R.spot_counts(spark, d).select("gene").distinct()
    return rounded(deconv.rctd(R.spot_counts(spark, d), means, genes, genes), "value")


@query()
def rctd_doublet(spark, d):
    """One type or two per supplier; a solver, so without SQL."""
    return rounded(deconv.rctd_doublet(R.spot_counts(spark, d), _signature(spark, d, True)), "first_weight", "min_score", "singlet_score")
