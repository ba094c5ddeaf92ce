"""The engine's inputs read from retail, event and vector tables: fixed projections, documented here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TYPES = ["click", "error", "purchase", "signup", "view"]
#: Side of a spot's square and its radius, in the cells' units.
PITCH, SPOT_RADIUS = 20, 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, x, y, cell_type from the events: value, minute of the day, type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cell_id"), F.col("value").alias("x"), (60 * F.hour("ts") + F.minute("ts")).cast("double").alias("y"), F.col("event_type").alias("cell_type"))


CELLS_SQL = "SELECT event_id AS cell_id, value AS x, CAST(60 * hour(ts) + minute(ts) AS DOUBLE) AS y, event_type AS cell_type FROM events"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot_id, x, y: centres of the occupied squares of the cells' plane."""
    at = cells(spark, sf_dir).select(F.floor(F.col("x") / PITCH).alias("gx"), F.floor(F.col("y") / PITCH).alias("gy")).distinct()
    return at.select((F.col("gx") * 1000 + F.col("gy")).alias("spot_id"), (F.col("gx") * PITCH + PITCH / 2).cast("double").alias("x"), (F.col("gy") * PITCH + PITCH / 2).cast("double").alias("y"))


SPOTS_SQL = f"""SELECT DISTINCT CAST(floor(x / {PITCH}) AS BIGINT) * 1000 + CAST(floor(y / {PITCH}) AS BIGINT) AS spot_id,
  floor(x / {PITCH}) * {PITCH} + {PITCH / 2} AS x, floor(y / {PITCH}) * {PITCH} + {PITCH / 2} AS y FROM ({CELLS_SQL})"""


def spot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, gene, value: quantity per supplier and part class (part key modulo 50)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("obs"), (F.col("l_partkey") % 50).alias("gene")).agg(F.sum("l_quantity").alias("value"))


SPOT_COUNTS_SQL = "SELECT l_suppkey AS obs, l_partkey % 50 AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


def part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, gene, value: quantity per supplier and part, whose number grows with the input."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("obs"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


PART_COUNTS_SQL = "SELECT l_suppkey AS obs, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, gene, value: quantity per order and part class."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("obs"), (F.col("l_partkey") % 50).alias("gene")).agg(F.sum("l_quantity").alias("value"))


REF_COUNTS_SQL = "SELECT l_orderkey AS obs, l_partkey % 50 AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


def ref_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, cell_type: the orders and their priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderpriority").alias("cell_type"))


REF_LABELS_SQL = "SELECT o_orderkey AS obs, o_orderpriority AS cell_type FROM orders"


def method_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot_id, method, cell_type, value: each return flag's share of a supplier's lines by quantity, price and number."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("spot_id"), F.col("l_returnflag").alias("cell_type"))
    li = li.agg(F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"), F.count("*").cast("double").alias("c"))
    long = li.select("spot_id", "cell_type", F.expr("stack(3, 'quantity', a, 'price', b, 'lines', c) AS (method, value)"))
    from pyspark.sql import Window

    return long.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("spot_id", "method"))).select("spot_id", "method", "cell_type", "value")


METHODS_SQL = """SELECT spot_id, method, cell_type, value / sum(value) OVER (PARTITION BY spot_id, method) AS value FROM (
  SELECT l_suppkey AS spot_id, l_returnflag AS cell_type, unnest(['quantity', 'price', 'lines']) AS method,
         unnest([sum(l_quantity), sum(l_extendedprice), CAST(count(*) AS DOUBLE)]) AS value FROM lineitem GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, gene, value, label: the embeddings' components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("obs"), F.posexplode("embedding").alias("gene", "v"), "label").select("obs", "gene", F.col("v").cast("double").alias("value"), "label")


VECTORS_SQL = "SELECT vec_id AS obs, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS gene, CAST(unnest(embedding) AS DOUBLE) AS value, label FROM embeddings"
