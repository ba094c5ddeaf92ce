"""Tables in and intermediate tables out, through Spark's own readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a local master may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = getattr(spark, "_llm_folder", None)
    if held is None:
        held = spark._llm_folder = tempfile.mkdtemp(prefix="spark-llm-")
    return f"file://{held}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its plan ends there, and any executor can read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``mapInArrow`` with columns told by their places, so that any names will do."""
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, StructType(fields)).toDF(*schema.names)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
