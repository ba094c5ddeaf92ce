"""Detected instances of tiles that arrive as files, as a stream of global records.

The batch operator is row-wise, so the stream needs no state and no watermark;
removal of duplicates across tiles stays a batch step over what has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import instance_records

SCHEMA = "cell_id long, patch_row long, patch_col long, rmin long, cmin long, rmax long, cmax long, centroid_x double, centroid_y double"


def stream_records(spark: SparkSession, folder: str, tile: int = 256, overlap: int = 64) -> DataFrame:
    """A streaming DataFrame of ``instance_records`` over the parquet files that appear in ``folder``."""
    return instance_records(spark.readStream.schema(SCHEMA).parquet(folder), tile, overlap)
