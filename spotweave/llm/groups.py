"""Groups of sorted partitions as numpy columns, and large groups dealt out in block pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import parallelism


def sorted_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The runs of equal values in column ``key`` of a partition sorted by it, across batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            part = batch.slice(a, z - a)
            if held and held_key != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held_key = k[a]
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def binaries(column: pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()


def by_group(df: DataFrame, run, schema: str, parts: int = 0) -> DataFrame:
    """``run`` over partitions (``parts`` of them, or more) in which the rows of a group (first column) are neighbours."""
    key = df.columns[0]
    return df.repartition(max(parts, parallelism(df.sparkSession)), key).sortWithinPartitions(*df.columns[:2]).mapInArrow(run, schema)


def in_order(df: DataFrame, run, schema: str, count: int, rows: int = 2_000_000) -> DataFrame:
    """``run`` over range partitions of about ``rows`` of ``count`` rows, ordered by all columns: even equal keys spread, by the columns after them."""
    parts = max(parallelism(df.sparkSession), -(-count // rows))
    return df.repartitionByRange(parts, *df.columns).sortWithinPartitions(*df.columns).mapInArrow(run, schema)


#: A class of more than one in so many rows is joined by broadcast; there are fewer such classes than this.
HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``classes``, a written table of one row per key; ``size`` is its number of ``rows``, ``total`` that of all.

    The few hot classes are broadcast, so their rows stay where they are, as
    do those with a null key; the others meet by shuffle.
    """
    hot = F.broadcast(classes.where(F.col(size) * HOT_SHARE > total).drop(size))
    cold = classes.where(F.col(size) * HOT_SHARE <= total).drop(size)
    out = rows.join(hot, key).unionByName(rows.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(cold, key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def block_pairs(df: DataFrame, group: str, member: str, limit: int) -> DataFrame:
    """Prepend ``part``, the key to group by: groups of up to ``limit`` members as they are.

    Larger ones are dealt into blocks of about that many by a hash of the
    member, and each pair of blocks becomes a part, so every two members of a
    group meet in a part and no part grows with its group.
    """
    blocks = df.groupBy(group).count().where(F.col("count") > limit).select(group, F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    dealt = df.join(blocks, group, "left").withColumn("own", F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("*", other.alias("other"))
    part = F.when(F.col("blocks").isNull(), F.col(group)).otherwise(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select(part.alias("part"), *df.columns)
