"""Tables in and out: inputs, cached results with content fingerprints, and lineage cuts in the shared folder."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A two-column list with a header, such as ligands and receptors."""
    return spark.read.csv(path, sep=sep, header=True)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """obs, gene, value from parquet; explicit zeros are dropped."""
    return spark.read.parquet(path).select("obs", "gene", F.col("value").cast("double").alias("value")).where("value <> 0")


def read_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, length and content of image or map files; decoding is the caller's, as no imaging library is part of this package."""
    return spark.read.format("binaryFile").load(path).where(F.col("path").endswith(suffix)).select("path", "length", "content")


def slide_list(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """The rows of a CSV whose Filename ends in the suffix."""
    return spark.read.csv(path, header=True).where(F.col("Filename").endswith(suffix))


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's schema and content, whatever the order of its rows; nulls and empty strings differ."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns]).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([df.schema.json(), row[0], str(row[1])]).encode()).hexdigest()


def cache_id(**params) -> str:
    """A short name for a set of parameters."""
    return hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


#: The file that makes a folder an entry; it is written aside with the rows, so an entry has it or doesn't exist.
META = "_entry.json"


class _Files:
    """The file system that holds a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway, conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.conf, self.fs = conf, self.path(folder).getFileSystem(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def publish(self, aside: str, name: str) -> bool:
        """Rename a folder in one step; False, and nothing done, if the name is taken."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(aside)), self.fs.makeQualified(self.path(name)), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if self.exists(f"{name}/{META}"):
                return False
            raise
        return True


def cached(folder: str, inputs: list[DataFrame], params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, kept under the content of its inputs and its parameters; a stale entry can't be hit.

    Rows and then a description (parameters, inputs' fingerprints, schema, count) are
    written aside; one rename makes them the entry.  A writer that dies leaves a
    folder that no reader looks at (``sweep_cache`` removes it); of several writers
    at once the first one's entry stays, and the others read it.  The folder's file
    system must rename folders in one step, as HDFS and local ones do.
    """
    spark, prints = inputs[0].sparkSession, [fingerprint(d) for d in inputs]
    path, files = f"{folder}/{cache_id(inputs=prints, **params)}", _Files(spark, folder)
    if not files.exists(f"{path}/{META}"):
        aside = f"{folder}/_aside-{uuid.uuid4().hex}"
        made = build()
        made.write.parquet(aside)
        rows = spark.read.schema(made.schema).parquet(aside).count()
        about = {"params": params, "inputs": prints, "schema": json.loads(made.schema.json()), "rows": rows}
        files.write(f"{aside}/{META}", json.dumps(about, sort_keys=True, default=str))
        if not files.publish(aside, path):
            files.fs.delete(files.path(aside), True)
    return spark.read.parquet(path)


def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    """path and about (JSON) of a cache's whole entries; those being written aren't among them."""
    files = _Files(spark, folder)
    held = []
    for status in files.fs.globStatus(files.path(f"{folder}/[!_]*/{META}")) or []:
        stream = files.fs.open(status.getPath())
        try:
            about = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        held.append((status.getPath().getParent().toString(), about))
    return spark.createDataFrame(held, "path string, about string")


def sweep_cache(spark: SparkSession, folder: str, older_seconds: float = 86_400) -> int:
    """Remove what writers that died left more than ``older_seconds`` ago; the number of folders removed."""
    files, gone = _Files(spark, folder), 0
    for status in files.fs.globStatus(files.path(f"{folder}/_aside-*")) or []:
        if status.getModificationTime() / 1000 < time.time() - older_seconds:
            gone += files.fs.delete(status.getPath(), True)
    return gone


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder (in folders of equal ``by``) and read back: loops stay short plans, and a lost executor costs nothing."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all of the session's shuffle partitions, for work that is heavy though its rows are few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def small_pandas(df: DataFrame, most: int, what: str):
    """``df`` on the driver, if it has no more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"the {what} has more than {most} rows")
    return df.toPandas()
