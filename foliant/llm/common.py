"""What the operators share: the shared work folder, written intermediate tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, and of a batch of the Parquet reader, while a table is written: whole texts stand in them.
ROWS = 1000


def work_root(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named (tests, one machine), a folder of the warehouse, which executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/foliant-work"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders made in each open scratch().
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but those to keep: what is returned may read only these."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path under the shared folder, removed when the driver's JVM ends, or with the scratch() that it is made in;
    one to keep, with the scratch() around that."""
    folder = f"{work_root(spark)}/foliant-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(folder)
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(folder)
    return f"{folder}/{name}"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands rows on in batches of at most so many, so that a batch of whole texts stays small."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(rows))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, rows: int = ROWS, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = work_path(spark, name, keep)
    with batches_of(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: pairs of longs. Returns (node, comp): comp is the smallest node that
    node reaches; nodes without edges to others do not occur. Each step is a
    partial aggregation and an equi-join that AQE can split; the number of
    rounds grows with the logarithm of the longest path.
    """
    cur = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain shuffles, which AQE can split at a hot node
        low = written(both.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # u is the larger end here, so no node has more rows than it has smaller neighbours left
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        cur = written(small, "edges")
        mark = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == last:
            break
        last = mark
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
