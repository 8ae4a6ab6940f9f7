"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: str) -> Column:
    """With the id, what tells rows apart whose ids repeat; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One machine may go without and gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/quillspark"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Intermediate tables in the shared folder; a lost executor rereads them and does not recompute their lineage.

    Use as a context manager: on exit all its tables are deleted, so what leaves the block must be checkpointed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> "Scratch":
        return self

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        """Deletes the table that the number-th save() wrote."""
        self._delete(f"{self.root}/{number}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_exc: object) -> None:
        self._delete(self.root)


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager checkpoint() in the shared folder: cuts the lineage, so that what it was made from may go."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps (Kiveris et al., 2014).

    links: columns a, b (long). Returns one row (node, component) per node that has a link; component is the
    smallest node it reaches. Each round is written to the shared folder; only counts reach the driver. A hub's
    neighbours are folded by a map-side minimum, and its join is one that adaptive execution can split.
    """
    edges = scratch.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    at, before = scratch.n, None
    while True:
        # large star: every larger neighbour of a node hangs on the smallest node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours and itself hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        edges = scratch.save(small)
        scratch.drop(at)
        at = scratch.n
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Just the named columns: extra ones, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
