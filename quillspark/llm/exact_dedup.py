"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest and written to the
shared folder (map-side first, so a group of copies of any size shuffles as a few rows; without that cut the optimiser
would push the join below the aggregate and shuffle every row). It loses what the index has by a sort-merge anti-join
that reads the index in its buckets without a shuffle, and the rest is appended as new groups. Copies of known digests
are appended as additions to their groups, so ids and sizes stay right over any number of batches; `groups` adds them up
bucket by bucket, and `compact` rewrites the table. DataFrame operations only.

Defined results: a null text counts as empty; empty texts are equal to each other; very long texts are hashed whole;
of equal texts the largest id stays; rows repeated with the same id count in the group's size; a null id is below every
other, so its row stays only in a group without ids (each such row is kept); an empty batch adds nothing; columns other
than id and text are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, ascii_lower, checkpointed, require, text_key

INDEX_SCHEMA = "text_sha256 STRING, keep_id BIGINT, group_size BIGINT, is_new BOOLEAN"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text_key and digest of each row: SHA-256 of the UTF-8 text after lower-casing A-Z."""
    return require(docs, [id_col, text_col]).select(
        F.col(id_col), text_key(text_col).alias("text_key"), F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256).alias("text_sha256")
    )


class DigestIndex:
    """name: a table name; location: where its files lie (default: the session's warehouse); buckets: fixed at creation.

    Buckets should make files of some 128 MB: about one for each million digests.
    """

    def __init__(self, spark: SparkSession, name: str, location: str | None = None, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        at = f" LOCATION '{location}'" if location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS{at}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """digest, keep_id and group_size of each group over all batches; bucketed, so nothing is shuffled."""
        return self.rows().groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def append(self, rows: DataFrame) -> None:
        """Written by bucket and sorted within it, one file a bucket and batch."""
        (
            rows.select("text_sha256", "keep_id", "group_size", "is_new").repartition(self.buckets, "text_sha256")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        )

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        keyed = digests(docs, id_col, text_col)
        with Scratch(self.spark) as scratch:
            batch = scratch.save(keyed.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
            known = self.rows().hint("merge")
            new = batch.hint("merge").join(known, "text_sha256", "left_anti").withColumn("is_new", F.lit(True))
            if not self.rows().isEmpty():
                again = batch.hint("merge").join(known, "text_sha256", "left_semi").withColumn("is_new", F.lit(False))
                new = scratch.save(new.unionByName(again))
            self.append(new)

    def compact(self) -> None:
        """One row per group again."""
        with Scratch(self.spark) as scratch:
            groups = scratch.save(self.groups().withColumn("is_new", F.lit(True)))
            self.spark.sql(f"TRUNCATE TABLE {self.name}")
            self.append(groups)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def mark_against(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, digest and text_key (xxhash64 of the text) of each row, from an index that holds all its digests.

    Groups that hold more than a thousandth of the rows each are a thousand at most and are broadcast; the rest meet in
    a sort-merge join.
    """
    keyed = digests(docs, id_col, text_col)
    total = index.rows().agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    large = F.col("group_size") > max(1, total // 1000)
    hot = index.groups().where(large).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})
    rest = index.groups().where(~large)
    spread = keyed.join(F.broadcast(hot), "text_sha256", "left")
    cold = spread.where("hot_size IS NULL").hint("merge").join(rest.hint("merge"), "text_sha256")
    columns = [F.col(id_col), F.col("keep_id"), F.col("group_size"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("text_sha256"), F.col("text_key")]
    warm = spread.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"})
    return cold.select(*columns).unionByName(warm.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 250_000) -> DataFrame:
    """Marks every row of one batch through an index of its own in the shared folder, which goes once the marks are checkpointed."""
    import uuid

    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_per_bucket)
    with Scratch(spark) as scratch:
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", location=f"{scratch.root}/index", buckets=buckets)
        try:
            index.add(docs, id_col, text_col)
            return checkpointed(mark_against(index, docs, id_col, text_col))
        finally:
            index.drop()
