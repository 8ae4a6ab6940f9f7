"""Adapters from the driver's tables to the model: sources, chunks, queries, entities, edges, attempts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, folder, tags, deleted, text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tags = F.array_compact(F.array("lang", F.concat(F.lit("quality:"), "quality"), F.concat(F.lit("toxic:"), "toxic")))
    return docs.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("source").alias("folder"), tags.alias("tags"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"), "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the live documents: doc_id, chunk_id, content.

    Documents are dealt by their ids in pieces of some 1000, so what is counted per document or chunk later needs no
    shuffle of words, and no task's counts grow with the table. They are dealt before they meet their labels, which then
    come to them, so text is shuffled once; a multiple of 16 pieces makes each piece lie in one part of a text index.
    """
    docs = table(spark, sf_dir, "documents")
    pieces = -(-max(spark.sparkContext.defaultParallelism, docs.count() // 1000) // 16) * 16
    dealt = docs.select("doc_id", "text").repartition(pieces, "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    live = dealt.where(~F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return live.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).select("doc_id", (F.col("doc_id") * 1000000 + F.col("line")).alias("chunk_id"), "content")


#: The same adapters as SQL that both Spark and DuckDB run.
SOURCES_SQL = """s AS (
  SELECT d.doc_id, d.source || '/' || d.lang || '/' || CAST(d.doc_id AS STRING) || '.md' AS path, d.source AS folder, d.lang, d.text, d.n_chars, l.quality, l.toxic,
         coalesce(l.toxic = 1, false) AS deleted
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id)"""
ENTITIES_SQL = """entities AS (
  SELECT p_partkey AS id, p_name AS name, CASE p_size % 6 WHEN 0 THEN 'project' WHEN 1 THEN 'person' WHEN 2 THEN 'organization' WHEN 3 THEN 'tool' WHEN 4 THEN 'device' ELSE 'topic' END AS type,
         CASE p_size % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status
  FROM {part})"""
EDGES_SQL = """edges AS (
  SELECT l_orderkey AS src_id, l_partkey AS dst_id, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'about' ELSE 'mentions' END AS relation,
         round(1 - 5 * l_discount, 4) AS confidence, CASE l_returnflag WHEN 'N' THEN 'proposed' WHEN 'A' THEN 'accepted' ELSE 'rejected' END AS status,
         CASE l_linestatus WHEN 'F' THEN 'user' ELSE 'auto' END AS decided_by, l_shipdate AS created_at
  FROM {lineitem})"""
ATTEMPTS_SQL = """attempts AS (
  SELECT event_id, user_id AS revision_id, ts AS attempted_at, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS status, event_type FROM {events})"""
RUNS_SQL = """runs AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS started_at, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL '1' DAY AS finished_at FROM {events})"""
