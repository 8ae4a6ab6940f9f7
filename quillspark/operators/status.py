"""The state of the sources: totals, a filtered list in pages, and what a retry should do.

notes and revisions as in plans.model; chunks: id, revision_id, embedded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.paging import contains_text, keyset, page, where_given
from quillspark.operators.review import first_of

PAGE = 50


def last_states(revisions: DataFrame) -> DataFrame:
    """source_id, last_id, state and error of each source's newest revision."""
    return first_of(revisions, ["source_id"], [F.desc("observed_at"), F.desc("id")]).select("source_id", F.col("id").alias("last_id"), "state", "error")


def embedded(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("revision_id").alias("current_revision_id")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("embedded").alias("embedded"))


def summary(notes: DataFrame, revisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: active and deleted sources; pending, indexed and failed newest states; chunks and vectors; the commonest error."""
    rows = notes.join(last_states(revisions).withColumnRenamed("source_id", "id"), "id", "left").join(embedded(chunks), "current_revision_id", "left")
    live = F.col("deleted_at").isNull()
    n = lambda c: F.count_if(live & c)
    totals = rows.agg(
        F.count_if(live).alias("active"), F.count_if(~live).alias("deleted"), n(F.col("state") == "pending").alias("pending"), n(F.col("state") == "indexed").alias("indexed"), n(F.col("state") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(live, F.col("chunks"))), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.when(live, F.col("embedded"))), F.lit(0)).alias("embedded"),
    )
    errors = rows.where(live & F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(1).select(F.col("error").alias("common_error"))
    return totals.join(F.broadcast(errors), how="left")


def sources_page(notes: DataFrame, revisions: DataFrame, chunks: DataFrame, state: str | None = None, q: str | None = None, after: tuple | None = None, limit: int = PAGE) -> DataFrame:
    """Sources by path, with their state, error and chunks; state and q (in path or title) may be missing."""
    live = F.col("deleted_at").isNull()
    rows = notes.join(last_states(revisions).withColumnRenamed("source_id", "id"), "id", "left").join(embedded(chunks), "current_revision_id", "left")
    count = lambda c: F.when(live, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    rows = rows.select("id", "title", "path", F.when(~live, "deleted").otherwise(F.col("state")).alias("state"), "error", count("chunks"), count("embedded"))
    rows = where_given(rows, state=state)
    if q:
        rows = rows.where(contains_text("path", q) | contains_text("title", q))
    return page(rows, keyset(["path"], after), [F.col("path")], limit)


def retry_routes(wanted: DataFrame, notes: DataFrame, revisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """id and route of each wanted source: missing, none, index (its last indexing failed for no fault of the file's), embed."""
    rows = wanted.select("id").distinct().join(notes.withColumn("known", F.lit(True)), "id", "left").join(last_states(revisions).withColumnRenamed("source_id", "id"), "id", "left")
    rows = rows.join(embedded(chunks), "current_revision_id", "left")
    route = (
        F.when(F.col("known").isNull(), "missing").when(F.col("deleted_at").isNotNull(), "none").when(F.col("state") == "failed", F.when(F.col("error") == "index_error", "index").otherwise("none"))
        .when(F.col("chunks") > F.col("embedded"), "embed").otherwise("none")
    )
    return rows.select("id", route.alias("route"))
