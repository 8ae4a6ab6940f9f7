"""The model's frames, made from the driver's tables, and the same as DuckDB text of its own.

notes stand for documents, revisions for their saved states, entities for parts, edges for order lines, extractions for
events, runs for the days of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.corpus import table

TYPES = ["project", "person", "organization", "tool", "device", "topic"]
STATES = ["proposed", "accepted", "rejected"]
START = "2024-01-01 00:00:00"


def pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def hours(number: Column) -> Column:
    return F.to_timestamp(F.lit(START)) + F.make_interval(hours=number.cast("int"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """id, path, title, created_at, deleted_at, current_revision_id, text, quality."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    last = F.col("doc_id") % 3
    current = F.when(F.col("quality") == 1, last).otherwise(last - 1)
    created = hours(F.col("doc_id") % 720)
    return docs.select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md"))).alias("path"), F.concat(F.lit("Note "), "doc_id").alias("title"), created.alias("created_at"),
        F.when(F.col("toxic") == 1, created + F.make_interval(hours=F.lit(30))).alias("deleted_at"), F.when(current >= 0, F.col("doc_id") * 10 + current).alias("current_revision_id"), "text", "quality",
    )


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """id, source_id, state, error, observed_at: one to three for each note, the last by its quality."""
    own = notes(spark, sf).select("id", "created_at", "quality", F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("k"))
    last = F.col("k") == F.col("id") % 3
    state = F.when(~last, "superseded").when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed").otherwise("pending")
    error = F.when(last & (F.col("quality") == 0), F.when(F.col("id") % 2 == 0, "index_error").otherwise("too_large"))
    return own.select((F.col("id") * 10 + F.col("k")).alias("id"), F.col("id").alias("source_id"), state.alias("state"), error.alias("error"), (F.col("created_at") + F.make_interval(hours=F.col("k") * 50)).alias("observed_at"))


def note_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """id, revision_id, ordinal, embedded: the first lines of current revisions; chunk 0 has a vector where its note's id is one's."""
    own = notes(spark, sf).where("current_revision_id IS NOT NULL").select("id", "current_revision_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 4)).alias("ordinal", "content"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("ordinal"), F.lit(True).alias("embedded"))
    return own.join(vectors, ["id", "ordinal"], "left").select(
        (F.col("current_revision_id") * 100 + F.col("ordinal")).alias("id"), F.col("current_revision_id").alias("revision_id"), "ordinal", F.coalesce("embedded", F.lit(False)).alias("embedded")
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """id, type, name, norm_name, status, parent_id, parent_status, created_at, suggested."""
    key = F.col("p_partkey")
    parent = F.when(key >= 10, F.expr("p_partkey div 10"))
    return table(spark, sf, "part").select(
        key.alias("id"), pick(TYPES, F.col("p_size") % 6).alias("type"), F.col("p_name").alias("name"), F.lower("p_name").alias("norm_name"), pick(STATES, F.col("p_size") % 3).alias("status"),
        parent.alias("parent_id"), F.when(parent.isNotNull(), pick(STATES, key % 2)).alias("parent_status"), hours(key % 720).alias("created_at"), F.array().cast("array<string>").alias("suggested"),
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """entity_id, type, alias, norm_alias: every entity's brand and key."""
    return entities(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id").select(
        F.col("id").alias("entity_id"), "type", F.concat_ws(" ", "p_brand", "id").alias("alias"), F.lower(F.concat_ws(" ", "p_brand", "id")).alias("norm_alias")
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """id, src_type, src_id, relation, dst_id, confidence, status, decided_by, origin, created_at, revision_id.

    Lines 1 to 5 are a note's, the others an entity's; the first of equal keys and of equal ids stays.
    """
    line, own = F.col("l_linenumber"), F.col("l_linenumber") <= 5
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("id"), F.when(own, "source").otherwise("entity").alias("src_type"), F.when(own, F.col("l_orderkey") % 1000).otherwise(F.col("l_suppkey")).alias("src_id"),
        F.when(line == 1, "about").when(own, "mentions").when(line == 6, "uses").otherwise("part_of").alias("relation"), F.col("l_partkey").alias("dst_id"), F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"),
        F.when(F.col("l_returnflag") == "N", "proposed").when(F.col("l_returnflag") == "A", "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("l_linestatus") == "F", "user").otherwise("auto").alias("decided_by"), F.when(line % 2 == 0, "llm:m").otherwise("owner").alias("origin"),
        hours((F.col("l_orderkey") * 7 + line) % 720).alias("created_at"), F.when(own, F.col("l_orderkey") % 1000 * 10 + F.col("l_orderkey") % 1000 % 3).alias("revision_id"),
    )
    first = F.row_number().over(Window.partitionBy("src_type", "src_id", "relation", "dst_id").orderBy("id", "confidence", "status", "decided_by"))
    rows = rows.withColumn("n", first).where("n = 1")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("dst_id", "src_id"))).where("n = 1").drop("n")


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    """revision_id, status, error, attempted_at, summary."""
    failed = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        (F.col("user_id") * 10 + F.col("user_id") % 3).alias("revision_id"), F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, F.concat(F.lit("e"), F.col("event_id") % 7)).alias("error"),
        F.col("ts").alias("attempted_at"), F.when(~failed, F.col("event_type")).alias("summary"), F.col("event_id").alias("id"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """id, run_date, trigger, status, window_start, started_at, finished_at, queued_new, queued_failed.

    One a day at two o'clock, for twenty hours; every seventh failed, the last is open.
    """
    days = table(spark, sf, "events").select(F.to_date("ts").alias("run_date")).distinct()
    day = F.day("run_date")
    rows = days.select(
        day.alias("id"), "run_date", F.when(day % 5 == 0, "manual").otherwise("schedule").alias("trigger"), F.when(day % 7 == 0, "failed").when(day == 30, "running").otherwise("complete").alias("status"),
        (F.col("run_date").cast("timestamp") + F.make_interval(hours=F.lit(2))).alias("started_at"), F.when(day < 30, F.col("run_date").cast("timestamp") + F.make_interval(hours=F.lit(22))).alias("finished_at"),
        day.alias("queued_new"), (day % 3).alias("queued_failed"),
    )
    from quillspark.operators.nightly import window_starts

    return window_starts(rows)


H = "TIMESTAMP '2024-01-01' + to_hours(CAST({} AS BIGINT))"
STATE3 = "['proposed','accepted','rejected']"
#: CTEs of DuckDB for the same frames, by name.
MODEL_SQL = {
    "notes": "notes AS (SELECT d.doc_id AS id, source || '/' || lang || '/' || d.doc_id || '.md' AS path, 'Note ' || d.doc_id AS title, " + H.format("d.doc_id % 720") + " AS created_at, CASE WHEN toxic = 1 THEN " + H.format("d.doc_id % 720 + 30") + " END AS deleted_at, CASE WHEN quality = 1 THEN d.doc_id * 10 + d.doc_id % 3 WHEN d.doc_id % 3 > 0 THEN d.doc_id * 10 + d.doc_id % 3 - 1 END AS current_revision_id, text, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)",
    "revisions": "revisions AS (SELECT id * 10 + k AS id, id AS source_id, CASE WHEN k < id % 3 THEN 'superseded' WHEN quality = 1 THEN 'indexed' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN k = id % 3 AND quality = 0 THEN CASE WHEN id % 2 = 0 THEN 'index_error' ELSE 'too_large' END END AS error, created_at + to_hours(k * 50) AS observed_at FROM (SELECT *, unnest(range(0, id % 3 + 1)) AS k FROM notes))",
    "chunks": "chunks AS (SELECT current_revision_id * 100 + k AS id, current_revision_id AS revision_id, k AS ordinal, k = 0 AND e.vec_id IS NOT NULL AS embedded FROM (SELECT id AS note, current_revision_id, unnest(range(0, least(4, len(string_split(text, chr(10)))))) AS k FROM notes WHERE current_revision_id IS NOT NULL) x LEFT JOIN embeddings e ON e.vec_id = x.note)",
    "entities": "entities AS (SELECT p_partkey AS id, ['project','person','organization','tool','device','topic'][p_size % 6 + 1] AS type, p_name AS name, lower(p_name) AS norm_name, " + STATE3 + "[p_size % 3 + 1] AS status, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id, CASE WHEN p_partkey >= 10 THEN " + STATE3 + "[p_partkey % 2 + 1] END AS parent_status, " + H.format("p_partkey % 720") + " AS created_at, p_brand FROM part)",
    "aliases": "aliases AS (SELECT id AS entity_id, type, p_brand || ' ' || id AS alias, lower(p_brand || ' ' || id) AS norm_alias FROM entities)",
    "edges": "edges AS (SELECT * FROM (SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <= 5 THEN 'source' ELSE 'entity' END AS src_type, CASE WHEN l_linenumber <= 5 THEN l_orderkey % 1000 ELSE l_suppkey END AS src_id, CASE l_linenumber WHEN 1 THEN 'about' WHEN 6 THEN 'uses' WHEN 7 THEN 'part_of' ELSE 'mentions' END AS relation, l_partkey AS dst_id, round(1 - 5 * l_discount, 4) AS confidence, CASE l_returnflag WHEN 'N' THEN 'proposed' WHEN 'A' THEN 'accepted' ELSE 'rejected' END AS status, CASE l_linestatus WHEN 'F' THEN 'user' ELSE 'auto' END AS decided_by, CASE WHEN l_linenumber % 2 = 0 THEN 'llm:m' ELSE 'owner' END AS origin, " + H.format("(l_orderkey * 7 + l_linenumber) % 720") + " AS created_at, CASE WHEN l_linenumber <= 5 THEN l_orderkey % 1000 * 10 + l_orderkey % 1000 % 3 END AS revision_id FROM lineitem) QUALIFY row_number() OVER (PARTITION BY src_type, src_id, relation, dst_id ORDER BY id, confidence, status, decided_by) = 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dst_id, src_id) = 1)",
    "extractions": "extractions AS (SELECT user_id * 10 + user_id % 3 AS revision_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS status, CASE event_type WHEN 'error' THEN 'e' || event_id % 7 END AS error, ts AS attempted_at, CASE WHEN event_type <> 'error' THEN event_type END AS summary, event_id AS id FROM events)",
    "runs": "runs AS (SELECT id, run_date, CASE WHEN id % 5 = 0 THEN 'manual' ELSE 'schedule' END AS trigger, CASE WHEN id % 7 = 0 THEN 'failed' WHEN id = 30 THEN 'running' ELSE 'complete' END AS status, run_date + INTERVAL 2 HOUR AS started_at, CASE WHEN id < 30 THEN run_date + INTERVAL 22 HOUR END AS finished_at, id AS queued_new, id % 3 AS queued_failed, (SELECT max(d2) + INTERVAL 2 HOUR FROM (SELECT DISTINCT CAST(ts AS DATE) AS d2 FROM events) y WHERE d2 < run_date AND day(d2) % 7 <> 0) AS window_start FROM (SELECT DISTINCT CAST(ts AS DATE) AS run_date, day(ts) AS id FROM events))",
}
NEEDS = {"revisions": ["notes"], "chunks": ["notes"], "aliases": ["entities"]}


def with_model(*names: str) -> str:
    """WITH and the CTEs of these frames and of what they need."""
    found: list[str] = []
    for name in names:
        found += [n for n in [*NEEDS.get(name, []), name] if n not in found]
    return "WITH " + ", ".join(MODEL_SQL[n] for n in found)
