"""What awaits the owner's decision, and the pages of the graph. entities, aliases and edges as in decisions; notes: id,
path, title, deleted_at, current_revision_id. Pages take the last key of the page before."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.paging import contains_text, keyset, page

# Fixed sizes of pages and samples.
REVIEW_PAGE, LIST_PAGE, SAMPLES, MAX_NOTES = 20, 50, 3, 200


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1, name: str = "__n") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out.drop(name) if name == "__n" else out


def live_mentions(edges: DataFrame, notes: DataFrame, *columns: str) -> DataFrame:
    """A note's mention and about edges whose note isn't deleted."""
    alive = notes.where("deleted_at IS NULL").select(F.col("id").alias("src_id"), *columns)
    return edges.where("src_type = 'source' AND relation IN ('mentions', 'about')").join(alive, "src_id")


def status_matrix(entities: DataFrame, types: list[str], states: list[str]) -> DataFrame:
    """type, status and n for every type and state, also where there is none."""
    spark = entities.sparkSession
    every = spark.createDataFrame([(t, s) for t in types for s in states], "type string, status string")
    return F.broadcast(every).join(entities.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n")), ["type", "status"], "left").select("type", "status", F.coalesce("n", F.lit(0)).alias("n"))


def extraction_counts(notes: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row: total, ok, failed and pending of the current revisions of live notes, by their last attempt."""
    last = first_of(extractions, ["revision_id"], [F.desc("attempted_at"), F.desc("id")]).select(F.col("revision_id").alias("current_revision_id"), "status")
    rows = notes.where("deleted_at IS NULL AND current_revision_id IS NOT NULL").join(last, "current_revision_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("pending"))


def review_entities(entities: DataFrame, aliases: DataFrame, edges: DataFrame, notes: DataFrame, after: tuple | None = None, limit: int = REVIEW_PAGE) -> DataFrame:
    """Proposed entities, oldest first, with aliases, notes that mention them, and up to three of these, newest first."""
    proposed = page(entities.where("status = 'proposed'"), keyset(["created_at", "id"], after), [F.col("created_at"), F.col("id")], limit)
    seen = live_mentions(edges, notes, F.col("path").alias("path")).join(proposed.select(F.col("id").alias("dst_id")), "dst_id")
    counts = seen.groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("mentions"))
    samples = first_of(first_of(seen, ["dst_id", "src_id"], [F.desc("created_at"), F.col("id")]), ["dst_id"], [F.desc("created_at"), F.col("path")], SAMPLES, "n")
    samples = samples.groupBy(F.col("dst_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda s: s["path"]).alias("samples"))
    names = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    none = F.array().cast("array<string>")
    return proposed.join(names, "id", "left").join(counts, "id", "left").join(samples, "id", "left").select(
        "id", "type", "name", "created_at", F.coalesce("aliases", none).alias("aliases"), F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("samples", none).alias("samples")
    )


def visible_links(edges: DataFrame, entities: DataFrame, notes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Proposed links that can be judged, with subject and object.

    A relation counts while neither end is rejected and the note that gave it isn't deleted; a mention counts if its
    entity is accepted and its note alive. The type of the source decides which of two left joins finds the subject.
    """
    proposed = edges.where("status = 'proposed'")
    heads = entities.select(F.col("id").alias("src_id"), F.lit("entity").alias("src_type"), F.col("name").alias("head"), F.col("status").alias("head_status"))
    origins = notes.select(F.col("id").alias("src_id"), F.lit("source").alias("src_type"), F.coalesce("title", "path").alias("note"), F.col("deleted_at").isNull().alias("note_alive"))
    tails = entities.select(F.col("id").alias("dst_id"), F.col("name").alias("object"), F.col("status").alias("tail_status"))
    gone = revisions.join(notes.where("deleted_at IS NOT NULL").select(F.col("id").alias("source_id")), "source_id").select(F.col("id").alias("revision_id"), F.lit(True).alias("gone"))
    rows = proposed.join(heads, ["src_id", "src_type"], "left").join(origins, ["src_id", "src_type"], "left").join(tails, "dst_id").join(gone, "revision_id", "left")
    relation = (F.col("src_type") == "entity") & (F.col("head_status") != "rejected") & (F.col("tail_status") != "rejected") & F.col("gone").isNull()
    mention = (F.col("src_type") == "source") & (F.col("tail_status") == "accepted") & F.col("note_alive")
    return rows.where(F.coalesce(relation, F.lit(False)) | F.coalesce(mention, F.lit(False))).withColumn("subject", F.coalesce("head", "note")).select(
        "id", "src_type", "src_id", "subject", "relation", "dst_id", "object", "confidence", "created_at", "revision_id"
    )


def review_links(links: DataFrame, after: tuple | None = None, limit: int = REVIEW_PAGE) -> DataFrame:
    """A page of visible links, oldest first."""
    return page(links, keyset(["created_at", "id"], after), [F.col("created_at"), F.col("id")], limit)


def list_entities(entities: DataFrame, aliases: DataFrame, edges: DataFrame, notes: DataFrame, type_: str | None = None, q: str | None = None, after: tuple | None = None, limit: int = LIST_PAGE) -> DataFrame:
    """Accepted entities by the number of live notes that mention them, then by name; q looks in names and aliases."""
    rows = entities.where("status = 'accepted'")
    if type_:
        rows = rows.where(F.col("type") == type_)
    if q:
        by_alias = aliases.where(contains_text("alias", q)).select(F.col("entity_id").alias("id")).distinct().withColumn("__alias", F.lit(True))
        rows = rows.join(by_alias, "id", "left").where(contains_text("name", q) | F.col("__alias")).drop("__alias")
    counts = live_mentions(edges.where("status = 'accepted'"), notes).groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("notes"))
    counted = rows.join(counts, "id", "left").select("id", "type", "name", F.coalesce("notes", F.lit(0)).alias("notes"))
    return page(counted, keyset(["notes", "name", "id"], after, descending={"notes"}), [F.desc("notes"), F.col("name"), F.col("id")], limit)


def entity_notes(edges: DataFrame, notes: DataFrame, limit: int = MAX_NOTES) -> DataFrame:
    """For each entity its live notes with accepted edges, an about before a mention, the surest first, 200 at most."""
    rows = live_mentions(edges.where("status = 'accepted'"), notes, F.col("path").alias("path"), F.col("title").alias("title"))
    one = first_of(rows, ["dst_id", "src_id"], [(F.col("relation") != "about"), F.desc("confidence"), F.col("id")])
    return first_of(one, ["dst_id"], [(F.col("relation") != "about"), F.desc("confidence"), F.col("path")], limit).select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("note_id"), "path", "title", "relation", "confidence")


def entity_family(entities: DataFrame) -> DataFrame:
    """id, parent (name of the accepted one, where the link isn't rejected) and the number of accepted children."""
    shown = entities.where("status = 'accepted'")
    parents = shown.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    children = shown.where("parent_status <> 'rejected'").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    own = shown.withColumn("parent_id", F.when(F.col("parent_status") != "rejected", F.col("parent_id"))).select("id", "name", "parent_id")
    return own.join(parents, "parent_id", "left").join(children, "id", "left").select("id", "name", "parent", F.coalesce("children", F.lit(0)).alias("children"))


def related(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """For each entity its accepted relations to accepted entities, out and in."""
    shown = entities.where("status = 'accepted'").select(F.col("id").alias("other_id"), F.col("name").alias("other"))
    links = edges.where("src_type = 'entity' AND status = 'accepted'")
    out = links.select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("other_id"), "relation", F.lit("out").alias("direction"), "confidence")
    back = links.select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("other_id"), "relation", F.lit("in").alias("direction"), "confidence")
    return out.unionByName(back).join(shown, "other_id").join(shown.select(F.col("other_id").alias("entity_id")), "entity_id")


