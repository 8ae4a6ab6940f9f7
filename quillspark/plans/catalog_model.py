"""Queries over the model's frames (see model), with DuckDB text that is written for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import chat, decisions, graph, ingest, nightly, paging, resolution, review, status
from quillspark.plans import model
from quillspark.plans.corpus import table
from quillspark.plans.model import with_model

Query = Callable[[SparkSession, str], DataFrame]


def now() -> F.Column:
    """The time at which an open run is looked at."""
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


def graph_of(spark: SparkSession, sf: str) -> decisions.Graph:
    return decisions.Graph(model.entities(spark, sf), model.aliases(spark, sf), model.edges(spark, sf))


def joined(column: str) -> F.Column:
    return F.array_join(column, "|").alias(column)


# the owner's decisions


def graph_accept_reject(spark: SparkSession, sf: str) -> DataFrame:
    """A sign-up accepts its user's entity, an error rejects it; the last one counts."""
    asked = table(spark, sf, "events").where("event_type IN ('signup', 'error')").select(F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "error", "reject").otherwise("accept").alias("action"), F.col("event_id").alias("seq"))
    _, edges = decisions.decide_entities(model.entities(spark, sf), model.edges(spark, sf), asked)
    return edges.select("id", "status")


def graph_decide_links(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "error", "reject").otherwise("maybe")
    asked = table(spark, sf, "events").select((F.col("user_id") * 10 + 1 + F.col("event_id") % 3).alias("edge_id"), action.alias("action"), F.col("event_id").alias("seq"))
    return decisions.decide_links(model.edges(spark, sf), asked).select("id", "status", "decided_by")


def renames(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's entity takes the name of one seven further, a name that others want too, or no name."""
    names = model.entities(spark, sf).select((F.col("id") - 7).alias("entity_id"), F.col("name").alias("other"))
    users = table(spark, sf, "events").select(F.col("user_id").alias("entity_id")).distinct().join(names, "entity_id", "left")
    name = F.when(F.col("entity_id") % 25 == 4, " ").when(F.col("entity_id") % 3 == 0, F.col("other")).otherwise(F.concat(F.lit(" Renamed "), F.col("entity_id") % 40))
    return users.select("entity_id", name.alias("name"), F.lit(1).alias("seq"))


def graph_rename(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.rename(graph_of(spark, sf), renames(spark, sf))[1]


def graph_rename_names(spark: SparkSession, sf: str) -> DataFrame:
    after, _ = decisions.rename(graph_of(spark, sf), renames(spark, sf))
    return after.entities.select("id", "name", "norm_name")


def graph_retype(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").select(F.col("user_id").alias("entity_id")).distinct()
    asked = asked.select("entity_id", F.when(F.col("entity_id") % 20 == 3, "planet").otherwise(model.pick(model.TYPES, F.col("entity_id") * 5 % 6)).alias("type"), F.lit(1).alias("seq"))
    return decisions.retype(graph_of(spark, sf), asked)[1]


def graph_set_parent(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    wish = F.when(key % 4 == 1, key * 10 + 3).when(key % 4 != 0, key % 7)
    asked = table(spark, sf, "part").where("p_partkey % 3 = 0").select(key.alias("entity_id"), wish.alias("parent_id"), F.lit(1).alias("seq"))
    return decisions.set_parents(model.entities(spark, sf), asked)[1]


def merges(spark: SparkSession, sf: str) -> DataFrame:
    """Of every two entities of a type, in order, the second goes into the first."""
    place = F.row_number().over(Window.partitionBy("type").orderBy("id"))
    numbered = model.entities(spark, sf).select("id", "type", place.alias("n"))
    return numbered.where("n % 2 = 0").select(F.col("id").alias("loser_id"), "type", (F.col("n") - 1).alias("n")).join(numbered.select(F.col("id").alias("into_id"), "type", "n"), ["type", "n"]).select("loser_id", "into_id")


def graph_merge_edges(spark: SparkSession, sf: str) -> DataFrame:
    after, _ = decisions.merge(graph_of(spark, sf), merges(spark, sf))
    return after.edges.select("id", "src_type", "src_id", "relation", "dst_id")


def graph_merge_aliases(spark: SparkSession, sf: str) -> DataFrame:
    after, _ = decisions.merge(graph_of(spark, sf), merges(spark, sf))
    return after.aliases.select("entity_id", "type", "norm_alias")


# from extraction to the graph


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """What a model might say of each order: its parts by name, by alias, or by a new name."""
    part = model.entities(spark, sf).join(model.aliases(spark, sf).select(F.col("entity_id").alias("id"), "alias"), "id").select(F.col("id").alias("l_partkey"), "type", "name", "alias")
    n = F.col("l_linenumber") % 3
    name = F.when(n == 0, F.upper("name")).when(n == 1, F.col("alias")).otherwise(F.concat(F.lit("New "), "name"))
    rows = table(spark, sf, "lineitem").join(part, "l_partkey").select((F.col("l_orderkey") % 1000).alias("source_id"), "type", name.alias("name"), F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"))
    return rows.groupBy("source_id", "type", "name").agg(F.max("confidence").alias("confidence")).withColumns({"aliases": F.array().cast("array<string>"), "evidence": F.lit(None).cast("string")})


NO_RELATIONS = "source_id long, subject string, relation string, object string, confidence double, evidence string"


def resolve_mentions(spark: SparkSession, sf: str) -> DataFrame:
    found = resolution.resolve(extracted(spark, sf), spark.createDataFrame([], NO_RELATIONS), model.entities(spark, sf), model.aliases(spark, sf))
    new = found.created.select(F.col("id").alias("dst_id"), F.concat_ws(":", "type", "norm_name").alias("new"))
    return found.edges.join(new, "dst_id", "left").select("src_id", F.when(F.col("new").isNull(), F.col("dst_id")).alias("known"), "new", "confidence", "status")


def resolve_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring names of a note are related, in turn by each kind of relation."""
    said = graph.written(extracted(spark, sf))
    after = F.lead("name").over(Window.partitionBy("source_id").orderBy("name", "type"))
    kind = model.pick(["uses", "runs_on", "works_with", "part_of"], F.char_length("name") % 4)
    pairs = said.withColumn("object", after).where("object IS NOT NULL").select("source_id", F.col("name").alias("subject"), kind.alias("relation"), "object", "confidence", "evidence")
    found = resolution.resolve(said, pairs, model.entities(spark, sf), model.aliases(spark, sf))
    return found.edges.where("src_type = 'entity'").groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))


def merge_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of an order is a window that names its part, in changing case."""
    part = model.entities(spark, sf).select(F.col("id").alias("l_partkey"), "type", "name")
    one = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), "type", F.array("name").alias("aliases"), F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"))
    none = F.array().cast("array<struct<subject:string,relation:string,object:string,chunk:string,confidence:double>>")
    outputs = table(spark, sf, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("window"), F.array(one).alias("entities"), none.alias("relations"))
    names, _ = resolution.merge_outputs(outputs)
    return names.select("revision_id", "type", "norm", "confidence", "ordinal")


def edges_replace_machine(spark: SparkSession, sf: str) -> DataFrame:
    states = model.revisions(spark, sf).where("source_id % 2 = 0").select("source_id", F.col("id").alias("revision_id"))
    stay, go = resolution.replace_machine_edges(model.edges(spark, sf), states)
    n = lambda df, name: df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return n(stay, "stay").unionByName(n(go, "go"))


def edges_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every third edge comes anew, accepted and surer; and some that nobody had."""
    old = model.edges(spark, sf)
    key = ["src_type", "src_id", "relation", "dst_id"]
    new = old.where("id % 3 = 0").select(*key, F.lit(0.75).alias("confidence"), F.lit("accepted").alias("status"))
    fresh = old.where("id % 3 = 1").select("src_type", (F.col("src_id") + 100_000).alias("src_id"), "relation", "dst_id", F.lit(0.5).alias("confidence"), F.lit("proposed").alias("status"))
    return resolution.upsert_edges(old, new.unionByName(fresh)).groupBy("status", "decided_by").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


def parents_propose(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") % 50).alias("parent"))
    out = resolution.propose_parents(model.entities(spark, sf), pairs)
    return out.where("parent_status = 'proposed'").select("id", "parent_id")


# review


def review_entity_page(spark: SparkSession, sf: str) -> DataFrame:
    out = review.review_entities(*graph_of(spark, sf), model.notes(spark, sf), after=("2024-01-02 00:00:00", 40), limit=20)
    return out.select("id", "type", "name", joined("aliases"), "mentions", joined("samples"))


def visible(spark: SparkSession, sf: str) -> DataFrame:
    return review.visible_links(model.edges(spark, sf), model.entities(spark, sf), model.notes(spark, sf), model.revisions(spark, sf))


def review_link_page(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_links(visible(spark, sf), after=paging.decode_cursor(paging.encode_cursor("2024-01-03 00:00:00", 7)), limit=50).select("id", "subject", "relation", "object", "confidence")


def review_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    return visible(spark, sf).groupBy("src_type", "relation").agg(F.count(F.lit(1)).alias("n"))


def entity_list(spark: SparkSession, sf: str) -> DataFrame:
    return review.list_entities(*graph_of(spark, sf), model.notes(spark, sf), type_=None, q="AN", after=(4, "blue nut", 3), limit=50)


def entity_notes(spark: SparkSession, sf: str) -> DataFrame:
    return review.entity_notes(model.edges(spark, sf), model.notes(spark, sf)).select("entity_id", "note_id", "relation", "confidence")


def entity_family(spark: SparkSession, sf: str) -> DataFrame:
    return review.entity_family(model.entities(spark, sf))


def entity_relations(spark: SparkSession, sf: str) -> DataFrame:
    return review.related(model.entities(spark, sf), model.edges(spark, sf)).select("entity_id", "other_id", "relation", "direction", "confidence")


def extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review.extraction_counts(model.notes(spark, sf), model.extractions(spark, sf))


# nightly


def run_windows(spark: SparkSession, sf: str) -> DataFrame:
    return model.runs(spark, sf).select("id", "status", "window_start")


def run_latest(spark: SparkSession, sf: str) -> DataFrame:
    runs = model.runs(spark, sf)
    return nightly.latest(runs).select("id", F.lit("newest").alias("which")).unionByName(nightly.latest(runs, "2024-01-11").select("id", F.lit("of a day").alias("which")))


def run_list(spark: SparkSession, sf: str) -> DataFrame:
    return nightly.remaining(model.runs(spark, sf), model.entities(spark, sf), visible(spark, sf), now()).select("id", "trigger", "status", "remaining")


def run_starts(spark: SparkSession, sf: str) -> DataFrame:
    runs = model.runs(spark, sf)
    wishes = runs.select((F.col("id") * 2).alias("wish_id"), "run_date", F.lit("schedule").alias("trigger")).unionByName(runs.select((F.col("id") * 2 + 1).alias("wish_id"), "run_date", F.lit("manual").alias("trigger")))
    return nightly.start_outcomes(wishes, runs.where("id < 30")).withColumn("open", F.lit(False)).unionByName(nightly.start_outcomes(wishes, runs).withColumn("open", F.lit(True)))


def run_close(spark: SparkSession, sf: str) -> DataFrame:
    """Every run as if it were open, at a time when some are late, some idle and some empty."""
    opened = model.runs(spark, sf).withColumns({"status": F.lit("running"), "queued_new": F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("queued_new")), "queued_failed": F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("queued_failed"))})
    return nightly.close_open(opened, F.lit("2024-01-30 02:03:00").cast("timestamp"), F.col("id") % 2, 6 * 24).select("id", "status", "timed_out", "error")


def work_list(spark: SparkSession, sf: str) -> DataFrame:
    states = model.revisions(spark, sf).select("id", F.col("observed_at").alias("created_at"), "state")
    return nightly.work_list(states.where("state = 'pending'"), states.where("state = 'failed'"), 700)


def digest_of(spark: SparkSession, sf: str) -> nightly.Digest:
    return nightly.digest(model.runs(spark, sf), model.entities(spark, sf), model.edges(spark, sf), visible(spark, sf), model.notes(spark, sf), model.revisions(spark, sf), model.extractions(spark, sf), now())


def digest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(spark, sf).summary


def digest_entities(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(spark, sf).top_entities.select("run_id", "place", "id", "confidence", "source_path")


def digest_links(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(spark, sf).top_links.select("run_id", "place", "id", "kind", "subject", "object")


def digest_failures(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(spark, sf).failed


# sources and chat


def sources_summary(spark: SparkSession, sf: str) -> DataFrame:
    return status.summary(model.notes(spark, sf), model.revisions(spark, sf), model.note_chunks(spark, sf))


def sources_filtered_page(spark: SparkSession, sf: str) -> DataFrame:
    return status.sources_page(model.notes(spark, sf), model.revisions(spark, sf), model.note_chunks(spark, sf), state="failed", q="SRC1", after=("src1/de/1.md",), limit=50)


def sources_retry(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("id"))
    return status.retry_routes(wanted, model.notes(spark, sf), model.revisions(spark, sf), model.note_chunks(spark, sf))


def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    notes = model.notes(spark, sf)
    gone = notes.where("id % 10 = 1").select("path")
    sources, states = ingest.tombstone(notes, model.revisions(spark, sf), gone, now())
    # a note may have died at that very time before, so what is new is told by the difference
    dead = lambda df, name: df.agg(F.count("deleted_at").alias(name))
    deleted = dead(sources, "after").join(dead(notes, "before")).select((F.col("after") - F.col("before")).alias("deleted"))
    return deleted.join(states.agg(F.count_if(F.col("state") == "superseded").alias("superseded"), F.count_if(F.col("state") == "pending").alias("pending")))


def index_swap(spark: SparkSession, sf: str) -> DataFrame:
    """The pending revisions of every second note are indexed, each as one chunk."""
    states, chunks = model.revisions(spark, sf), model.note_chunks(spark, sf)
    indexed = states.where("state = 'pending' AND source_id % 2 = 0").select("source_id", F.col("id").alias("revision_id"), (F.col("id") * 100).alias("id"), F.lit(0).alias("ordinal"), F.lit(False).alias("embedded"))
    sources, states, chunks = ingest.swap_index(model.notes(spark, sf), states, chunks, indexed)
    own = chunks.groupBy(F.col("revision_id").alias("current_revision_id")).agg(F.count(F.lit(1)).alias("chunks"))
    return sources.join(own, "current_revision_id", "left").select("id", "current_revision_id", F.coalesce("chunks", F.lit(0)).alias("chunks")).join(states.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("state")), ",").alias("states")), "id")


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The last question of each conversation, after its other turns, with two of its texts as sources."""
    turns = table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("last"))
    questions = last.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("session_id"), "question")
    history = turns.join(last, "conv_id").where("turn < last AND turn % 2 = 0").select(F.col("conv_id").alias("session_id"), "turn", F.concat(F.lit("q"), "turn").alias("question"), F.concat(F.lit("a"), "turn").alias("answer"))
    sources = turns.where("turn < 2 AND conv_id % 3 > 0").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("n"), F.concat(F.lit("p<"), "turn", F.lit(">")).alias("path"), F.when(F.col("turn") == 1, "H > h").alias("heading"), F.col("role").alias("snippet"))
    return chat.messages(questions, sources, history)


def graph_windows(spark: SparkSession, sf: str) -> DataFrame:
    from quillspark.plans.corpus import chunks

    return graph.window_texts(chunks(spark, sf)).select("doc_id", "window", F.char_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        graph_accept_reject, graph_decide_links, graph_rename, graph_rename_names, graph_retype, graph_set_parent, graph_merge_edges, graph_merge_aliases, resolve_mentions, resolve_relations, merge_windows,
        edges_replace_machine, edges_upsert, parents_propose, review_entity_page, review_link_page, review_link_counts, entity_list, entity_notes, entity_family, entity_relations, extraction_counts, run_windows,
        run_latest, run_list, run_starts, run_close, work_list, digest_summary, digest_entities, digest_links, digest_failures, sources_summary, sources_filtered_page, sources_retry, tombstones, index_swap,
        chat_messages, graph_windows,
    )
}

OWNERS = "owners AS (SELECT type, norm_name AS norm, id AS owner FROM entities UNION ALL SELECT type, norm_alias, entity_id FROM aliases)"
RENAMES = "asked AS (SELECT u.id, CASE WHEN u.id % 25 = 4 THEN ' ' WHEN u.id % 3 = 0 THEN o.name ELSE ' Renamed ' || u.id % 40 END AS raw FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN entities o ON o.id = u.id + 7), judged AS (SELECT a.id, trim(raw) AS new_name, lower(trim(raw)) AS norm, e.type, CASE WHEN coalesce(trim(raw), '') = '' THEN 'invalid_action' WHEN e.id IS NULL THEN 'not_found' WHEN EXISTS (SELECT 1 FROM owners w WHERE w.type = e.type AND w.norm = lower(trim(raw)) AND w.owner <> a.id) OR EXISTS (SELECT 1 FROM asked b JOIN entities f ON f.id = b.id WHERE f.type = e.type AND lower(trim(b.raw)) = lower(trim(a.raw)) AND b.id < a.id AND trim(b.raw) <> '') THEN 'name_taken' ELSE 'renamed' END AS outcome FROM asked a LEFT JOIN entities e ON e.id = a.id)"
MERGES = "mm AS (SELECT l.id AS loser_id, i.id AS into_id FROM (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS n FROM entities) l JOIN (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS n FROM entities) i ON i.type = l.type AND i.n = l.n - 1 WHERE l.n % 2 = 0)"
VISIBLE = "links AS (SELECT g.*, coalesce(h.name, n.title) AS subject, t.name AS object FROM edges g JOIN entities t ON t.id = g.dst_id LEFT JOIN entities h ON g.src_type = 'entity' AND h.id = g.src_id LEFT JOIN notes n ON g.src_type = 'source' AND n.id = g.src_id WHERE g.status = 'proposed' AND (g.src_type = 'entity' AND h.status <> 'rejected' AND t.status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM revisions r JOIN notes d ON d.id = r.source_id WHERE r.id = g.revision_id AND d.deleted_at IS NOT NULL) OR g.src_type = 'source' AND t.status = 'accepted' AND n.id IS NOT NULL AND n.deleted_at IS NULL))"
MENTIONS = "mentions AS (SELECT g.*, n.path FROM edges g JOIN notes n ON n.id = g.src_id AND n.deleted_at IS NULL WHERE g.src_type = 'source' AND g.relation IN ('mentions', 'about'))"
LAST = "lasts AS (SELECT source_id, id AS last_id, state, error FROM revisions QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, id DESC) = 1)"
CHUNKED = "cc AS (SELECT revision_id, count(*) AS chunks, count(*) FILTER (WHERE embedded) AS embedded FROM chunks GROUP BY revision_id)"
EXTRACTED = "said AS (SELECT l_orderkey % 1000 AS source_id, e.type, CASE l_linenumber % 3 WHEN 0 THEN upper(e.name) WHEN 1 THEN a.alias ELSE 'New ' || e.name END AS name, max(round(1 - 5 * l_discount, 4)) AS confidence FROM lineitem l JOIN entities e ON e.id = l.l_partkey JOIN aliases a ON a.entity_id = e.id GROUP BY ALL)"
END = "coalesce(finished_at, TIMESTAMP '2024-01-31 12:00:00')"

SQL: dict[str, str] = {
    "graph_accept_reject": with_model("entities", "edges") + ", d AS (SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'rejected' ELSE 'accepted' END AS decided FROM events WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), st AS (SELECT e.id, coalesce(d.decided, e.status) AS status, d.decided FROM entities e LEFT JOIN d ON d.id = e.id), x AS (SELECT g.*, t.status AS ts, t.decided AS td, h.status AS hs, h.decided AS hd, t.decided = 'accepted' AND relation IN ('mentions', 'about') AND confidence >= 0.5 AS sure FROM edges g LEFT JOIN st t ON t.id = g.dst_id LEFT JOIN st h ON g.src_type = 'entity' AND h.id = g.src_id) SELECT id, CASE WHEN decided_by = 'user' THEN status WHEN td = 'rejected' OR hd = 'rejected' THEN 'rejected' WHEN status = 'rejected' AND ((td = 'accepted' AND coalesce(hs, '') <> 'rejected') OR (hd = 'accepted' AND coalesce(ts, '') <> 'rejected')) THEN CASE WHEN sure THEN 'accepted' ELSE 'proposed' END WHEN status = 'proposed' AND sure THEN 'accepted' ELSE status END AS status FROM x",
    "graph_decide_links": with_model("edges") + ", d AS (SELECT user_id * 10 + 1 + event_id % 3 AS id, CASE event_type WHEN 'click' THEN 'accepted' ELSE 'rejected' END AS decided FROM events WHERE event_type IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id DESC) = 1) SELECT g.id, coalesce(d.decided, g.status) AS status, CASE WHEN d.id IS NULL THEN g.decided_by ELSE 'user' END AS decided_by FROM edges g LEFT JOIN d ON d.id = g.id",
    "graph_rename": with_model("entities", "aliases") + f", {OWNERS}, {RENAMES} SELECT id AS entity_id, outcome FROM judged",
    "graph_rename_names": with_model("entities", "aliases") + f", {OWNERS}, {RENAMES} SELECT e.id, coalesce(j.new_name, e.name) AS name, coalesce(j.norm, e.norm_name) AS norm_name FROM entities e LEFT JOIN judged j ON j.id = e.id AND j.outcome = 'renamed'",
    "graph_retype": with_model("entities", "aliases") + f", {OWNERS}, asked AS (SELECT id, CASE WHEN id % 20 = 3 THEN 'planet' ELSE ['project','person','organization','tool','device','topic'][id * 5 % 6 + 1] END AS new_type FROM (SELECT DISTINCT user_id AS id FROM events)), wanted AS (SELECT a.id, new_type, norm_name AS norm FROM asked a JOIN entities e ON e.id = a.id UNION SELECT a.id, new_type, norm_alias FROM asked a JOIN aliases s ON s.entity_id = a.id), clash AS (SELECT w.id FROM wanted w JOIN owners o ON o.type = w.new_type AND o.norm = w.norm AND o.owner <> w.id UNION SELECT w.id FROM wanted w JOIN wanted v ON v.new_type = w.new_type AND v.norm = w.norm AND v.id < w.id) SELECT a.id AS entity_id, CASE WHEN new_type = 'planet' THEN 'invalid_action' WHEN e.id IS NULL THEN 'not_found' WHEN e.type = new_type THEN 'same' WHEN a.id IN (SELECT id FROM clash) THEN 'name_taken' ELSE 'retyped' END AS outcome FROM asked a LEFT JOIN entities e ON e.id = a.id",
    "graph_set_parent": with_model("entities").replace("WITH ", "WITH RECURSIVE ", 1) + ", asked AS (SELECT id AS child, CASE WHEN id % 4 = 1 THEN id * 10 + 3 WHEN id % 4 <> 0 THEN id % 7 END AS parent FROM entities WHERE id % 3 = 0), w AS (SELECT id, parent_id AS above FROM entities WHERE parent_id IS NOT NULL UNION ALL SELECT w.id, e.parent_id FROM w JOIN entities e ON e.id = w.above WHERE e.parent_id IS NOT NULL) SELECT a.child AS entity_id, CASE WHEN a.parent IS NULL THEN 'cleared' WHEN p.id IS NULL THEN 'not_found' WHEN p.type <> c.type THEN 'type_mismatch' WHEN a.parent = a.child OR EXISTS (SELECT 1 FROM w WHERE w.id = a.parent AND w.above = a.child) THEN 'parent_cycle' ELSE 'set' END AS outcome FROM asked a JOIN entities c ON c.id = a.child LEFT JOIN entities p ON p.id = a.parent",
    "graph_merge_edges": with_model("entities", "edges") + f", {MERGES}, x AS (SELECT g.id, g.src_type, coalesce(h.into_id, g.src_id) AS src_id, relation, coalesce(t.into_id, g.dst_id) AS dst_id, decided_by, confidence, h.into_id IS NOT NULL OR t.into_id IS NOT NULL AS moved FROM edges g LEFT JOIN mm t ON t.loser_id = g.dst_id LEFT JOIN mm h ON g.src_type = 'entity' AND h.loser_id = g.src_id) SELECT id, src_type, src_id, relation, dst_id FROM x WHERE NOT (moved AND src_type = 'entity' AND src_id = dst_id) QUALIFY row_number() OVER (PARTITION BY src_type, src_id, relation, dst_id ORDER BY decided_by = 'user' DESC, confidence DESC, moved, id) = 1",
    "graph_merge_aliases": with_model("entities", "aliases") + f", {MERGES}, heirs AS (SELECT coalesce(m.into_id, a.entity_id) AS entity_id, a.type, a.norm_alias FROM aliases a LEFT JOIN mm m ON m.loser_id = a.entity_id LEFT JOIN entities i ON i.id = m.into_id WHERE m.into_id IS NULL OR a.norm_alias <> i.norm_name), named AS (SELECT m.into_id AS entity_id, l.type, l.norm_name AS norm_alias FROM mm m JOIN entities l ON l.id = m.loser_id JOIN entities i ON i.id = m.into_id WHERE l.norm_name <> i.norm_name) SELECT * FROM heirs UNION ALL SELECT min(entity_id), type, norm_alias FROM named n WHERE NOT EXISTS (SELECT 1 FROM heirs h WHERE h.type = n.type AND h.norm_alias = n.norm_alias) GROUP BY type, norm_alias",
    "resolve_mentions": with_model("entities", "aliases") + f", {EXTRACTED}, k AS (SELECT s.*, lower(name) AS norm, (SELECT min(id) FROM entities e WHERE e.type = s.type AND e.norm_name = lower(s.name)) AS ex, (SELECT min(entity_id) FROM aliases a WHERE a.type = s.type AND a.norm_alias = lower(s.name)) AS al FROM said s), r AS (SELECT source_id, coalesce(ex, al) AS known, CASE WHEN ex IS NULL AND al IS NULL THEN type || ':' || norm END AS new, confidence FROM k), g AS (SELECT source_id AS src_id, known, new, max(confidence) AS confidence FROM r LEFT JOIN entities e ON e.id = r.known WHERE coalesce(e.status, 'proposed') <> 'rejected' GROUP BY ALL) SELECT src_id, known, new, confidence, CASE WHEN e.status = 'accepted' AND confidence >= 0.8 THEN 'accepted' ELSE 'proposed' END AS status FROM g LEFT JOIN entities e ON e.id = g.known",
    "merge_windows": with_model("entities") + ", x AS (SELECT l_orderkey AS revision_id, e.type, e.norm_name AS norm, max(round(1 - 5 * l_discount, 4)) AS confidence, min(l_linenumber) AS seen FROM lineitem l JOIN entities e ON e.id = l.l_partkey GROUP BY ALL) SELECT revision_id, type, norm, confidence, row_number() OVER (PARTITION BY revision_id ORDER BY seen, type, norm) AS ordinal FROM x QUALIFY ordinal <= 30",
    "edges_replace_machine": with_model("edges", "revisions") + ", x AS (SELECT g.status, CASE WHEN decided_by = 'auto' AND starts_with(origin, 'llm:') AND (src_type = 'source' AND src_id IN (SELECT source_id FROM revisions WHERE source_id % 2 = 0) OR src_type = 'entity' AND coalesce(g.revision_id IN (SELECT id FROM revisions WHERE source_id % 2 = 0), false)) THEN 'go' ELSE 'stay' END AS side FROM edges g) SELECT side, status, count(*) AS n FROM x GROUP BY ALL",
    "edges_upsert": with_model("edges") + ", x AS (SELECT CASE WHEN id % 3 = 0 AND decided_by <> 'user' THEN 'accepted' ELSE status END AS status, decided_by, CASE WHEN id % 3 = 0 THEN 0.75 ELSE confidence END AS confidence FROM edges UNION ALL SELECT 'proposed', 'auto', 0.5 FROM edges WHERE id % 3 = 1) SELECT status, decided_by, count(*) AS n, round(sum(confidence), 3) AS confidence FROM x GROUP BY ALL",
    "parents_propose": with_model("entities") + " SELECT c.id, coalesce(c.parent_id, c.id % 50) AS parent_id FROM entities c LEFT JOIN entities p ON p.id = c.id % 50 WHERE CASE WHEN c.parent_id IS NULL THEN p.id IS NOT NULL AND c.id <> p.id AND p.parent_id IS DISTINCT FROM c.id ELSE c.parent_status = 'proposed' END",
    "review_entity_page": with_model("entities", "aliases", "edges", "notes") + f", {MENTIONS}, pg AS (SELECT * FROM entities WHERE status = 'proposed' AND (created_at, id) > (TIMESTAMP '2024-01-02 00:00:00', 40) ORDER BY created_at, id LIMIT 21), one AS (SELECT dst_id, src_id, created_at, path FROM mentions QUALIFY row_number() OVER (PARTITION BY dst_id, src_id ORDER BY created_at DESC, id) = 1), sm AS (SELECT dst_id, path, row_number() OVER (PARTITION BY dst_id ORDER BY created_at DESC, path) AS n FROM one QUALIFY n <= 3) SELECT id, type, name, (SELECT string_agg(alias, '|' ORDER BY alias) FROM aliases a WHERE a.entity_id = pg.id) AS aliases, (SELECT count(*) FROM one WHERE dst_id = pg.id) AS mentions, coalesce((SELECT string_agg(path, '|' ORDER BY n) FROM sm WHERE dst_id = pg.id), '') AS samples FROM pg",
    "review_link_page": with_model("entities", "edges", "notes", "revisions") + f", {VISIBLE} SELECT id, subject, relation, object, confidence FROM links WHERE (created_at, id) > (TIMESTAMP '2024-01-03 00:00:00', 7) ORDER BY created_at, id LIMIT 51",
    "review_link_counts": with_model("entities", "edges", "notes", "revisions") + f", {VISIBLE} SELECT src_type, relation, count(*) AS n FROM links GROUP BY ALL",
    "entity_list": with_model("entities", "aliases", "edges", "notes") + f", {MENTIONS}, x AS (SELECT e.id, e.type, e.name, (SELECT count(DISTINCT src_id) FROM mentions m WHERE m.dst_id = e.id AND m.status = 'accepted') AS notes FROM entities e WHERE e.status = 'accepted' AND (e.name ILIKE '%an%' OR EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.id AND a.alias ILIKE '%an%'))) SELECT * FROM x WHERE notes < 4 OR (notes = 4 AND (name, id) > ('blue nut', 3)) ORDER BY notes DESC, name, id LIMIT 51",
    "entity_notes": with_model("edges", "notes") + f", {MENTIONS}, one AS (SELECT * FROM mentions WHERE status = 'accepted' QUALIFY row_number() OVER (PARTITION BY dst_id, src_id ORDER BY CASE relation WHEN 'about' THEN 0 ELSE 1 END, confidence DESC, id) = 1) SELECT dst_id AS entity_id, src_id AS note_id, relation, confidence FROM one QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY CASE relation WHEN 'about' THEN 0 ELSE 1 END, confidence DESC, path) <= 200",
    "entity_family": with_model("entities") + ", a AS (SELECT * FROM entities WHERE status = 'accepted') SELECT a.id, a.name, p.name AS parent, (SELECT count(*) FROM a c WHERE c.parent_id = a.id AND c.parent_status <> 'rejected') AS children FROM a LEFT JOIN a p ON p.id = a.parent_id AND a.parent_status <> 'rejected'",
    "entity_relations": with_model("entities", "edges") + ", g AS (SELECT * FROM edges WHERE src_type = 'entity' AND status = 'accepted' AND src_id IN (SELECT id FROM entities WHERE status = 'accepted') AND dst_id IN (SELECT id FROM entities WHERE status = 'accepted')) SELECT src_id AS entity_id, dst_id AS other_id, relation, 'out' AS direction, confidence FROM g UNION ALL SELECT dst_id, src_id, relation, 'in', confidence FROM g",
    "extraction_counts": with_model("notes", "extractions") + ", x AS (SELECT n.id, (SELECT arg_max(status, (attempted_at, id)) FROM extractions e WHERE e.revision_id = n.current_revision_id) AS st FROM notes n WHERE deleted_at IS NULL AND current_revision_id IS NOT NULL) SELECT count(*) AS total, count(*) FILTER (WHERE st = 'ok') AS ok, count(*) FILTER (WHERE st = 'failed') AS failed, count(*) FILTER (WHERE st IS NULL) AS pending FROM x",
    "run_windows": with_model("runs") + " SELECT id, status, window_start FROM runs",
    "run_latest": with_model("runs") + " SELECT max(id) AS id, 'newest' AS which FROM runs UNION ALL SELECT id, 'of a day' FROM runs WHERE run_date = DATE '2024-01-11'",
    "run_list": with_model("runs", "entities", "edges", "notes", "revisions") + f", {VISIBLE} SELECT id, trigger, status, (SELECT count(*) FROM entities e WHERE e.status = 'proposed' AND e.created_at >= r.started_at AND e.created_at < {END}) + (SELECT count(*) FROM links l WHERE l.created_at >= r.started_at AND l.created_at < {END}) AS remaining FROM runs r",
    "run_starts": with_model("runs") + ", w AS (SELECT id * 2 AS wish_id, run_date, 'schedule' AS trigger FROM runs UNION ALL SELECT id * 2 + 1, run_date, 'manual' FROM runs), o AS (SELECT unnest([true, false]) AS open) SELECT wish_id, open, CASE WHEN trigger = 'schedule' AND EXISTS (SELECT 1 FROM runs r WHERE r.run_date = w.run_date AND r.trigger = 'schedule' AND r.status <> 'failed' AND (o.open OR r.id < 30)) THEN 'already_started' WHEN open THEN 'busy' ELSE 'started' END AS outcome FROM w, o",
    "run_close": with_model("runs") + ", x AS (SELECT id, id % 4 = 0 OR queued_new + queued_failed = 0 AS empty, TIMESTAMP '2024-01-30 02:03:00' - started_at AS age FROM runs) SELECT id, CASE WHEN empty AND age >= INTERVAL 5 MINUTE THEN 'failed' WHEN NOT empty AND (age > INTERVAL 144 HOUR OR id % 2 = 0) THEN 'complete' ELSE 'running' END AS status, NOT empty AND (age > INTERVAL 144 HOUR) AS timed_out, CASE WHEN empty AND age >= INTERVAL 5 MINUTE THEN 'start_interrupted' END AS error FROM x",
    "work_list": with_model("revisions") + ", q AS (SELECT id, observed_at, CASE state WHEN 'pending' THEN 0 ELSE 1 END AS class FROM revisions WHERE state IN ('pending', 'failed')) SELECT id, class, row_number() OVER (ORDER BY class, observed_at, id) AS place FROM q QUALIFY place <= 700",
    "digest_summary": with_model("runs", "entities", "edges", "notes", "revisions", "extractions") + f", {VISIBLE}, r AS (SELECT *, {END} AS out_end, coalesce(window_start, TIMESTAMP '1900-01-01') AS win FROM runs), x AS (SELECT r.id AS run_id, r.window_start IS NULL AS since_beginning, least((SELECT count(DISTINCT revision_id) FROM extractions x WHERE x.attempted_at >= r.started_at AND x.attempted_at < out_end), queued_new + queued_failed) AS done, (SELECT count(*) FROM entities e WHERE e.status = 'proposed' AND e.created_at >= r.started_at AND e.created_at < out_end) AS entities, (SELECT count(*) FROM links l WHERE l.created_at >= r.started_at AND l.created_at < out_end) AS links, (SELECT count(DISTINCT n.id) FROM extractions x JOIN notes n ON n.current_revision_id = x.revision_id AND n.deleted_at IS NULL WHERE x.status = 'failed' AND x.attempted_at >= r.started_at AND x.attempted_at < out_end AND NOT EXISTS (SELECT 1 FROM extractions k WHERE k.revision_id = x.revision_id AND k.status = 'ok' AND k.attempted_at > x.attempted_at)) AS failed, (SELECT count(*) FROM notes n WHERE n.created_at >= win AND n.created_at < r.started_at) AS created, (SELECT count(DISTINCT v.source_id) FROM revisions v JOIN notes n ON n.id = v.source_id WHERE v.observed_at >= win AND v.observed_at < r.started_at AND NOT (n.created_at >= win AND n.created_at < r.started_at) AND EXISTS (SELECT 1 FROM revisions o WHERE o.source_id = v.source_id AND o.observed_at < v.observed_at)) AS changed, (SELECT count(*) FROM notes n WHERE n.deleted_at >= win AND n.deleted_at < r.started_at) AS deleted FROM r) SELECT *, entities + links AS remaining, (SELECT count(*) FROM entities WHERE status = 'proposed') + (SELECT count(*) FROM links) AS open_total FROM x",
    "digest_entities": with_model("runs", "entities", "edges", "notes") + f", {MENTIONS}, b AS (SELECT dst_id, max(confidence) AS confidence, arg_min(path, (created_at, id)) AS source_path FROM mentions GROUP BY dst_id) SELECT r.id AS run_id, row_number() OVER (PARTITION BY r.id ORDER BY b.confidence DESC NULLS LAST, e.name, e.id) AS place, e.id, b.confidence, b.source_path FROM runs r JOIN entities e ON e.status = 'proposed' AND e.created_at >= r.started_at AND e.created_at < {END} LEFT JOIN b ON b.dst_id = e.id QUALIFY place <= 5",
    "digest_links": with_model("runs", "entities", "edges", "notes", "revisions") + f", {VISIBLE} SELECT r.id AS run_id, row_number() OVER (PARTITION BY r.id ORDER BY l.confidence DESC, l.created_at, l.id) AS place, l.id, CASE l.src_type WHEN 'entity' THEN 'relation' ELSE 'mention' END AS kind, subject, object FROM runs r JOIN links l ON l.created_at >= r.started_at AND l.created_at < {END} QUALIFY place <= 5",
    "digest_failures": with_model("runs", "notes", "extractions") + f", f AS (SELECT r.id AS run_id, n.id, n.path, x.error FROM runs r JOIN extractions x ON x.status = 'failed' AND x.attempted_at >= r.started_at AND x.attempted_at < {END} JOIN notes n ON n.current_revision_id = x.revision_id AND n.deleted_at IS NULL WHERE NOT EXISTS (SELECT 1 FROM extractions k WHERE k.revision_id = x.revision_id AND k.status = 'ok' AND k.attempted_at > x.attempted_at) QUALIFY row_number() OVER (PARTITION BY r.id, n.id ORDER BY x.attempted_at DESC, x.id DESC) = 1) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY path) AS place, path, error FROM f QUALIFY place <= 10",
    "sources_summary": with_model("notes", "revisions", "chunks") + f", {LAST}, {CHUNKED}, x AS (SELECT n.deleted_at IS NULL AS live, l.state, l.error, chunks, embedded FROM notes n LEFT JOIN lasts l ON l.source_id = n.id LEFT JOIN cc ON cc.revision_id = n.current_revision_id) SELECT count(*) FILTER (WHERE live) AS active, count(*) FILTER (WHERE NOT live) AS deleted, count(*) FILTER (WHERE live AND state = 'pending') AS pending, count(*) FILTER (WHERE live AND state = 'indexed') AS indexed, count(*) FILTER (WHERE live AND state = 'failed') AS failed, coalesce(sum(chunks) FILTER (WHERE live), 0)::BIGINT AS chunks, coalesce(sum(embedded) FILTER (WHERE live), 0)::BIGINT AS embedded, (SELECT error FROM x WHERE live AND error IS NOT NULL GROUP BY error ORDER BY count(*) DESC, error LIMIT 1) AS common_error FROM x",
    "sources_filtered_page": with_model("notes", "revisions", "chunks") + f", {LAST}, {CHUNKED} SELECT n.id, title, path, state, l.error, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded FROM notes n JOIN lasts l ON l.source_id = n.id LEFT JOIN cc ON cc.revision_id = n.current_revision_id WHERE deleted_at IS NULL AND state = 'failed' AND path ILIKE '%src1%' AND path > 'src1/de/1.md' ORDER BY path LIMIT 51",
    "sources_retry": with_model("notes", "revisions", "chunks") + f", {LAST}, {CHUNKED} SELECT w.id, CASE WHEN n.id IS NULL THEN 'missing' WHEN deleted_at IS NOT NULL THEN 'none' WHEN state = 'failed' THEN CASE error WHEN 'index_error' THEN 'index' ELSE 'none' END WHEN chunks > embedded THEN 'embed' ELSE 'none' END AS route FROM (SELECT DISTINCT doc_id * 2 AS id FROM labels) w LEFT JOIN notes n ON n.id = w.id LEFT JOIN lasts l ON l.source_id = n.id LEFT JOIN cc ON cc.revision_id = n.current_revision_id",
    "tombstones": with_model("notes", "revisions") + ", c AS (SELECT count(*) FILTER (WHERE id % 10 = 1) AS m, count(*) AS l FROM notes WHERE deleted_at IS NULL), ok AS (SELECT NOT (m > 10 AND m * 5 > l) AS yes FROM c), d AS (SELECT id FROM notes, ok WHERE yes AND deleted_at IS NULL AND id % 10 = 1), s AS (SELECT CASE WHEN state = 'pending' AND source_id IN (SELECT id FROM d) THEN 'superseded' ELSE state END AS state FROM revisions) SELECT (SELECT count(*) FROM d) AS deleted, count(*) FILTER (WHERE state = 'superseded') AS superseded, count(*) FILTER (WHERE state = 'pending') AS pending FROM s",
    "index_swap": with_model("notes", "revisions", "chunks") + ", p AS (SELECT source_id, id FROM revisions WHERE state = 'pending' AND source_id % 2 = 0), s AS (SELECT r.source_id AS id, string_agg(CASE WHEN r.id = p.id THEN 'indexed' WHEN p.id IS NOT NULL AND state = 'indexed' THEN 'superseded' ELSE state END, ',' ORDER BY CASE WHEN r.id = p.id THEN 'indexed' WHEN p.id IS NOT NULL AND state = 'indexed' THEN 'superseded' ELSE state END) AS states FROM revisions r LEFT JOIN p ON p.source_id = r.source_id GROUP BY r.source_id) SELECT n.id, coalesce(p.id, n.current_revision_id) AS current_revision_id, CASE WHEN p.id IS NOT NULL THEN 1 ELSE (SELECT count(*) FROM chunks c WHERE c.revision_id = n.current_revision_id) END AS chunks, s.states FROM notes n LEFT JOIN p ON p.source_id = n.id JOIN s ON s.id = n.id",
    "chat_messages": "WITH l AS (SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS last FROM conversations GROUP BY conv_id), h AS (SELECT c.conv_id AS query_id, c.turn, unnest(['user', 'assistant']) AS role, unnest(['q' || turn, 'a' || turn]) AS content, unnest([0, 1]) AS part FROM (SELECT c.* FROM conversations c JOIN l USING (conv_id) WHERE turn < last AND turn % 2 = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) c), s AS (SELECT conv_id, string_agg('[' || turn + 1 || '] p&lt;' || turn || '&gt;' || CASE WHEN turn = 1 THEN ' — H &gt; h' ELSE '' END || chr(10) || role, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE turn < 2 AND conv_id % 3 > 0 GROUP BY conv_id), a AS (SELECT query_id, turn, part, role, content FROM h UNION ALL SELECT l.conv_id, 9223372036854775807, 0, 'user', '<sources>' || chr(10) || coalesce(s.t, '(no matching sources)') || chr(10) || '</sources>' || chr(10) || chr(10) || 'Question: ' || question FROM l LEFT JOIN s ON s.conv_id = l.conv_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, part) AS place, role, content FROM a",
}
