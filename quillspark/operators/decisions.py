"""The owner's decisions on the graph: accept, reject, rename, retype, set parents, merge, and decide links.

Every operator takes a frame of decisions and gives new frames of entities, aliases and edges, so one job applies many.
Within one batch decisions see the state before it; where two concern the same thing, the last one counts.

entities: id, type, name, norm_name, status, parent_id, parent_status, ... ; aliases: entity_id, type, alias, norm_alias;
edges: id, src_type (source or entity), src_id, relation, dst_id, confidence, status, decided_by, ...
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalise_name
from quillspark.operators.graph import TYPES, chains, would_cycle

ACCEPT_FROM, MAX_NAME = 0.5, 200


class Graph(NamedTuple):
    entities: DataFrame
    aliases: DataFrame
    edges: DataFrame


def last_of(decisions: DataFrame, key: str, order: str = "seq") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return decisions.withColumn("__n", place).where("__n = 1").drop("__n")


def decide_entities(entities: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after decisions: entity_id, action (accept or reject), seq.

    A reject takes every automatic edge at the entity with it. An accept brings automatic rejected edges back, unless
    the other end is a rejected entity, and accepts a note's confident automatic mentions of it. Edges that a user
    decided never change. Rejects come last where both ends of an edge are decided at once.
    """
    chosen = last_of(decisions, "entity_id").select(F.col("entity_id").alias("id"), F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").alias("decided"))
    after = entities.join(chosen, "id", "left").withColumn("status", F.coalesce("decided", "status"))
    state = after.select("id", "status", "decided")
    ends = edges.join(state.select(F.col("id").alias("dst_id"), F.col("status").alias("__dst"), F.col("decided").alias("__dst_new")), "dst_id", "left").join(
        state.select(F.col("id").alias("src_id"), F.lit("entity").alias("src_type"), F.col("status").alias("__src"), F.col("decided").alias("__src_new")), ["src_id", "src_type"], "left"
    )
    turned_down = (F.col("__dst_new") == "rejected") | (F.col("__src_new") == "rejected")
    confident = (F.col("__dst_new") == "accepted") & F.col("relation").isin("mentions", "about") & (F.col("confidence") >= ACCEPT_FROM)
    # the end that wasn't accepted here decides whether a rejected edge may come back
    back = ((F.col("__dst_new") == "accepted") & ~(F.col("__src") == "rejected").eqNullSafe(True)) | ((F.col("__src_new") == "accepted") & ~(F.col("__dst") == "rejected").eqNullSafe(True))
    status = (
        F.when(F.col("decided_by") != "auto", F.col("status")).when(turned_down, "rejected")
        .when((F.col("status") == "rejected") & back, F.when(confident, "accepted").otherwise("proposed")).when((F.col("status") == "proposed") & confident, "accepted").otherwise(F.col("status"))
    )
    return after.drop("decided"), ends.withColumn("status", status).select(*edges.columns)


def decide_links(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """edges after decisions: edge_id, action, seq; unknown edges and actions are passed over."""
    known = decisions.where(F.col("action").isin("accept", "reject"))
    chosen = last_of(known, "edge_id").select(F.col("edge_id").alias("id"), F.when(F.col("action") == "accept", "accepted").otherwise("rejected").alias("__new"))
    out = edges.join(chosen, "id", "left")
    return out.withColumns({"status": F.coalesce("__new", "status"), "decided_by": F.when(F.col("__new").isNotNull(), "user").otherwise(F.col("decided_by"))}).select(*edges.columns)


def owners(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """type, norm and owner: what every name and alias belongs to."""
    return entities.select("type", F.col("norm_name").alias("norm"), F.col("id").alias("owner")).unionByName(aliases.select("type", F.col("norm_alias").alias("norm"), F.col("entity_id").alias("owner")))


def taken(wanted: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """id of each row of wanted (id, type, norm) whose name another entity owns, or a smaller id of the batch wants."""
    others = wanted.join(owners(entities, aliases), ["type", "norm"]).where("owner <> id").select("id")
    rivals = wanted.withColumn("__first", F.min("id").over(Window.partitionBy("type", "norm"))).where("id <> __first").select("id")
    return others.unionByName(rivals).distinct()


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases with new ones whose type and name none has yet; of equal new ones that of the smallest entity, then text."""
    fresh = new.select(*aliases.columns).join(aliases.select("type", "norm_alias"), ["type", "norm_alias"], "left_anti")
    place = F.row_number().over(Window.partitionBy("type", "norm_alias").orderBy("entity_id", "alias"))
    return aliases.unionByName(fresh.withColumn("__n", place).where("__n = 1").select(*aliases.columns))


def clean_name(name: Column) -> tuple[Column, Column]:
    """Shown name and whether it may be one: not blank, no control characters, bounded."""
    shown = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    valid = (shown != "") & ~shown.rlike(r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]") & (F.char_length(shown) <= MAX_NAME)
    return shown, F.coalesce(valid, F.lit(False))


def rename(graph: Graph, renames: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after renames (entity_id, name, seq) and entity_id, outcome: renamed, name_taken, invalid_action, not_found.

    The old name becomes an alias; an alias of the entity's own that equals the new name goes.
    """
    shown, valid = clean_name(F.col("name"))
    asked = last_of(renames, "entity_id").select(F.col("entity_id").alias("id"), shown.alias("new_name"), valid.alias("valid")).withColumn("norm", normalise_name("new_name"))
    asked = asked.join(graph.entities.select("id", "type", F.col("name").alias("old_name"), F.col("norm_name").alias("old_norm")), "id", "left")
    bad = taken(asked.where("valid AND type IS NOT NULL").select("id", "type", "norm"), graph.entities, graph.aliases).withColumn("clash", F.lit(True))
    judged = asked.join(bad, "id", "left").withColumn(
        "outcome", F.when(~F.col("valid"), "invalid_action").when(F.col("type").isNull(), "not_found").when(F.col("clash"), "name_taken").otherwise("renamed")
    )
    done = judged.where("outcome = 'renamed'")
    named = graph.entities.join(done.select("id", "new_name", "norm"), "id", "left")
    named = named.withColumns({"name": F.coalesce("new_name", "name"), "norm_name": F.coalesce("norm", "norm_name")}).select(*graph.entities.columns)
    kept = graph.aliases.join(done.select(F.col("id").alias("entity_id"), "type", F.col("norm").alias("norm_alias")), ["entity_id", "type", "norm_alias"], "left_anti").select(*graph.aliases.columns)
    old = done.where("old_norm <> norm").select(F.col("id").alias("entity_id"), "type", F.col("old_name").alias("alias"), F.col("old_norm").alias("norm_alias"))
    return Graph(named, add_aliases(kept, old), graph.edges), judged.select(F.col("id").alias("entity_id"), "outcome")


def retype(graph: Graph, retypes: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after retypes (entity_id, type, seq) and entity_id, outcome: retyped, same, name_taken, invalid_action, not_found.

    Names and aliases are matched under the new type too; the old ones stay as redirects, and the old name joins them. A
    parent of another type is let go.
    """
    asked = last_of(retypes, "entity_id").select(F.col("entity_id").alias("id"), F.col("type").alias("new_type")).join(graph.entities.select("id", "type", "name", "norm_name", "parent_id"), "id", "left")
    own = graph.aliases.select(F.col("entity_id").alias("id"), "alias", "norm_alias", F.col("type").alias("alias_type"))
    names = asked.select("id", F.col("new_type").alias("type"), F.col("norm_name").alias("norm")).unionByName(asked.join(own, "id").select("id", F.col("new_type").alias("type"), F.col("norm_alias").alias("norm")))
    bad = taken(names.where("norm IS NOT NULL").distinct(), graph.entities, graph.aliases).withColumn("clash", F.lit(True))
    judged = asked.join(bad, "id", "left").withColumn(
        "outcome",
        F.when(~F.col("new_type").isin(TYPES), "invalid_action").when(F.col("type").isNull(), "not_found").when(F.col("type") == F.col("new_type"), "same").when(F.col("clash"), "name_taken").otherwise("retyped"),
    )
    done = judged.where("outcome = 'retyped'").select("id", "new_type", F.col("type").alias("old_type"), F.col("norm_name").alias("own_norm"), F.col("name").alias("own_name"))
    parents = graph.entities.select(F.col("id").alias("parent_id"), F.col("type").alias("parent_type"))
    named = graph.entities.join(done.select("id", "new_type"), "id", "left").join(parents, "parent_id", "left")
    lost = F.col("new_type").isNotNull() & ~F.col("parent_type").eqNullSafe(F.col("new_type"))
    named = named.withColumns({"parent_status": F.when(~lost, F.col("parent_status")), "parent_id": F.when(~lost, F.col("parent_id")), "type": F.coalesce("new_type", "type")}).select(*graph.entities.columns)
    moved = done.join(own, "id").where("alias_type <> new_type AND norm_alias <> own_norm").select(F.col("id").alias("entity_id"), F.col("new_type").alias("type"), "alias", "norm_alias")
    redirect = done.select(F.col("id").alias("entity_id"), F.col("old_type").alias("type"), F.col("own_name").alias("alias"), F.col("own_norm").alias("norm_alias"))
    kept = graph.aliases.join(done.select(F.col("id").alias("entity_id"), F.col("new_type").alias("type"), F.col("own_norm").alias("norm_alias")), ["entity_id", "type", "norm_alias"], "left_anti").select(*graph.aliases.columns)
    return Graph(named, add_aliases(kept, moved.unionByName(redirect)), graph.edges), judged.select(F.col("id").alias("entity_id"), "outcome")


def set_parents(entities: DataFrame, wishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities after wishes (entity_id, parent_id or null, seq) and entity_id, outcome: set, cleared, not_found, type_mismatch, parent_cycle."""
    kinds = entities.select(F.col("id").alias("parent"), F.col("type").alias("parent_type"))
    asked = last_of(wishes, "entity_id").select(F.col("entity_id").alias("child"), F.col("parent_id").alias("parent")).join(entities.select(F.col("id").alias("child"), "type"), "child", "left").join(kinds, "parent", "left")
    links = entities.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("parent"))
    loops = would_cycle(links, asked.where("parent IS NOT NULL").select("child", "parent")).select("child", "cycle")
    outcome = (
        F.when(F.col("type").isNull(), "not_found").when(F.col("parent").isNull(), "cleared").when(F.col("parent_type").isNull(), "not_found")
        .when(F.col("parent_type") != F.col("type"), "type_mismatch").when(F.col("cycle"), "parent_cycle").otherwise("set")
    )
    judged = asked.join(loops, "child", "left").withColumn("outcome", outcome)
    done = judged.where(F.col("outcome").isin("set", "cleared")).select(F.col("child").alias("id"), F.col("parent").alias("__parent"), F.lit(True).alias("__done"))
    after = entities.join(done, "id", "left").withColumns({
        "parent_status": F.when(F.col("__done"), F.when(F.col("__parent").isNotNull(), "accepted")).otherwise(F.col("parent_status")), "parent_id": F.when(F.col("__done"), F.col("__parent")).otherwise(F.col("parent_id")),
    })
    return after.select(*entities.columns), judged.select(F.col("child").alias("entity_id"), "outcome")


def merge(graph: Graph, merges: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after merges (loser_id, into_id; no entity in two of them) and loser_id, outcome: merged, invalid_action, not_found, type_mismatch.

    Edges move to the surviving entity; of equal keys a user's decision wins, then the higher confidence, then the
    survivor's own; loops go. Aliases move and the loser's name becomes one. The survivor may not hang under the loser,
    nor a child of the loser that is above the survivor under it; a survivor without a parent takes the loser's, if
    that has its type and closes no loop.
    """
    e = graph.entities
    asked = merges.select("loser_id", "into_id").distinct()
    asked = asked.join(e.select(F.col("id").alias("loser_id"), F.col("type").alias("loser_type"), F.col("parent_id").alias("loser_parent"), F.col("parent_status").alias("loser_parent_status"), F.col("name").alias("loser_name"), F.col("norm_name").alias("loser_norm")), "loser_id", "left")
    asked = asked.join(e.select(F.col("id").alias("into_id"), F.col("type").alias("into_type"), F.col("parent_id").alias("into_parent"), F.col("norm_name").alias("into_norm")), "into_id", "left")
    outcome = F.when(F.col("loser_id") == F.col("into_id"), "invalid_action").when(F.col("loser_type").isNull() | F.col("into_type").isNull(), "not_found").when(F.col("loser_type") != F.col("into_type"), "type_mismatch").otherwise("merged")
    judged = asked.withColumn("outcome", outcome)
    done = judged.where("outcome = 'merged'")
    to = done.select(F.col("loser_id").alias("__from"), F.col("into_id").alias("__to"))

    edges = graph.edges.join(to.withColumnsRenamed({"__from": "dst_id", "__to": "__dst"}), "dst_id", "left")
    edges = edges.join(to.select(F.col("__from").alias("src_id"), F.lit("entity").alias("src_type"), F.col("__to").alias("__src")), ["src_id", "src_type"], "left")
    edges = edges.withColumns({"__moved": F.col("__dst").isNotNull() | F.col("__src").isNotNull(), "dst_id": F.coalesce("__dst", "dst_id"), "src_id": F.coalesce("__src", "src_id")})
    edges = edges.where(~(F.col("__moved") & (F.col("src_type") == "entity") & (F.col("src_id") == F.col("dst_id"))))
    place = F.row_number().over(Window.partitionBy("src_type", "src_id", "relation", "dst_id").orderBy(F.desc(F.col("decided_by") == "user"), F.desc("confidence"), "__moved", "id"))
    edges = edges.withColumn("__n", place).where("__n = 1").select(*graph.edges.columns)

    heirs = graph.aliases.join(done.select(F.col("loser_id").alias("entity_id"), "into_id", "into_norm"), "entity_id", "left")
    heirs = heirs.where("into_id IS NULL OR norm_alias <> into_norm").withColumn("entity_id", F.coalesce("into_id", "entity_id")).select(*graph.aliases.columns)
    names = done.where("loser_norm <> into_norm").select(F.col("into_id").alias("entity_id"), F.col("into_type").alias("type"), F.col("loser_name").alias("alias"), F.col("loser_norm").alias("norm_alias"))

    links = e.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("parent"))
    above = chains(links).withColumnsRenamed({"id": "__of"})
    # what a survivor may take over: a parent of its type from which neither the loser nor itself is reached
    carried = done.where("loser_parent IS NOT NULL AND (into_parent IS NULL OR into_parent = loser_id)")
    carried = carried.join(e.select(F.col("id").alias("loser_parent"), F.col("type").alias("parent_type")), "loser_parent").where("parent_type = into_type").join(above, F.col("__of") == F.col("loser_parent"), "left")
    walk = F.concat(F.array("loser_parent"), F.coalesce("chain", F.array().cast(f"array<{e.schema['id'].dataType.simpleString()}>")))
    carried = carried.where(~F.array_contains(walk, F.col("loser_id")) & ~F.array_contains(walk, F.col("into_id"))).select(F.col("into_id").alias("id"), F.col("loser_parent").alias("__carried"), F.col("loser_parent_status").alias("__carried_status"))
    # children of the loser hang under the survivor, but not the survivor itself, nor one above it
    moved = done.join(above, F.col("__of") == F.col("into_id"), "left").select(F.col("loser_id").alias("parent_id"), "into_id", "chain")
    out = e.join(to.select(F.col("__from").alias("id")), "id", "left_anti").join(moved, "parent_id", "left").join(carried, "id", "left")
    hangs = F.col("into_id").isNotNull()
    above_it = F.coalesce(F.array_contains("chain", F.col("id")) & (F.get("chain", 0) != F.col("parent_id")), F.lit(False))
    loose = hangs & ((F.col("id") == F.col("into_id")) | above_it)
    out = out.withColumns({
        "parent_status": F.when(F.col("__carried").isNotNull(), F.col("__carried_status")).when(~loose, F.col("parent_status")),
        "parent_id": F.when(F.col("__carried").isNotNull(), F.col("__carried")).when(~loose, F.when(hangs, F.col("into_id")).otherwise(F.col("parent_id"))),
    })
    return Graph(out.select(*e.columns), add_aliases(heirs, names), edges), judged.select("loser_id", "outcome")
