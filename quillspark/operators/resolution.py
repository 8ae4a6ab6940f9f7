"""From what a model extracted to entities and edges: merging windows, looking names up, resolving, proposing.

One batch takes any number of notes. Names are matched against the entities before the batch; equal new names of a
batch make one entity, so notes of one batch don't depend on each other's order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalise_name
from quillspark.operators.graph import MAX_ALIASES, MAX_ENTITIES, MAX_RELATIONS, NOTE, written
from quillspark.operators.search import knn
from quillspark.operators.vector_index import VectorIndex

AUTO_ACCEPT, SIMILAR, MAX_SUGGESTED = 0.8, 0.90, 10

# The types that a relation's subject and object are meant to have.
ENDPOINTS = {"uses": (["project"], ["tool"]), "runs_on": (["tool", "project"], ["device"]), "works_with": (["person"], ["organization", "project"])}


def initial_status(match: Column, entity_status: Column, confidence: Column, threshold: float = AUTO_ACCEPT) -> Column:
    """accepted for a confident match by name or alias of an accepted entity, else proposed."""
    sure = (entity_status == "accepted") & match.isin("exact", "alias") & (confidence >= threshold)
    return F.when(sure, "accepted").otherwise("proposed")


def merge_outputs(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of each revision over its windows; outputs: revision_id, window, entities, relations.

    Equal (type, name) and (subject, relation, object) become one with the highest confidence, in the order of first
    sight; 30 entities and 50 relations stay. Aliases are the first five of all. Names compare as normalise_name does.
    """
    of = ["revision_id"]

    def ordered(column: str) -> DataFrame:
        return outputs.select(*of, "window", F.posexplode(column).alias("place", "x")).select(*of, F.struct("window", "place").alias("seen"), "x.*")

    e = ordered("entities").withColumn("norm", normalise_name("name"))
    names = e.groupBy(*of, "type", "norm").agg(F.min("seen").alias("seen"), F.min_by("name", "seen").alias("name"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("seen", "aliases"))).alias("all"))
    names = names.withColumn("aliases", F.slice(F.array_distinct(F.flatten(F.transform("all", lambda a: F.coalesce(a["aliases"], F.array().cast("array<string>"))))), 1, MAX_ALIASES)).drop("all")
    r = ordered("relations").withColumns({"s": normalise_name("subject"), "o": normalise_name("object")})
    links = r.groupBy(*of, "s", "relation", "o").agg(
        F.min("seen").alias("seen"), F.min_by("subject", "seen").alias("subject"), F.min_by("object", "seen").alias("object"), F.max("confidence").alias("confidence"), F.min_by("chunk", F.when(F.col("chunk").isNotNull(), F.col("seen"))).alias("chunk")
    )

    def first(df: DataFrame, most: int, *key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*of).orderBy("seen", *key))
        return df.withColumn("ordinal", place).where(F.col("ordinal") <= most).drop("seen")

    return first(names, MAX_ENTITIES, "type", "norm"), first(links, MAX_RELATIONS, "s", "relation", "o")


def evidence(labels: DataFrame, mentions: DataFrame) -> DataFrame:
    """The chunk behind a label of a window: the first mention of a key whose label is known gives its evidence.

    labels: revision_id, window, label, chunk_id; mentions: revision_id, window, key, label, place.
    """
    known = mentions.join(labels, ["revision_id", "window", "label"])
    return known.groupBy("revision_id", "key").agg(F.min_by("chunk_id", F.struct("window", "place")).alias("chunk_id"))


def lookup(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """type, norm, id and match (exact or alias) of names that are known; names: type, norm. The smallest id of equals."""
    wanted = names.select("type", "norm").distinct()
    exact = wanted.join(entities.select("type", F.col("norm_name").alias("norm"), "id"), ["type", "norm"]).groupBy("type", "norm").agg(F.min("id").alias("exact"))
    alias = wanted.join(aliases.select("type", F.col("norm_alias").alias("norm"), "entity_id"), ["type", "norm"]).groupBy("type", "norm").agg(F.min("entity_id").alias("alias"))
    both = wanted.join(exact, ["type", "norm"], "left").join(alias, ["type", "norm"], "left").where("exact IS NOT NULL OR alias IS NOT NULL")
    return both.select("type", "norm", F.coalesce("exact", "alias").alias("id"), F.when(F.col("exact").isNotNull(), "exact").otherwise("alias").alias("match"))


def similar(names: DataFrame, vectors: DataFrame, entities: DataFrame, floor: float = SIMILAR, index: VectorIndex | None = None) -> DataFrame:
    """type, norm and id of the nearest entity of the type that isn't rejected; names: type, norm, vector; vectors: id, embedding.

    Equal vectors of a type count once, for their smallest id. Names meet vectors as products of blocks, each task keeping
    the nearest of its own, so no pair of a name and an entity is a row. With an index of the open entities' vectors by
    type (see open_vectors), only the cells around a name are read.
    """
    asked = written(names.where("vector IS NOT NULL").groupBy("type", "vector").agg(F.collect_set("norm").alias("norms")).withColumn("query_id", F.monotonically_increasing_id()))
    queries = asked.select("query_id", F.col("vector").alias("query_vector"), "type")
    found = knn(open_vectors(vectors, entities), queries, 1, by="type") if index is None else index.search(queries, 1, by="type")
    near = found.where(F.col("similarity") >= floor).join(asked, "query_id")
    return near.select("type", F.explode("norms").alias("norm"), F.col("vec_id").alias("id"))


def open_vectors(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """vec_id, embedding and type of the entities that aren't rejected, equal vectors of a type once."""
    rows = entities.where("status <> 'rejected'").select("id", "type").join(vectors.select("id", "embedding"), "id").where("embedding IS NOT NULL")
    return rows.groupBy("type", "embedding").agg(F.min("id").alias("vec_id")).select("vec_id", "embedding", "type")


class Resolved(NamedTuple):
    created: DataFrame  # id, type, name, norm_name, status
    created_aliases: DataFrame  # entity_id, type, alias, norm_alias
    edges: DataFrame  # src_type, src_id, relation, dst_id, confidence, status, evidence
    suggested: DataFrame  # entity_id, alias
    parents: DataFrame  # child, parent
    dropped: DataFrame  # source_id, norm: names of rejected entities


def resolve(mentions: DataFrame, relations: DataFrame, entities: DataFrame, aliases: DataFrame, near: DataFrame | None = None, prior: DataFrame | None = None, threshold: float = AUTO_ACCEPT) -> Resolved:
    """What a batch of notes says of entities.

    mentions: source_id, type, name, aliases, confidence, evidence; relations: source_id, subject, relation, object,
    confidence, evidence; near: what `similar` finds for names that are not known; prior: src_type, src_id, relation,
    dst_id of machine edges that were accepted before. A name is tried first, then its aliases in order, each as a
    name before as an alias; then comes the near entity, then a new one, whose id is a hash of type and name.
    """
    # mentions are read by what follows some five times, so they are written once, with their names compared
    m = written(mentions.withColumn("norm", normalise_name("name")))
    own_keys = m.select("type", "norm", F.lit(0).alias("place"), F.col("norm").alias("key"))
    other_keys = m.select("type", "norm", F.posexplode("aliases").alias("place", "key")).select("type", "norm", F.col("place") + 1, normalise_name("key").alias("key"))
    tried = own_keys.union(other_keys).where("key <> ''").distinct()
    known = lookup(tried.select("type", F.col("key").alias("norm")), entities, aliases).withColumnRenamed("norm", "key")
    found = tried.join(known, ["type", "key"]).groupBy("type", "norm").agg(F.min_by(F.struct("id", "match"), F.struct("place", "key")).alias("hit")).select("type", "norm", "hit.*")
    if near is not None:
        rest = near.join(found.select("type", "norm"), ["type", "norm"], "left_anti").select("type", "norm", "id", F.lit("similar").alias("match"))
        found = found.unionByName(rest)
    seen = m.groupBy("type", "norm").agg(F.min("name").alias("name"))
    new_id = F.xxhash64("type", "norm")
    placed = seen.join(found, ["type", "norm"], "left").select("type", "norm", "name", F.coalesce("id", new_id).alias("id"), F.coalesce("match", F.lit("new")).alias("match"))
    placed = written(placed.join(entities.select("id", F.col("status").alias("known_status")), "id", "left").withColumn("status", F.coalesce("known_status", F.lit("proposed"))).drop("known_status"))
    created = placed.where("match = 'new'").select("id", "type", "name", F.col("norm").alias("norm_name"), "status")
    own = m.join(created.select("type", F.col("norm_name").alias("norm"), F.col("id").alias("entity_id")), ["type", "norm"]).select("entity_id", "type", F.explode("aliases").alias("alias")).withColumn("norm_alias", normalise_name("alias"))
    own = own.join(created.select("type", F.col("norm_name").alias("norm_alias")), ["type", "norm_alias"], "left_anti").join(aliases.select("type", "norm_alias"), ["type", "norm_alias"], "left_anti")
    created_aliases = own.groupBy("type", "norm_alias").agg(F.min(F.struct("entity_id", "alias")).alias("x")).select("x.entity_id", "type", "x.alias", "norm_alias")

    r = relations.withColumns({"s": normalise_name("subject"), "o": normalise_name("object")})
    about = r.where((F.col("subject") == NOTE) & (F.col("relation") == "about")).select("source_id", F.col("o").alias("norm"), F.lit(True).alias("about")).distinct()
    said = m.join(placed.drop("name"), ["type", "norm"]).join(about, ["source_id", "norm"], "left")
    strength = F.when(F.col("match").isin("exact", "alias"), 3).when(F.col("match") == "similar", 1).otherwise(0)
    order = F.struct("type", "norm")
    per_note = said.where("status <> 'rejected'").groupBy("source_id", "id").agg(
        F.max("confidence").alias("confidence"), F.max_by("match", F.struct(strength, F.col("match"))).alias("match"), F.first("status").alias("entity_status"),
        F.min_by("evidence", F.when(F.col("evidence").isNotNull(), order)).alias("evidence"), F.coalesce(F.bool_or("about"), F.lit(False)).alias("about"),
    )
    mention_edges = per_note.select(
        F.lit("source").alias("src_type"), F.col("source_id").alias("src_id"), F.when(F.col("about"), "about").otherwise("mentions").alias("relation"), F.col("id").alias("dst_id"), "confidence",
        initial_status(F.col("match"), F.col("entity_status"), F.col("confidence"), threshold).alias("status"), "evidence", (F.col("entity_status") == "accepted").alias("__kept"),
    )

    # candidates of a relation's name within its note: entity names first, else aliases; a null id is a rejected entity's
    names = said.select("source_id", F.col("norm").alias("key"), "type", F.when(F.col("status") != "rejected", F.col("id")).alias("id"), F.col("status").alias("state"), F.lit(0).alias("level"))
    alias_names = said.select("source_id", F.explode("aliases").alias("key"), "type", F.when(F.col("status") != "rejected", F.col("id")).alias("id"), F.col("status").alias("state"), F.lit(1).alias("level")).withColumn("key", normalise_name("key"))
    offered = names.unionByName(alias_names).groupBy("source_id", "key", "level", "type").agg(F.min(F.struct("id", "state")).alias("e"))
    offered = offered.groupBy("source_id", "key", "level").agg(F.collect_list(F.struct("type", "e.id", "e.state")).alias("es"))
    offered = offered.groupBy("source_id", "key").agg(F.min_by("es", "level").alias("found"))
    r = r.join(offered.select("source_id", F.col("key").alias("s"), F.col("found").alias("sf")), ["source_id", "s"], "left").join(offered.select("source_id", F.col("key").alias("o"), F.col("found").alias("of")), ["source_id", "o"], "left")

    def wanted(side: int, other: str) -> Column:
        out = F.when(F.col("relation") == "part_of", F.transform(other, lambda e: e["type"]))
        for name, pair in ENDPOINTS.items():
            out = out.when(F.col("relation") == name, F.array(*map(F.lit, pair[side])))
        return F.coalesce(out, F.array().cast("array<string>"))

    def picked(found: str, types: Column) -> Column:
        """The one entity, else the one whose type fits, as an array of one; null where none or several are left."""
        one = lambda es: F.array_distinct(F.transform(es, lambda e: F.struct(e["id"].alias("id"), e["state"].alias("state"))))
        every, fits = one(F.col(found)), one(F.filter(found, lambda e: F.array_contains(types, e["type"])))
        return F.when(F.size(every) == 1, every[0]).when(F.size(fits) == 1, fits[0])

    r = r.withColumns({"src": picked("sf", wanted(0, "of")), "dst": picked("of", wanted(1, "sf"))}).where((F.col("subject") != NOTE) & (F.col("src.id") != F.col("dst.id")))
    links = r.groupBy("source_id", F.col("src.id").alias("src_id"), "relation", F.col("dst.id").alias("dst_id")).agg(
        F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"), ((F.first("src.state") == "accepted") & (F.first("dst.state") == "accepted")).alias("__kept")
    )
    link_edges = links.groupBy("src_id", "relation", "dst_id").agg(F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"), F.first("__kept").alias("__kept"))
    link_edges = link_edges.select(F.lit("entity").alias("src_type"), "src_id", "relation", "dst_id", "confidence", F.lit("proposed").alias("status"), "evidence", "__kept")
    edges = mention_edges.unionByName(link_edges)
    if prior is not None:
        before = prior.select("src_type", "src_id", "relation", "dst_id", F.lit(True).alias("__before")).distinct()
        edges = edges.join(before, ["src_type", "src_id", "relation", "dst_id"], "left").withColumn("status", F.when(F.col("__before") & F.col("__kept"), "accepted").otherwise(F.col("status"))).drop("__before")
    return Resolved(
        created, created_aliases, edges.drop("__kept"), placed.where("match = 'similar' AND status <> 'rejected'").select(F.col("id").alias("entity_id"), F.col("name").alias("alias")),
        link_edges.where("relation = 'part_of'").select(F.col("src_id").alias("child"), F.col("dst_id").alias("parent")), said.where("status = 'rejected'").select("source_id", "norm").distinct(),
    )


def replace_machine_edges(edges: DataFrame, source_revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, machine edges that go); source_revisions: source_id, revision_id of the notes that are extracted anew."""
    notes = source_revisions.select(F.col("source_id").alias("src_id"), F.lit("source").alias("src_type"), F.lit(True).alias("__note")).distinct()
    states = source_revisions.select("revision_id", F.lit(True).alias("__state")).distinct()
    marked = edges.join(notes, ["src_id", "src_type"], "left").join(states, "revision_id", "left")
    goes = (F.col("decided_by") == "auto") & F.startswith(F.col("origin"), F.lit("llm:")) & (F.coalesce("__note", F.lit(False)) | ((F.col("src_type") == "entity") & F.coalesce("__state", F.lit(False))))
    goes = F.coalesce(goes, F.lit(False))
    return marked.where(~goes).select(*edges.columns), marked.where(goes).select(*edges.columns)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones by src_type, src_id, relation, dst_id; a user's decision keeps its status and decided_by."""
    key = ["src_type", "src_id", "relation", "dst_id"]
    fresh = new.select(*key, F.col("confidence").alias("__confidence"), F.col("status").alias("__status"), F.lit(True).alias("__new"))
    both = edges.join(fresh, key, "full_outer")
    user = F.col("decided_by").eqNullSafe("user")
    changed = {"confidence": F.coalesce("__confidence", "confidence"), "status": F.when(F.col("__new") & ~user, F.col("__status")).otherwise(F.col("status")), "decided_by": F.coalesce("decided_by", F.lit("auto"))}
    if "id" in edges.columns:
        changed["id"] = F.coalesce("id", F.xxhash64(*key))
    return both.withColumns(changed).select(*edges.columns)


def propose_parents(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities with proposed parents where they have none, not themselves, nor a child of their own; pairs: child, parent.

    Of several proposals the smallest parent counts.
    """
    known = entities.select(F.col("id").alias("parent"), F.col("parent_id").alias("__above"))
    good = pairs.where("child <> parent").join(known, "parent").where(~F.col("__above").eqNullSafe(F.col("child"))).groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("__parent"))
    out = entities.join(good, "id", "left")
    takes = F.col("parent_id").isNull() & F.col("__parent").isNotNull()
    return out.withColumns({"parent_status": F.when(takes, "proposed").otherwise(F.col("parent_status")), "parent_id": F.when(takes, F.col("__parent")).otherwise(F.col("parent_id"))}).select(*entities.columns)


def suggest_aliases(entities: DataFrame, suggested: DataFrame, most: int = MAX_SUGGESTED) -> DataFrame:
    """Entities with more suggested aliases, equal names once, ten at most; entities: id, suggested; suggested: entity_id, alias."""
    old = entities.select("id", F.posexplode("suggested").alias("place", "alias")).withColumn("age", F.lit(0))
    new = suggested.select(F.col("entity_id").alias("id"), F.lit(0).alias("place"), "alias", F.lit(1).alias("age"))
    rows = old.unionByName(new).withColumn("norm", normalise_name("alias")).where("age = 0 OR norm <> ''")
    kept = rows.groupBy("id", "norm").agg(F.min(F.struct("age", "place", "alias")).alias("x"))
    lists = kept.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["alias"]), 1, most).alias("__all"))
    return entities.join(lists, "id", "left").withColumn("suggested", F.coalesce("__all", "suggested")).select(*entities.columns)
