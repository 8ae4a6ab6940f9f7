"""Knowledge graph: parents and cycles, windows of chunks for extraction, and the filter of extracted output."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.versions import shared_folder

WINDOW_CHARS = 6000
MAX_ENTITIES, MAX_RELATIONS, MAX_ALIASES, MAX_NAME, MAX_SUMMARY = 30, 50, 5, 200, 200

# Entity types, relations and the subject that stands for the note itself.
TYPES = ["project", "person", "organization", "tool", "device", "topic"]
RELATIONS = ["mentions", "about", "uses", "runs_on", "works_with", "part_of"]
NOTE = "NOTE"

OUTPUT = (
    "struct<summary:string,entities:array<struct<name:string,type:string,aliases:array<string>,confidence:double>>,"
    "relations:array<struct<subject:string,relation:string,object:string,chunk:string,confidence:double>>>"
)


def written(df: DataFrame) -> DataFrame:
    """The rows in the shared folder, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def chains(links: DataFrame, depth: int | None = None) -> DataFrame:
    """id and all its ancestors, nearest first, or depth of them; links: id, parent (one row per id).

    Each round, written to the shared folder, appends to every chain that of its last node, so the rounds grow with the
    logarithm of the longest chain. A chain ends at the top, or where it would enter a node again.
    """
    walk, before, reach = written(links.select("id", F.array("parent").alias("chain"))), None, 1
    while depth is None or reach < depth:
        above = walk.select(F.col("id").alias("__at"), F.filter("chain", lambda x: x.isNotNull()).alias("__more"))
        on = walk.join(above, F.element_at("chain", -1) == F.col("__at"), "left")
        again = F.array_position(F.transform("__more", lambda x: F.coalesce(F.array_contains("chain", x), F.lit(False))), True)
        fresh = F.when(again > 0, F.slice("__more", F.lit(1), again.cast("int") - 1)).otherwise(F.col("__more"))
        walk = written(on.select("id", F.when(F.size(fresh) > 0, F.concat("chain", fresh)).otherwise(F.col("chain")).alias("chain")))
        now, reach = walk.agg(F.sum(F.size("chain"))).first()[0], 2 * reach
        if now == before:
            break
        before = now
    return walk if depth is None else walk.select("id", F.slice("chain", 1, depth).alias("chain"))


def ancestors(links: DataFrame, depth: int | None = None) -> DataFrame:
    """id, ancestor and distance (1: the parent)."""
    return chains(links, depth).select("id", F.posexplode("chain").alias("at", "ancestor")).select("id", "ancestor", (F.col("at") + 1).alias("distance"))


def jumps(links: DataFrame) -> list[DataFrame]:
    """Level k: id, up and least of nodes with 2^k ancestors: the 2^k-th and the smallest of the 2^k nodes before it.

    links: id, parent (one row per id). Each level joins narrow rows of the one before. They end where no chain is long
    enough; what is left at the length of all links leads into cycles.
    """
    now = written(links.where("parent IS NOT NULL").select("id", F.col("parent").alias("up"), F.col("id").alias("least")))
    n, out = now.count(), []
    while now.count() > 0:
        out.append(now)
        if 1 << (len(out) - 1) >= n:
            break
        above = now.select(F.col("id").alias("__at"), F.col("up").alias("__up"), F.col("least").alias("__least"))
        now = written(now.join(above, F.col("up") == F.col("__at")).select("id", F.col("__up").alias("up"), F.least("least", "__least").alias("least")))
    return out


def climbed(rows: DataFrame, levels: list[DataFrame], left: str | None = None) -> DataFrame:
    """rows (at, ...) with `at` raised by as many links as the column `left` says, or to its top, and `steps`, their number."""
    rows = rows.withColumn("steps", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].select(F.col("id").alias("at"), F.col("up").alias("__up"))
        rows = rows.join(step, "at", "left")
        goes = F.col("__up").isNotNull() if left is None else F.col("__up").isNotNull() & (F.col(left) - F.col("steps") >= F.lit(1 << k))
        rows = written(rows.withColumns({"at": F.when(goes, F.col("__up")).otherwise(F.col("at")), "steps": F.col("steps") + F.when(goes, 1 << k).otherwise(0)}).drop("__up"))
    return rows


def would_cycle(links: DataFrame, proposed: DataFrame, depth: int | None = None) -> DataFrame:
    """child, parent and cycle: whether the parent is the child or below it, by depth links at most; proposed: child, parent.

    A node is above another if it is met where the other is raised by the difference of their depths: joins of narrow
    rows, as many as the logarithm of the longest chain, for the nodes asked about only. A cycle in the links is cut at
    its smallest node; what leads into it also meets all of the cycle.
    """
    levels, n = jumps(links), links.count()
    cuts = None
    if levels and 1 << (len(levels) - 1) >= n:
        in_cycles = levels[-1].join(levels[-1].select(F.col("up").alias("id")).distinct(), "id", "left_semi")
        cuts = written(in_cycles.where("id = least").select("id").join(links, "id").select(F.col("id").alias("top"), F.col("parent").alias("entry")))
        if cuts.isEmpty():
            cuts = None
        else:
            levels = jumps(links.join(cuts.select(F.col("top").alias("id")), "id", "left_anti"))
    asked = written(proposed.select("child", "parent").distinct())
    nodes = asked.select(F.col("child").alias("node")).union(asked.select("parent")) if cuts is None else asked.select(F.col("child").alias("node")).union(asked.select("parent")).union(cuts.select("entry"))
    tops = climbed(nodes.where("node IS NOT NULL").distinct().select("node", F.col("node").alias("at")), levels).select("node", F.col("at").alias("top"), F.col("steps").alias("deep"))
    of = lambda name: tops.select(*[F.col(c).alias(c if c == name else f"{name}_{c}") for c in ("top", "deep")], F.col("node").alias(name))
    child, parent = of("child"), of("parent")
    pairs = asked.join(child, "child").join(parent, "parent").where("child_top = parent_top")
    ways = pairs.select("child", "parent", F.col("parent").alias("at"), (F.col("parent_deep") - F.col("child_deep")).alias("far"), F.lit(0).cast("long").alias("before"))
    if cuts is not None:
        entry = cuts.join(of("entry"), "entry").select(F.col("top").alias("parent_top"), "entry", "entry_deep")
        round_ = pairs.join(entry, "parent_top").select("child", "parent", F.col("entry").alias("at"), (F.col("entry_deep") - F.col("child_deep")).alias("far"), (F.col("parent_deep") + 1).alias("before"))
        ways = ways.unionByName(round_)
    found = climbed(ways.where("far >= 0"), levels, "far").where(F.col("at") == F.col("child"))
    found = found.where((F.col("far") + F.col("before") > 0) & (F.lit(depth is None) | (F.col("far") + F.col("before") <= F.lit(depth or 0)))).select("child", "parent", F.lit(True).alias("__meets")).distinct()
    joined = proposed.join(found, ["child", "parent"], "left")
    return joined.select("child", "parent", ((F.col("child") == F.col("parent")) | F.coalesce("__meets", F.lit(False))).alias("cycle"))


def pack_windows(chunks: DataFrame, max_chars: int = WINDOW_CHARS) -> DataFrame:
    """doc_id, chunk_id, window, label, start and size: a document's chunks in order in windows of max_chars characters.

    A part of a window is a line with its label (and its heading, a quarter of the window at most), the text and a blank
    line. A chunk that doesn't fit into what is left opens a window; a longer one than a window is cut into several.
    Labels start anew at c1. Only sizes are collected, per document.
    """
    heading = F.substring(F.coalesce("heading", F.lit("")), 1, max_chars // 4) if "heading" in chunks.columns else F.lit("")
    extra = F.when(F.char_length(heading) > 0, F.char_length(heading) + 1).otherwise(0)
    sizes = chunks.select("doc_id", F.struct("chunk_id", F.char_length("content").alias("size"), extra.alias("extra")).alias("c"))
    none = F.array().cast("array<struct<chunk_id:bigint,window:int,n:int,start:int,size:int>>")
    begin = F.struct(F.lit(0).alias("window"), F.lit(0).alias("used"), F.lit(0).alias("n"), none.alias("out"))

    def step(state: Column, c: Column) -> Column:
        head = lambda n: F.char_length(n.cast("string")) + 4 + c["extra"]  # noqa: E731 "[c", the number, "]", what follows it, a line end
        opens = (state["used"] > 0) & (state["used"] + head(state["n"] + 1) + c["size"] + 2 > max_chars)
        window, n, used = F.when(opens, state["window"] + 1).otherwise(state["window"]), F.when(opens, 1).otherwise(state["n"] + 1), F.when(opens, 0).otherwise(state["used"])
        room = F.greatest(F.lit(max_chars) - used - head(n) - 2, F.lit(1))
        full = F.greatest(F.lit(max_chars) - head(F.lit(1)) - 2, F.lit(1))
        more = F.when(c["size"] > room, F.ceil((c["size"] - room) / full)).otherwise(0).cast("int")
        start = lambda k: F.when(k == 0, 0).otherwise(room + (k - 1) * full).cast("int")
        part = lambda k: F.struct(
            c["chunk_id"].alias("chunk_id"), (window + k).cast("int").alias("window"), F.when(k == 0, n).otherwise(1).alias("n"), start(k).alias("start"),
            F.least(c["size"] - start(k), F.when(k == 0, room).otherwise(full)).cast("int").alias("size"),
        )
        last = F.when(more == 0, used + head(n) + c["size"] + 2).otherwise(head(F.lit(1)) + c["size"] - start(more) + 2)
        return F.struct(
            (window + more).cast("int").alias("window"), last.cast("int").alias("used"), F.when(more == 0, n).otherwise(1).alias("n"), F.concat(state["out"], F.transform(F.sequence(F.lit(0), more), part)).alias("out")
        )

    packed = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("cs")).select("doc_id", F.explode(F.aggregate("cs", begin, step, lambda s: s["out"])).alias("w"))
    return packed.select("doc_id", "w.chunk_id", "w.window", F.concat(F.lit("c"), F.col("w.n")).alias("label"), "w.start", "w.size")


def window_texts(chunks: DataFrame, max_chars: int = WINDOW_CHARS) -> DataFrame:
    """doc_id, window and text of each window; chunks: doc_id, chunk_id, content and perhaps heading."""
    own = chunks.withColumn("heading", F.substring(F.coalesce("heading", F.lit("")), 1, max_chars // 4)) if "heading" in chunks.columns else chunks.withColumn("heading", F.lit(""))
    parts = pack_windows(chunks, max_chars).join(own.select("doc_id", "chunk_id", "heading", "content"), ["doc_id", "chunk_id"])
    head = F.concat(F.lit("["), F.col("label"), F.lit("]"), F.when(F.col("heading") != "", F.concat(F.lit(" "), F.col("heading"))).otherwise(""), F.lit("\n"))
    part = F.struct("chunk_id", "start", F.concat(head, F.substring(F.col("content"), F.col("start") + 1, F.col("size"))).alias("text"))
    return parts.groupBy("doc_id", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n").alias("text"))


def shown(name: Column, most: int = MAX_NAME) -> Column:
    """A text with single blanks, none around it, and of bounded length."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", " "), "^ | $", ""), 1, most)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def normalised(lists: pd.Series) -> pd.Series:
    """normalise_name of each text in lists of lists; null texts are empty."""
    one = lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold() if isinstance(t, str) else ""
    return lists.map(lambda rows: None if rows is None else [[one(t) for t in (r if r is not None else ())] for r in rows])


def first_of_equals(items: Column, key) -> Column:
    """The first item of each key, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def clamp(value: Column) -> Column:
    number = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))


def filter_output(raw: DataFrame, column: str = "output") -> DataFrame:
    """Adds summary, entities and relations that hold to the schema; what doesn't is dropped, never repaired.

    Names compare by NFKC, single blanks and case folding, over all types. Null or malformed JSON gives null for all.
    """
    none = F.array().cast("array<string>")
    parsed = raw.withColumn("__o", F.from_json(column, OUTPUT))
    parsed = parsed.withColumn("__o", F.when(F.col("__o.entities").isNotNull() | F.col("__o.relations").isNotNull() | F.col("__o.summary").isNotNull(), F.col("__o")))
    texts = F.transform("__o.entities", lambda e: F.concat(F.array(shown(e["name"])), F.transform(F.coalesce(e["aliases"], none), lambda a: shown(a))))
    ends = F.transform("__o.relations", lambda r: F.array(shown(r["subject"]), shown(r["object"])))
    keyed = parsed.select("*", texts.alias("__texts"), ends.alias("__ends")).select("*", normalised("__texts").alias("__names"), normalised("__ends").alias("__pairs"))

    def entity(e: Column, i: Column) -> Column:
        text, key = F.get("__texts", i), F.get("__names", i)
        others = F.transform(F.sequence(F.lit(1), F.size(key)), lambda k: F.struct(F.get(text, k).alias("text"), F.get(key, k).alias("key")))
        others = F.filter(others, lambda a: a["text"].isNotNull() & (a["key"] != "") & (a["key"] != key[0]))
        aliases = F.transform(F.slice(first_of_equals(others, lambda a: a["key"]), 1, MAX_ALIASES), lambda a: a["text"])
        return F.struct(text[0].alias("name"), e["type"].alias("type"), aliases.alias("aliases"), clamp(e["confidence"]).alias("confidence"), key[0].alias("key"))

    every = F.transform("__o.entities", entity)
    good = F.filter(every, lambda e: e["type"].isin(TYPES) & (F.coalesce(e["key"], F.lit("")) != "") & (e["key"] != "note"))
    kept = keyed.withColumn("__kept", F.slice(first_of_equals(good, lambda e: e["key"]), 1, MAX_ENTITIES))
    names = F.transform("__kept", lambda e: e["key"])

    def relation(r: Column, i: Column) -> Column:
        text, key = F.get("__ends", i), F.get("__pairs", i)
        label = F.when(r["chunk"].rlike(r"^c[0-9]{1,4}$"), r["chunk"])
        return F.struct(text[0].alias("subject"), r["relation"].alias("relation"), text[1].alias("object"), label.alias("chunk"), clamp(r["confidence"]).alias("confidence"), key[0].alias("s"), key[1].alias("o"))

    known = F.filter(F.transform("__o.relations", relation), lambda r: (
        r["relation"].isin(RELATIONS) & ((r["subject"] == NOTE) | F.array_contains(names, r["s"])) & F.array_contains(names, r["o"]) & (r["s"] != r["o"])
    ))
    unseen = F.slice(first_of_equals(known, lambda r: F.concat_ws("\n", r["s"], r["relation"], r["o"])), 1, MAX_RELATIONS)
    fields = lambda c, *names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    return kept.withColumns({
        "summary": F.when(F.col("__o").isNotNull(), shown(F.coalesce(F.col("__o.summary"), F.lit("")), MAX_SUMMARY)), "relations": fields(unseen, "subject", "relation", "object", "chunk", "confidence"),
        "entities": fields(F.col("__kept"), "name", "type", "aliases", "confidence"),
    }).drop("__o", "__texts", "__ends", "__names", "__pairs", "__kept")
