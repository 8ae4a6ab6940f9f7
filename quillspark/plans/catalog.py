"""All registered queries and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.markdown import chunk_note, parse_note
from quillspark.operators import chat, evaluation, graph, ingest, nightly, paging, resolution, review, search
from quillspark.operators.embedding import EmbeddingStore
from quillspark.operators.text_index import TextIndex
from quillspark.operators.vector_index import VectorIndex
from quillspark.plans.corpus import SOURCES_SQL, TABLES, chunks, sources, table
from quillspark.plans import model
from quillspark.plans.catalog_model import QUERIES as MODEL_QUERIES
from quillspark.plans.catalog_model import SQL as MODEL_QUERY_SQL
from quillspark.plans.shared import SHARED
from quillspark.sources.versions import temporary
from quillspark.streaming.ingest import ingest_notes

Query = Callable[[SparkSession, str], DataFrame]


def shared(sql: str) -> Query:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return lambda spark, sf: spark.sql(sql, **{t: table(spark, sf, t) for t in used})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING)", "AS VARCHAR)")


def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    bench = table(spark, sf, "benchmark")
    return bench.select(F.col("item_id").alias("query_id"), F.explode(X.chat_terms(F.col("text"))).alias("term"))


def text_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.matches(search.postings(chunks(spark, sf)), query_terms(spark, sf))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


def benchmark_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return table(spark, sf, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def vector_hits(spark: SparkSession, sf: str, queries: DataFrame) -> DataFrame:
    """Top 200 of all vectors, then the live documents among them, then 50; a document's vector stands for its first line."""
    near = search.knn(table(spark, sf, "embeddings"), queries)
    kept = near.drop("rank").join(sources(spark, sf).where(~F.col("deleted")).select(F.col("doc_id").alias("vec_id")), "vec_id")
    listed = search.top(kept, [F.desc("similarity"), F.col("vec_id")], search.LIST)
    return listed.select("query_id", F.col("vec_id").alias("doc_id"), (F.col("vec_id") * 1000000).alias("chunk_id"), "rank", "similarity")


def hybrid(spark: SparkSession, sf: str, chat: bool) -> DataFrame:
    found = text_hits(spark, sf)
    listed = search.chat_list(found) if chat else search.text_list(found)
    fused = search.fuse(listed, vector_hits(spark, sf, benchmark_vectors(spark, sf)))
    return search.best_per_note(fused, 2 if chat else 1, 20).select("query_id", "doc_id", "chunk_id", "score", "by_text", "by_vector", "similarity", "rank")


def web_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text as a web search: all its words have to be there."""
    live = chunks(spark, sf)
    return search.web_matches(search.postings(live), live, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def websearch_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_list(web_hits(spark, sf), by="score").select("query_id", "chunk_id", "hits", "score", "rank")


def websearch_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    fused = search.fuse(search.text_list(web_hits(spark, sf), by="score"), vector_hits(spark, sf, benchmark_vectors(spark, sf)))
    return search.best_per_note(fused, 1, 20).select("query_id", "doc_id", "chunk_id", "score", "by_text", "by_vector", "similarity", "rank")


def rrf_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf, chat=False)


def rrf_hybrid_chat(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf, chat=True)


def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    ranked = search.chat_list(text_hits(spark, sf)).where("rank <= 16")
    sizes = chunks(spark, sf).select("chunk_id", F.char_length("content").cast("long").alias("size"))
    return search.evidence(ranked.join(sizes, "chunk_id").select("query_id", "rank", "doc_id", "size"), budget=600)


def folder_facets(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(2)))
    rows = sources(spark, sf).where("NOT deleted AND instr(path, '/') > 0").select(F.explode(F.transform(levels, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def tag_facets(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources(spark, sf).where("NOT deleted").select(F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(200)


def tag_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("#"), F.upper("lang"), F.lit(", "), F.col("source"), F.lit("  ##"), F.col("lang"), F.lit(",,X"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.normalise_tags(raw), "|").alias("tags"))


def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(chunks(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def fts(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = text_hits(spark, sf)
        wanted = query_terms(spark, sf).groupBy("query_id").agg(F.countDistinct("term").alias("all_terms"))
        if kind == "or":
            return search.text_list(found).select("query_id", "chunk_id", "hits", "rank")
        if kind == "and":
            return search.text_list(found.join(wanted, "query_id").where("n_terms * 2 >= all_terms")).select("query_id", "chunk_id", "hits", "rank")
        first = found.groupBy("query_id").agg(F.max("hits").alias("most"))
        return found.join(first, "query_id").where("hits < most").groupBy("query_id").agg(F.count(F.lit(1)).alias("left"))

    return run


def tokenise_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Words and places of every line of the first of equal texts."""
    one = search.postings(chunks(spark, sf))
    return one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"), F.max("pos").alias("last"))


def chat_pool_top200(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(text_hits(spark, sf), [F.desc("hits"), F.col("chunk_id")], search.POOL, "place").select("query_id", "chunk_id", "hits", "place")


def headline(spark: SparkSession, sf: str) -> DataFrame:
    """Marked stretches of the best three chunks of each question."""
    terms = query_terms(spark, sf).groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    best = search.text_list(text_hits(spark, sf), 3).join(chunks(spark, sf).select("chunk_id", "content"), "chunk_id").join(terms, "query_id")
    return best.select("query_id", "chunk_id", "rank", search.headline("content", "terms").alias("headline"))


def chat_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered sources of each benchmark text as a question."""
    contents = chunks(spark, sf).join(sources(spark, sf).select("doc_id", "path"), "doc_id").select("chunk_id", "path", F.lit("").alias("heading"), "content")
    return chat.retrieve(rrf_hybrid_chat(spark, sf), contents, limit=5, budget=900).select("query_id", "n", "doc_id", "score", "mode", "link")


def capture_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.capture_title(F.concat(F.lit(" \n## "), "text")).alias("title"))


def chat_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(X.chat_terms(F.col("text"))), " ").alias("terms"))


def chat_match_rule(spark: SparkSession, sf: str) -> DataFrame:
    return search.chat_list(text_hits(spark, sf)).select("query_id", "chunk_id", "hits", "n_terms", "rank")


def knn_top200(spark: SparkSession, sf: str) -> DataFrame:
    return search.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf))


def knn_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    return vector_hits(spark, sf, vector_queries(spark, sf)).select("query_id", "doc_id", "rank", "similarity")


def nearest_same_type(spark: SparkSession, sf: str) -> DataFrame:
    queries = vector_queries(spark, sf).withColumnRenamed("query_label", "label")
    near = search.knn(table(spark, sf, "embeddings"), queries, 2, by="label").where("vec_id <> query_id AND similarity >= 0.2")
    return search.top(near.drop("rank"), [F.desc("similarity"), F.col("vec_id")], 1).drop("rank")


def indexed(spark: SparkSession, sf: str, k: int | None, run: Callable[[VectorIndex], DataFrame]) -> DataFrame:
    """An index of all vectors, nine tenths at first, then the others and some of the first once more; what run reads of it."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    late = F.col("vec_id") % 10 == 3
    with temporary(spark) as tables:
        index = VectorIndex(tables)
        index.build(rows.where(~late))
        index.put(rows.where(late | (F.col("vec_id") % 50 == 7)))
        if k:
            index.tune(k)
        return graph.written(run(index))


def knn_index_top200(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL of exact search, so a second search reads every cell that may hold a nearer vector."""
    return indexed(spark, sf, None, lambda index: index.search(vector_queries(spark, sf), reach=2, exact=True))


def knn_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the ten nearest vectors of each query the index finds."""
    exact = search.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf), 10).select("query_id", "vec_id")
    found = lambda index: exact.join(index.search(vector_queries(spark, sf), 10).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return indexed(spark, sf, 10, lambda index: found(index).groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted")))


def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as entities of the type of their label; each tenth one is a name that asks for the nearest other entity."""
    rows = table(spark, sf, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"), F.lit("accepted").alias("status"))
    names = rows.where("id % 10 = 0").select("type", F.col("id").cast("string").alias("norm"), F.col("embedding").alias("vector"))
    rest = rows.where("id % 10 <> 0")
    return resolution.similar(names, rest.select("id", "embedding"), rest.select("id", "type", "status"), 0.3)


def edited(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks after an edit: each tenth document ends with a word more, those after them have gone."""
    rows = chunks(spark, sf).where("doc_id % 10 <> 4")
    return rows.withColumn("content", F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))


def edited_index(spark: SparkSession, sf: str, run: Callable[[TextIndex], DataFrame]) -> DataFrame:
    """A text index of all chunks, then of the edit as a batch of its own."""
    with temporary(spark) as tables:
        index = TextIndex(tables, parts=16)
        index.update(chunks(spark, sf))
        index.update(edited(spark, sf).where("doc_id % 10 = 3"), gone=table(spark, sf, "documents").where("doc_id % 10 = 4").select("doc_id"))
        return graph.written(run(index))


def text_index_search(spark: SparkSession, sf: str) -> DataFrame:
    terms = query_terms(spark, sf)
    return edited_index(spark, sf, lambda index: search.text_list(search.matches(index.rows(terms), terms))).select("query_id", "chunk_id", "hits", "rank")


def text_index_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return edited_index(spark, sf, lambda index: index.frequencies())


def emptied_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the documents as notes, of which some are then edited, emptied, unreadable or gone."""
    notes = table(spark, sf, "documents").select(
        F.format_string("%08d.md", "doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime"),
        F.lit(None).cast("string").alias("read_error"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 10).alias("kind"),
    )
    later = notes.where("kind BETWEEN 1 AND 3").withColumn("text", F.when(F.col("kind") == 1, F.lit("  ")).when(F.col("kind") == 2, F.lit(None)).otherwise(F.lit("edited")))
    later = later.withColumns({"hash": F.sha2(F.col("kind").cast("string").cast("binary"), 256), "read_error": F.when(F.col("kind") == 2, "encoding"), "mtime": F.lit(2).cast("long")})
    with temporary(spark) as tables:
        ingest_notes(tables, notes.where("text <> ''").drop("kind"))
        ingest_notes(tables, later.drop("kind"), gone=notes.where("kind = 4").select("path"))
        return graph.written(tables.read("chunks").groupBy("path").agg(F.first("hash").alias("hash"), F.min("ordinal").alias("first")))


def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


def deep_link(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).select("doc_id", X.deep_link(F.lit("My vault"), F.col("path")).alias("link"))


def heading_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.heading_text(F.col("source"), F.array("source", "lang")).alias("same"), X.heading_text(F.col("lang"), F.array("source")).alias("other"))


def content_hash_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def embed_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    text = X.embed_text(F.col("source"), F.array("lang"), F.col("text"))
    return table(spark, sf, "documents").select(F.sha2(text.cast("binary"), 256).alias("key")).distinct()


def sizes_of(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding model: characters and bytes of a text."""
    return [[float(len(t)), float(len(t.encode()))] for t in texts]


def embedding_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all documents in a store of vectors, filled by a run over the even ids, then over all."""
    texts = table(spark, sf, "documents").select("doc_id", X.embed_text(F.col("source"), F.array("lang"), F.col("text")).alias("text"))
    with temporary(spark) as tables:
        store = EmbeddingStore(tables, "sizes", dims=2, parts=16)
        for part in (texts.where("doc_id % 2 = 0"), texts):
            store.fill(part, sizes_of)
        found = store.vectors(texts).where("text IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("embedding").alias("v"))
        return graph.written(found.select("key", "n", F.col("v")[0].cast("long").alias("chars"), F.col("v")[1].cast("long").alias("bytes")))


def reconcile_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents stand for what was known, with another size where their quality is 0; the rest is on disk."""
    docs = table(spark, sf, "documents")
    known = table(spark, sf, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 0, 0).otherwise(F.col("n_chars")).alias("size"), F.lit(1).alias("mtime"))
    gone = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    seen = docs.join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    return ingest.reconcile(known, seen)


def observation_classify(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id", F.when(F.col("n_chars") > 4000, "too_large").alias("read_error"), F.when(F.col("quality") == 0, "failed").when(F.col("quality") == 1, "indexed").alias("known_state"),
        (F.col("lang") == "en").alias("is_current"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("was_deleted"),
    )
    return ingest.classify(rows).select("doc_id", "outcome", "queued")


def move_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with odd ids have vanished, the others are new."""
    rows = sources(spark, sf).select("doc_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return ingest.pair_moves(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"))


def parse_notes(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).select("doc_id", parse_note("text", "path").alias("note")).select("doc_id", "note.title", "note.front_error", F.size("note.links").alias("n_links"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(chunk_note("text")).alias("c")).select("doc_id", "c.ordinal", F.char_length("c.content").alias("size"))


def eval_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Text search ranks of each benchmark item; the target is the first document, by id, of those that share a word with it and were listed."""
    bench = table(spark, sf, "benchmark")
    # at most fifty rows a query, written once for all that is made of them
    listed = graph.written(search.text_list(text_hits(spark, sf)).select("query_id", F.col("rank").alias("position"), F.col("doc_id").alias("path")))
    targets = listed.groupBy("query_id").agg(F.min("path").alias("path"))
    return evaluation.first_rank(listed, targets).join(bench.select(F.col("item_id").alias("query_id"), (F.char_length("text") % 2).alias("kind")), "query_id")


def first_only(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.select("query_id", F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))


def eval_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """What the first ten and the first five ranks find more than the first two."""
    ranks = eval_ranks(spark, sf)
    systems = [first_only(ranks, k).withColumn("system", F.lit(f"first {k}")) for k in (5, 10)]
    return evaluation.bootstrap(systems[0].unionByName(systems[1]), first_only(ranks, 2))


def eval_bootstrap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same by Poisson counts."""
    ranks = eval_ranks(spark, sf)
    systems = [first_only(ranks, k).withColumn("system", F.lit(f"first {k}")) for k in (5, 10)]
    return evaluation.bootstrap_counts(systems[0].unionByName(systems[1]), first_only(ranks, 2))


def eval_flips(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten ranks against the first three."""
    ranks = eval_ranks(spark, sf)
    return evaluation.flips(ranks, first_only(ranks, 3))


def eval_bake_off(spark: SparkSession, sf: str) -> DataFrame:
    """Text, chat and vector lists of the benchmark as systems; a note's target is the first of all that any of them lists."""
    # both lists are made of the best two hundred, and all are written once
    found = graph.written(search.top(text_hits(spark, sf), [F.desc("hits"), F.col("chunk_id")], search.POOL, "pool").drop("pool"))
    lists = {"text": search.text_list(found), "chat": search.chat_list(found), "vector": vector_hits(spark, sf, benchmark_vectors(spark, sf))}
    runs = [df.select(F.lit(name).alias("system"), "query_id", F.col("rank").alias("position"), F.col("doc_id").alias("path")) for name, df in lists.items()]
    every = graph.written(runs[0].unionByName(runs[1]).unionByName(runs[2]))
    queries = every.groupBy("query_id").agg(F.array(F.min("path")).alias("targets"))
    latencies = every.groupBy("system", "query_id").agg(F.count(F.lit(1)).cast("double").alias("ms"))
    scores, _ = evaluation.bake_off(queries, every, latencies, "text")
    return scores.select("name", "n", "recall", "mrr", "hit1", "wins", "best")


def eval_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Items of even and odd length stand for two systems; the even ones are the incumbent."""
    systems = evaluation.summary(eval_ranks(spark, sf), "kind").withColumns({"p95": F.lit(100) + F.col("kind"), "name": F.col("kind").cast("string")})
    return evaluation.verdict(systems, F.col("kind") == 0).select("kind", "recall", "mrr", "p95", "wins")


def part_links(spark: SparkSession, sf: str) -> DataFrame:
    """A part's parent has its key without the last digit."""
    return table(spark, sf, "part").where("p_partkey >= 10").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 10").alias("parent"))


def ancestor_chain(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(part_links(spark, sf))


def cycle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every even part gets a part below it as its parent, every odd one its successor."""
    key = F.col("p_partkey")
    proposed = table(spark, sf, "part").select(key.alias("child"), F.when(key % 2 == 0, key * 10 + key % 10).otherwise(key + 1).alias("parent"))
    return graph.would_cycle(part_links(spark, sf), proposed)


def window_packing(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pack_windows(chunks(spark, sf))


def filter_llm_output(spark: SparkSession, sf: str) -> DataFrame:
    """JSON as a model might return it, made of each document's columns: two names that differ in case only, an unknown type, a self-pair."""
    entity = lambda name, kind, sure: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.array("lang", name).alias("aliases"), F.lit(sure).alias("confidence"))
    pair = lambda a, b, chunk: F.struct(a.alias("subject"), F.lit("uses").alias("relation"), b.alias("object"), F.lit(chunk).alias("chunk"), F.lit(0.5).alias("confidence"))
    source, lang = F.col("source"), F.col("lang")
    entities = F.array(entity(source, "tool", 1.5), entity(F.upper(source), "topic", 0.4), entity(lang, "planet", 0.9), entity(F.concat(lang, F.lit(" x")), "topic", 0.7))
    relations = F.array(pair(F.lit("NOTE"), source, "c1"), pair(source, F.upper(source), "c2"), pair(source, F.concat(lang, F.lit(" x")), "chunk 3"), pair(lang, source, "c4"))
    out = graph.filter_output(table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(entities.alias("entities"), relations.alias("relations"))).alias("output")))
    names = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[f] for f in fields))), "|")
    return out.select("doc_id", names("entities", "name", "type", "confidence").alias("entities"), names("relations", "subject", "object", "chunk").alias("relations"))


def suggest_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    pick = F.row_number().over(Window.partitionBy("folder").orderBy(F.md5(F.concat(F.lit("seed:"), "path").cast("binary")), "path"))
    return sources(spark, sf).where("NOT deleted").select("folder", "path", pick.alias("pick")).orderBy("pick", "folder").limit(30)


def schedule_due_local(spark: SparkSession, sf: str) -> DataFrame:
    local = F.from_utc_timestamp("ts", "Europe/Warsaw")
    due = F.hour(local) * 60 + F.minute(local) >= 150
    return table(spark, sf, "events").groupBy(F.to_date(local).alias("day")).agg(F.count_if(due).alias("due"), F.min(F.when(due, F.col("ts"))).alias("first_due"))


# Queries of `shared` whose Spark side is an operator; their SQL stays DuckDB's side.


def live_sources_filter(spark: SparkSession, sf: str) -> DataFrame:
    return search.live(sources(spark, sf), folder="src1", tags=["en"]).select("doc_id", "path")


def substring_ilike(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(paging.contains_text("p_name", "an") | F.endswith(F.lower("p_brand"), F.lit("#12"))).select("p_partkey", "p_name")


def claim_newest_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are pending revisions of their user."""
    state = F.when(F.col("event_type") == "error", "pending").otherwise("ok")
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("source_id"), F.col("event_id").alias("revision_id"), F.col("ts").alias("observed_at"), state.alias("state"))
    return ingest.claim_pending(rows).select("event_id", F.col("source_id").alias("revision_id"), "new_state")


def line_edges(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") == 1, "about").otherwise("mentions").alias("relation"),
        F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"), F.when(flag == "N", "proposed").when(flag == "A", "accepted").otherwise("rejected").alias("status"), F.when(F.col("l_linestatus") == "F", "user").otherwise("auto").alias("decided_by"),
    )


def upsert_user_wins(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("decided_by") != "user", F.desc("confidence"), F.col("src_id"), F.col("n")]
    return ingest.latest(line_edges(spark, sf), ["dst_id", "relation"], order).select("src_id", "dst_id", "relation", "status", "decided_by", "confidence")


def mass_delete_guard(spark: SparkSession, sf: str) -> DataFrame:
    counts = sources(spark, sf).groupBy("folder").agg(F.count(F.lit(1)).alias("live"), F.count_if("deleted").alias("missing"))
    return counts.withColumn("trips", ingest.guard_trips(F.col("missing"), F.col("live")))


def graph_status_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return review.status_matrix(model.entities(spark, sf), model.TYPES, model.STATES)


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("revision_id"), F.col("ts").alias("attempted_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


def day_runs(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_trunc("day", F.col("ts"))
    return table(spark, sf, "events").select(start.alias("started_at")).distinct().withColumn("out_end", F.col("started_at") + F.make_interval(days=F.lit(1)))


def nightly_remaining(spark: SparkSession, sf: str) -> DataFrame:
    runs = day_runs(spark, sf)
    counts = nightly.within(attempts(spark, sf), runs, "attempted_at").groupBy("started_at").agg(F.countDistinct("revision_id").alias("attempted"), F.countDistinct(F.when(F.col("status") == "failed", F.col("revision_id"))).alias("failed"))
    out = runs.select("started_at").join(counts, "started_at", "left").fillna(0, ["attempted", "failed"])
    return out.withColumn("done", F.least(F.col("attempted"), F.lit(100).cast("long")))


def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    runs = day_runs(spark, sf)
    counts = nightly.within(attempts(spark, sf), runs, "attempted_at").groupBy("started_at").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "ok").alias("ok"), F.max("attempted_at").alias("last_at"))
    return runs.select("started_at").join(counts, "started_at", "left").fillna(0, ["attempts", "ok"])


def digest_failed(spark: SparkSession, sf: str) -> DataFrame:
    last = ingest.latest(attempts(spark, sf), ["revision_id"], [F.desc("attempted_at"), F.desc("event_id")]).where("status = 'failed'")
    return last.select("revision_id", "attempted_at").join(F.broadcast(last.agg(F.count(F.lit(1)).alias("total"))))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(evaluation.percentile("value", 0.5), 6).alias("p50"), F.count(F.lit(1)).alias("n"))


def turn_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return chat.numbered(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "seq")


def session_last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return chat.last_turns(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role", "text")


def sessions_list(spark: SparkSession, sf: str) -> DataFrame:
    return chat.sessions(table(spark, sf, "conversations"))


OPERATORS: dict[str, Query] = {
    f.__name__: f
    for f in (
        live_sources_filter, substring_ilike, claim_newest_pending, upsert_user_wins, mass_delete_guard, graph_status_matrix, nightly_remaining, run_progress, digest_failed, latency_percentiles, turn_sequence,
        session_last_turns, sessions_list,
    )
}

CHUNKS_SQL = "c AS (SELECT doc_id, doc_id * 1000000 + i - 1 AS chunk_id, parts[i] AS content FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM s WHERE NOT deleted)))"
POSTINGS_SQL = r"p AS (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS term FROM c)"
IDENT = r"(length({0}) BETWEEN 2 AND 64 AND regexp_matches({0}, '[\p{{N}}._\-]'))"
TERMS_SQL = (
    r"t0 AS (SELECT item_id, i, ts[i] AS t FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-]*[\p{L}\p{N}_])?') AS ts FROM benchmark))),"
    "t1 AS (SELECT item_id, t, min(i) AS i FROM t0 GROUP BY item_id, t),"
    "t2 AS (SELECT item_id AS query_id, t AS term, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN " + IDENT.format("t") + " THEN 0 ELSE 1 END, CASE WHEN " + IDENT.format("t") + " THEN 0 ELSE -length(t) END, i) AS place FROM t1 WHERE " + IDENT.format("t") + " OR length(t) >= 3),"
    "q AS (SELECT query_id, term FROM t2 WHERE place <= 16)"
)
MATCH_SQL = "f AS (SELECT query_id, doc_id, chunk_id, count(*) AS hits, count(DISTINCT p.term) AS n_terms, max(" + IDENT.format("p.term") + ") AS identifier FROM p JOIN q ON p.term = q.term GROUP BY ALL)"
TEXT_SQL = "WITH " + ", ".join([duck(SOURCES_SQL), CHUNKS_SQL, POSTINGS_SQL, TERMS_SQL, MATCH_SQL])
EDITED_SQL = CHUNKS_SQL.replace("c AS", "c0 AS", 1) + ", c AS (SELECT doc_id, chunk_id, CASE WHEN doc_id % 10 = 3 THEN content || ' edited' ELSE content END AS content FROM c0 WHERE doc_id % 10 <> 4)"
EDITED_TEXT_SQL = "WITH " + ", ".join([duck(SOURCES_SQL), EDITED_SQL, POSTINGS_SQL, TERMS_SQL, MATCH_SQL])
LIST_SQL = "x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM {0} QUALIFY rank <= 50)"
CHAT_SQL = "pool AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= 200), ok AS (SELECT * FROM pool WHERE n_terms >= 2 OR identifier), " + LIST_SQL.format("ok")
COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
KNN_SQL = "k AS (SELECT b.vec_id AS query_id, a.vec_id, " + COS + " AS similarity FROM embeddings a JOIN embeddings b ON {0}), kn AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM k QUALIFY rank <= 200)"
VEC_SQL = "v AS (SELECT query_id, vec_id AS doc_id, vec_id * 1000000 AS chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM kn JOIN s ON s.doc_id = kn.vec_id WHERE NOT s.deleted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 50)"
FUSE_SQL = (
    "u AS (SELECT query_id, doc_id, chunk_id, rank, true AS by_text, NULL::DOUBLE AS similarity FROM x UNION ALL SELECT query_id, doc_id, chunk_id, rank, false, similarity FROM v),"
    "g AS (SELECT query_id, doc_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, bool_or(by_text) AS by_text, bool_or(NOT by_text) AS by_vector, max(similarity) AS similarity FROM u GROUP BY ALL),"
    "n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS per_note FROM g QUALIFY per_note <= {0}) "
    "SELECT query_id, doc_id, chunk_id, score, by_text, by_vector, similarity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, per_note) AS rank FROM n QUALIFY rank <= 20"
)
BENCH_KNN = KNN_SQL.format("b.vec_id IN (SELECT item_id FROM benchmark)")

QUERIES: dict[str, Query] = {
    "rrf_hybrid_search": rrf_hybrid_search, "rrf_hybrid_chat": rrf_hybrid_chat, "websearch_match": websearch_match, "websearch_hybrid": websearch_hybrid, "evidence_budget": evidence_budget, "folder_facets": folder_facets, "tag_facets": tag_facets,
    "tag_normalise": tag_normalise, "term_frequency": term_frequency, "fts_or_rank": fts("or"), "fts_and_match": fts("and"), "fts_not_match": fts("not"), "chat_terms": chat_terms,
    "chat_match_rule": chat_match_rule, "knn_top200": knn_top200, "knn_index_top200": knn_index_top200, "knn_index_recall": knn_index_recall, "similar_names": similar_names, "text_index_search": text_index_search, "text_index_frequencies": text_index_frequencies, "emptied_notes": emptied_notes, "knn_post_filter": knn_post_filter, "nearest_same_type": nearest_same_type, "excerpt": excerpt, "deep_link": deep_link,
    "heading_text": heading_text, "content_hash_duplicates": content_hash_duplicates, "embed_cache_keys": embed_cache_keys, "embedding_backfill": embedding_backfill, "reconcile_diff": reconcile_diff,
    "observation_classify": observation_classify, "move_pairing": move_pairing, "parse_notes": parse_notes, "chunk_documents": chunk_documents,
    "eval_first_rank": eval_ranks, "eval_summary": lambda spark, sf: evaluation.summary(eval_ranks(spark, sf)), "eval_split_by": lambda spark, sf: evaluation.summary(eval_ranks(spark, sf), "kind"),
    "eval_flips": eval_flips, "eval_verdict": eval_verdict, "ancestor_chain": ancestor_chain, "cycle_check": cycle_check, "window_packing": window_packing, "filter_llm_output": filter_llm_output,
    "eval_bootstrap_ci": eval_bootstrap_ci, "eval_bootstrap_counts": eval_bootstrap_counts, "suggest_round_robin": suggest_round_robin, "schedule_due_local": schedule_due_local,
    "tokenise_postings": tokenise_postings, "chat_pool_top200": chat_pool_top200, "headline": headline, "chat_retrieval": chat_retrieval, "capture_titles": capture_titles, "eval_bake_off": eval_bake_off,
    **{name: shared(sql) for name, sql in SHARED.items()}, **OPERATORS, **MODEL_QUERIES,
}

EVAL_SQL = (
    TEXT_SQL + ", " + LIST_SQL.format("f") + ", tg AS (SELECT query_id, doc_id FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id, rank) = 1),"
    "dp AS (SELECT query_id, doc_id, min(rank) AS position FROM x GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM dp),"
    "er AS (SELECT tg.query_id, CASE WHEN pl.rank <= 10 THEN pl.rank END AS rank, length(b.text) % 2 AS kind FROM tg JOIN pl ON pl.query_id = tg.query_id AND pl.doc_id = tg.doc_id JOIN benchmark b ON b.item_id = tg.query_id)"
)
BOOTSTRAP_SQL = (
    ", g AS (SELECT 'first ' || k AS system, query_id, (coalesce(rank, 99) <= k)::INT - (coalesce(rank, 99) <= 2)::INT AS gain FROM er, (SELECT unnest([5, 10]) AS k)),"
    "dg AS (SELECT system, gain, block, md5('20261002:' || query_id || ':' || block) AS h FROM g, (SELECT unnest(range(250)) AS block)),"
    "u AS (SELECT system, 8 * block + k AS resample, gain, ('0x' || substr(h, 4 * k::INT + 1, 4))::INT / 65536 AS u FROM dg, (SELECT unnest(range(8)) AS k)),"
    "ct AS (SELECT *, len(list_filter([0, 1, 2, 3, 4, 5, 6], lambda n: u >= list_sum(list_transform(range(n + 1), lambda j: exp(-1) / factorial(j::INT))))) AS times FROM u),"
    "mn AS (SELECT system, resample, sum(gain * times)::DOUBLE / sum(times) AS gain FROM ct GROUP BY ALL HAVING sum(times) > 0)"
    "SELECT system, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high FROM mn GROUP BY system"
)
SUMMARY_SQL = "count(*) AS n, round(count(rank) / count(*), 6) AS recall, round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 6) AS mrr, round(count(*) FILTER (WHERE rank = 1) / count(*), 6) AS hit1 FROM er"

WALK_SQL = "WITH RECURSIVE links AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part WHERE p_partkey >= 10), w AS (SELECT id, parent AS ancestor, 1 AS distance FROM links UNION ALL SELECT w.id, l.parent, distance + 1 FROM w JOIN links l ON l.id = w.ancestor)"
EVIDENCE_SQL = (
    TEXT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + CHAT_SQL + ", h AS (SELECT x.query_id, x.doc_id, x.rank, length(c.content) AS size, x.rank AS i FROM x JOIN c ON c.chunk_id = x.chunk_id WHERE x.rank <= 16),"
    "fits AS (SELECT DISTINCT query_id, 0::BIGINT AS i, 0::BIGINT AS used, []::BIGINT[] AS docs, []::BIGINT[] AS ranks FROM h UNION ALL "
    "SELECT query_id, i, CASE WHEN ok THEN used + size ELSE used END, CASE WHEN ok THEN list_append(docs, doc_id) ELSE docs END, CASE WHEN ok THEN list_append(ranks, rank) ELSE ranks END FROM ("
    "SELECT h.query_id, h.i, h.doc_id, h.rank, h.size, f.used, f.docs, f.ranks, len(f.docs) < 8 AND len(list_filter(f.docs, lambda d: d = h.doc_id)) < 2 AND f.used + h.size <= 600 AS ok FROM fits f JOIN h ON h.query_id = f.query_id AND h.i = f.i + 1)),"
    "fin AS (SELECT query_id, unnest(ranks) AS rank FROM (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1)) "
    "SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS n, h.doc_id, h.rank, h.size FROM fin JOIN h ON h.query_id = fin.query_id AND h.rank = fin.rank"
)

MOVES_SQL = (
    "WITH " + duck(SOURCES_SQL) + ", r AS (SELECT doc_id % 2 = 1 AS gone, path, sha256(text) AS hash, folder || '/' || lang AS f2, folder AS f1 FROM s),"
    "l2 AS (SELECT a.hash, a.path AS old_path, b.path AS new_path FROM (SELECT *, row_number() OVER (PARTITION BY hash, f2 ORDER BY path) AS n FROM r WHERE gone) a JOIN (SELECT *, row_number() OVER (PARTITION BY hash, f2 ORDER BY path) AS n FROM r WHERE NOT gone) b ON a.hash = b.hash AND a.f2 = b.f2 AND a.n = b.n),"
    "r1 AS (SELECT * FROM r WHERE path NOT IN (SELECT old_path FROM l2) AND path NOT IN (SELECT new_path FROM l2)),"
    "l1 AS (SELECT a.hash, a.path AS old_path, b.path AS new_path FROM (SELECT *, row_number() OVER (PARTITION BY hash, f1 ORDER BY path) AS n FROM r1 WHERE gone) a JOIN (SELECT *, row_number() OVER (PARTITION BY hash, f1 ORDER BY path) AS n FROM r1 WHERE NOT gone) b ON a.hash = b.hash AND a.f1 = b.f1 AND a.n = b.n),"
    "r0 AS (SELECT * FROM r1 WHERE path NOT IN (SELECT old_path FROM l1) AND path NOT IN (SELECT new_path FROM l1)),"
    "l0 AS (SELECT a.hash, a.path AS old_path, b.path AS new_path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM r0 WHERE gone) a JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM r0 WHERE NOT gone) b ON a.hash = b.hash AND a.n = b.n) "
    "SELECT old_path, new_path FROM (SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0)"
)

SQL: dict[str, str] = {
    "move_pairing": MOVES_SQL,
    "schedule_due_local": "WITH l AS (SELECT ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Warsaw' AS t FROM events) SELECT CAST(t AS DATE) AS day, count(*) FILTER (WHERE hour(t) * 60 + minute(t) >= 150) AS due, min(ts) FILTER (WHERE hour(t) * 60 + minute(t) >= 150) AS first_due FROM l GROUP BY 1",
    "tokenise_postings": "WITH " + ", ".join([duck(SOURCES_SQL), CHUNKS_SQL]) + r", w AS (SELECT doc_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS ws FROM c), m AS (SELECT doc_id, sum(len(ws))::BIGINT AS n, max(len(ws)) - 1 AS last FROM w WHERE len(ws) > 0 GROUP BY doc_id), d AS (SELECT doc_id, count(DISTINCT t) AS terms FROM (SELECT doc_id, unnest(ws) AS t FROM w) GROUP BY doc_id) SELECT m.doc_id, n, terms, last FROM m JOIN d USING (doc_id)",
    "chat_pool_top200": TEXT_SQL + " SELECT query_id, chunk_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS place FROM f QUALIFY place <= 200",
    "evidence_budget": EVIDENCE_SQL,
    "ancestor_chain": WALK_SQL + " SELECT id, ancestor, distance FROM w",
    "cycle_check": WALK_SQL + ", pr AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 + p_partkey % 10 ELSE p_partkey + 1 END AS parent FROM part) SELECT child, parent, child = parent OR EXISTS (SELECT 1 FROM w WHERE w.id = pr.parent AND w.ancestor = pr.child) AS cycle FROM pr",
    "filter_llm_output": "SELECT doc_id, source || ':tool:1.0|' || lang || ' x:topic:0.7' AS entities, 'NOTE:' || source || ':c1|' || source || ':' || lang || ' x' AS relations FROM documents",
    "eval_bootstrap_counts": EVAL_SQL + BOOTSTRAP_SQL,
    "eval_flips": EVAL_SQL + " SELECT query_id, 'lost' AS flip FROM er WHERE rank > 3",
    "eval_verdict": EVAL_SQL + ", sm AS (SELECT kind, " + SUMMARY_SQL + " GROUP BY kind) SELECT a.kind, a.recall, a.mrr, 100 + a.kind AS p95, a.kind <> 0 AND a.recall >= b.recall + 0.05 - 1e-9 AND a.mrr >= b.mrr - 1e-9 AS wins FROM sm a, sm b WHERE b.kind = 0",
    "rrf_hybrid_search": ", ".join([TEXT_SQL, LIST_SQL.format("f"), BENCH_KNN, VEC_SQL, FUSE_SQL.format(1)]),
    "rrf_hybrid_chat": ", ".join([TEXT_SQL, CHAT_SQL, BENCH_KNN, VEC_SQL, FUSE_SQL.format(2)]),
    "folder_facets": "WITH " + duck(SOURCES_SQL) + ", l AS (SELECT folder FROM s WHERE NOT deleted UNION ALL SELECT folder || '/' || lang FROM s WHERE NOT deleted) SELECT folder, count(*) AS n FROM l GROUP BY folder",
    "tag_facets": "WITH " + duck(SOURCES_SQL) + ", l AS (SELECT unnest([lang, 'quality:' || quality, 'toxic:' || toxic]) AS tag FROM s WHERE NOT deleted) SELECT tag, count(*) AS n FROM l WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 200",
    "tag_normalise": "SELECT doc_id, concat_ws('|', lower(lang), lower(source), 'x') AS tags FROM documents",
    "term_frequency": "WITH " + ", ".join([duck(SOURCES_SQL), CHUNKS_SQL, POSTINGS_SQL]) + " SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM p GROUP BY term",
    "fts_or_rank": TEXT_SQL + ", " + LIST_SQL.format("f") + " SELECT query_id, chunk_id, hits, rank FROM x",
    "fts_and_match": TEXT_SQL + ", w AS (SELECT query_id, count(DISTINCT term) AS n FROM q GROUP BY query_id), ff AS (SELECT f.* FROM f JOIN w USING (query_id) WHERE n_terms * 2 >= n), " + LIST_SQL.format("ff") + " SELECT query_id, chunk_id, hits, rank FROM x",
    "fts_not_match": TEXT_SQL + ', m AS (SELECT query_id, max(hits) AS most FROM f GROUP BY query_id) SELECT query_id, count(*) AS "left" FROM f JOIN m USING (query_id) WHERE hits < most GROUP BY query_id',
    "chat_terms": "WITH " + TERMS_SQL + " SELECT item_id, coalesce(string_agg(term, ' ' ORDER BY term), '') AS terms FROM benchmark LEFT JOIN q ON query_id = item_id GROUP BY item_id",
    "chat_match_rule": TEXT_SQL + ", " + CHAT_SQL + " SELECT query_id, chunk_id, hits, n_terms, rank FROM x",
    "knn_top200": "WITH " + KNN_SQL.format("b.vec_id % 20 = 0") + " SELECT * FROM kn",
    "knn_index_top200": "WITH " + KNN_SQL.format("b.vec_id % 20 = 0") + " SELECT * FROM kn",
    "text_index_search": EDITED_TEXT_SQL + ", " + LIST_SQL.format("f") + " SELECT query_id, chunk_id, hits, rank FROM x",
    "text_index_frequencies": EDITED_TEXT_SQL + " SELECT term, count(DISTINCT chunk_id) AS n FROM p GROUP BY term",
    "emptied_notes": "SELECT lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, CASE WHEN doc_id % 10 = 3 THEN sha256('3') ELSE sha256(text) END AS hash, 0 AS first FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 NOT IN (1, 2, 4) AND trim(coalesce(text, '')) <> ''",
    "similar_names": "SELECT CAST(b.label AS VARCHAR) AS type, CAST(b.vec_id AS VARCHAR) AS norm, a.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0 WHERE " + COS + " >= 0.3 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY " + COS + " DESC, a.vec_id) = 1",
    "knn_post_filter": "WITH " + duck(SOURCES_SQL) + ", " + KNN_SQL.format("b.vec_id % 20 = 0") + ", " + VEC_SQL + " SELECT query_id, doc_id, rank, similarity FROM v",
    "nearest_same_type": "SELECT b.vec_id AS query_id, a.vec_id, " + COS + " AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.vec_id % 20 = 0 WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY similarity DESC, a.vec_id) = 1",
    "excerpt": r"WITH a AS (SELECT doc_id, replace(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 240), '\s\S*$', ''), '&[a-zA-Z]*$', '') || '…' END AS excerpt FROM a",
    "deep_link": "WITH " + duck(SOURCES_SQL) + " SELECT doc_id, 'obsidian://open?vault=My%20vault&file=' || replace(path, '/', '%2F') AS link FROM s",
    "heading_text": "SELECT doc_id, source || ' ' || lang AS same, lang || ' ' || source AS other FROM documents",
    "content_hash_duplicates": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "embed_cache_keys": "SELECT DISTINCT sha256(source || ' › ' || lang || chr(10) || chr(10) || text) AS key FROM documents",
    "embedding_backfill": "WITH t AS (SELECT source || ' › ' || lang || chr(10) || chr(10) || text AS t FROM documents) SELECT sha256('sizes' || chr(10) || t) AS key, count(*) AS n, any_value(length(t)) AS chars, any_value(octet_length(encode(t))) AS bytes FROM t WHERE t IS NOT NULL GROUP BY 1",
    "reconcile_diff": "WITH k AS (SELECT l.doc_id, CASE WHEN quality = 0 THEN 0 ELSE n_chars END AS size FROM labels l JOIN documents USING (doc_id)), s AS (SELECT doc_id, n_chars AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT coalesce(k.doc_id, s.doc_id) AS path, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN s.doc_id IS NULL THEN 'missing' WHEN k.size <> s.size THEN 'changed' ELSE 'same' END AS change FROM k FULL JOIN s ON k.doc_id = s.doc_id",
    "observation_classify": "WITH o AS (SELECT d.doc_id, n_chars > 4000 AS bad, CASE quality WHEN 0 THEN 'failed' WHEN 1 THEN 'indexed' END AS st, lang = 'en' AS cur, coalesce(toxic = 1, false) AS del FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT doc_id, CASE WHEN st IS NULL AND bad THEN 'failed' WHEN st IS NULL THEN 'new' WHEN st = 'failed' AND bad THEN 'unchanged' WHEN st = 'indexed' AND cur AND NOT del THEN 'unchanged' WHEN del AND cur THEN 'restored' ELSE 'requeued' END AS outcome FROM o) SELECT doc_id, outcome, outcome IN ('new', 'restored', 'requeued') AS queued FROM c",
    "eval_first_rank": EVAL_SQL + " SELECT query_id, rank, kind FROM er",
    "eval_summary": EVAL_SQL + " SELECT " + SUMMARY_SQL,
    "eval_split_by": EVAL_SQL + " SELECT kind, " + SUMMARY_SQL + " GROUP BY kind",
    "suggest_round_robin": "WITH " + duck(SOURCES_SQL) + " SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY md5('seed:' || path), path) AS pick FROM s WHERE NOT deleted ORDER BY pick, folder LIMIT 30",
    **{name: duck(sql) for name, sql in SHARED.items()}, **MODEL_QUERY_SQL,
}
