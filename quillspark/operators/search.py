"""Search over chunks: postings, boolean matches, exact kNN, rank fusion, chat rule and evidence.

Every operator takes a frame of queries, so one job answers many; ranks are windows per query, over lists that a
top-k has already cut. A batch of queries is sent to every task if it has been counted and is small, and else joined.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import is_identifier, web_operands_arrow, words
from quillspark.operators.graph import written

RRF_K, LIST, POOL = 60, 50, 200
HEADING, CONTENT = 1.0, 0.1  # weights of a term
SMALL_BATCH = 4096  # queries that may be sent to every task


def hint(batch: DataFrame, most: int) -> Callable[[DataFrame], DataFrame]:
    """broadcast for what is made of a batch of at most `most` rows, which are counted; nothing for a larger one."""
    return F.broadcast if batch.limit(most + 1).count() <= most else lambda df: df


def live(sources: DataFrame, folder: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Undeleted sources, below a folder and with all the tags where given."""
    out = sources.where(~F.col("deleted"))
    if folder:
        out = out.where(F.startswith(F.col("path"), F.lit(folder.strip("/") + "/")))
    for tag in tags or []:
        out = out.where(F.array_contains("tags", tag))
    return out


def postings(chunks: DataFrame) -> DataFrame:
    """One row per occurrence of a term: doc_id, chunk_id, pos, term, weight.

    A heading column, where there is one, stands before the content and weighs more.
    """
    return occurring(chunks)


def occurring(chunks: DataFrame, *more: str) -> DataFrame:
    """The postings of chunks, with more of their columns beside them."""
    content, of = words(F.col("content")), ["doc_id", "chunk_id", *more]
    if "heading" not in chunks.columns:
        return chunks.select(*of, F.posexplode(content).alias("pos", "term"), F.lit(CONTENT).alias("weight"))
    head = words(F.coalesce("heading", F.lit("")))
    rows = chunks.select(*of, F.size(head).alias("__head"), F.posexplode(F.concat(head, content)).alias("pos", "term"))
    return rows.withColumn("weight", F.when(F.col("pos") < F.col("__head"), HEADING).otherwise(CONTENT)).drop("__head")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk, also of one without words: doc_id, chunk_id, terms, the different ones of its postings, parted by
    blanks, and words, how many postings it has.

    Chunks that are dealt by doc_id stay where they are.
    """
    text = F.col("content") if "heading" not in chunks.columns else F.when(F.col("content").isNotNull(), F.concat_ws("\n", "heading", "content"))
    each = chunks.select("doc_id", "chunk_id", text.alias("text")).groupBy("doc_id", "chunk_id").agg(F.collect_list("text").alias("texts"))
    found = words(F.array_join("texts", "\n"))
    return each.select("doc_id", "chunk_id", F.array_join(F.array_distinct(found), " ").alias("terms"), F.size(found).alias("words"))


class PostingsIndex:
    """Postings kept in a table bucketed and sorted by term, so that a search reads the buckets of its terms only."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    def write(self, chunks: DataFrame) -> None:
        rows = postings(chunks).repartition(self.buckets, "term")
        rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "term").sortBy("term").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def of(self, terms: DataFrame, most: int = 10_000) -> DataFrame:
        """The postings of the terms (query_id, term): named in the scan if they are few, which prunes buckets and row groups."""
        known = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]
        return self.rows().where(F.col("term").isin(known)) if len(known) <= most else self.rows().join(terms.select("term").distinct(), "term", "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id, doc_id, hits and n_terms of chunks that hold a term; terms: query_id, term.

    Occurrences are counted in their chunk before they meet the queries that ask for them. Postings that are dealt by
    doc_id stay where they are.
    """
    small = hint(terms, 16 * SMALL_BATCH)
    asked = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("identifier", is_identifier(F.col("term")))
    counted = postings.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("n"))
    each = counted.join(small(asked), "term").withColumn("n", F.col("n") * F.col("times"))
    return each.groupBy("query_id", "doc_id", "chunk_id").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("n_terms"), F.max("identifier").alias("identifier"))


def web_clauses(queries: DataFrame) -> DataFrame:
    """query_id, part, clause, negated, terms of web searches (query_id, text), all words of them; see web_operands.

    An operand of several words is a phrase, one without words is left out, and equal ones of a part count once.
    """
    found = queries.select("query_id", F.explode(web_operands_arrow("text")).alias("o")).select("query_id", "o.part", "o.negated", words(F.col("o.operand")).alias("terms"))
    return found.where(F.size("terms") > 0).distinct().withColumn("clause", F.xxhash64("negated", "terms"))


def web_matches(postings: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_id, hits and score of chunks that a web search accepts; queries: query_id, text.

    A chunk matches a part that has all its clauses and none of its negated ones; hits are the places where a clause of
    a matching part begins, score is the cover density of its words. A part of negated clauses only matches every other
    chunk, with no hits. A part is first looked for by its rarest word; only the chunks that hold it are read for the
    others, so no common word is sorted or shuffled. Chunks that are dealt by doc_id stay where they are. Clauses, and
    the words of the chunks that hold all those of a part, are written to the shared folder once.
    """
    small, clauses = hint(queries, SMALL_BATCH), written(web_clauses(queries))
    terms = clauses.select("query_id", "part", "clause", "negated", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "term"))
    of, key = ["query_id", "part"], ["query_id", "part", "doc_id", "chunk_id"]
    needed = terms.groupBy(*of, "term").agg(F.bool_or(~F.col("negated")).alias("needed"))
    needs = needed.where("needed").groupBy(*of).agg(F.collect_list("term").alias("needs"))
    # as the joins below leave out chunks without a doc_id, the same rows are dealt once for all three
    counts = postings.where("doc_id IS NOT NULL").select("term").join(small(needed.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), "term")
    rarest = needed.where("needed").join(counts, "term", "left").groupBy(*of).agg(F.min(order)["term"].alias("term"))
    candidates = postings.select("doc_id", "chunk_id", "term").join(small(rarest), "term").select(*key).distinct()
    by_note = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", *of)).alias("asked"))
    asked = chunks.join(by_note.hint("shuffle_hash"), "doc_id").withColumn("asked", F.explode(F.filter("asked", lambda a: a["chunk_id"] == F.col("chunk_id"))))
    text = F.concat_ws(" ", *[c for c in ("heading", "content") if c in chunks.columns])
    able = asked.select(*chunks.columns, "asked.query_id", "asked.part").join(small(needs), of).where(F.size(F.array_except("needs", words(text))) == 0)
    occurrences = written(occurring(able, *of).join(small(needed), [*of, "term"]).select(*key, "term", "needed", "pos", "weight"))
    begins = occurrences.join(small(terms), ["query_id", "part", "term"]).withColumn("begin", F.col("pos") - F.col("place"))
    whole = begins.groupBy(*key, "clause", "negated", "n", "begin").agg(F.count(F.lit(1)).alias("there")).where("there = n")
    wanted = clauses.groupBy(*of).agg(F.count_if(~F.col("negated")).alias("wanted"))
    seen = whole.groupBy(*key).agg(F.countDistinct(F.when(~F.col("negated"), F.col("clause"))).alias("found"), F.bool_or("negated").alias("barred"), F.collect_set(F.when(~F.col("negated"), F.col("begin"))).alias("begins"))
    density = occurrences.where("needed").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("pos", "term", "weight"))).alias("at"), F.countDistinct("term").alias("n"))
    density = density.select(*key, cover_density("at", "n").alias("score"))
    good = seen.join(small(wanted.where("wanted > 0")), of).where("found = wanted AND NOT barred").join(density, key, "left").select("query_id", "doc_id", "chunk_id", "begins", "score")
    # a part without a wanted clause takes every chunk that its negated ones leave; a chunk may hold none of their words
    loose = wanted.where("wanted = 0").select(*of)
    if loose.isEmpty():
        return in_all(good)
    barred = postings.join(small(terms.join(loose, of)), "term").withColumn("begin", F.col("pos") - F.col("place")).groupBy(*key, "clause", "n", "begin").agg(F.count(F.lit(1)).alias("there")).where("there = n").select(*key).distinct()
    rest = chunks.select("doc_id", "chunk_id").join(small(loose)).join(barred, key, "left_anti")
    return in_all(good.unionByName(rest.select("query_id", "doc_id", "chunk_id", F.array().cast("array<int>").alias("begins"), F.lit(0.0).alias("score"))))


def in_all(parts: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_id, hits and score over the parts of a query: different places, and the sum of scores."""
    return parts.groupBy("query_id", "doc_id", "chunk_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("begins")))).cast("long").alias("hits"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 9).alias("score"))


@F.pandas_udf(T.DoubleType())
def cover_density(places: pd.Series, terms: pd.Series) -> pd.Series:
    """Cover density (Clarke, Cormack and Tudhope, 2000) of words at (pos, term, weight) in order.

    A cover is a shortest stretch that holds every one of the terms; it counts by the harmonic mean of its weights, less
    the more other words lie in it. With one term every occurrence is a cover.
    """

    def one(at, n: int) -> float:
        last: dict[str, int] = {}
        total, begun = 0.0, -1
        for k, row in enumerate(at):
            last[row["term"]] = k
            if len(last) == n and (first := min(last.values())) > begun:
                # shortest if the stretch holds its first word's term only there
                inside = at[first : k + 1]
                inverse = sum(1 / r["weight"] for r in inside)
                noise = row["pos"] - at[first]["pos"] - (len(inside) - 1)
                total += len(inside) / inverse / (1 + max(0, noise))
                begun = first
        return total

    return pd.Series([one(a, int(n)) for a, n in zip(places, terms, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def headline(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Up to two stretches of 12 to 30 words around the words of a query, which are marked; null where none is there.

    The text is escaped before it is cut, and what then holds another tag is dropped.
    """

    def one(text: str | None, wanted) -> str | None:
        if text is None or wanted is None:
            return None
        known, flat = {str(w).lower() for w in wanted}, " ".join(text.split())
        parts = [html.escape(w, quote=False) for w in flat.split(" ")]
        hit = [any(w in known for w in TOKEN.findall(p.lower())) for p in flat.split(" ")]
        at, out, free = [k for k, h in enumerate(hit) if h], [], 0
        while at and len(out) < 2:
            begin = max(free, at[0] - 4)
            inside = [k for k in at if k < begin + 30]
            end = min(len(parts), max(inside[-1] + 5, begin + 12))
            end = min(end, begin + 30)
            out.append(" ".join(mark(parts[k], known) if hit[k] else parts[k] for k in range(begin, end)))
            free, at = end, [k for k in at if k >= end]
        made = " … ".join(out)
        plain = made.replace("<mark>", "").replace("</mark>", "")
        return made if out and "<" not in plain and ">" not in plain else None

    return pd.Series([one(t, w) for t, w in zip(texts, terms, strict=True)], dtype="object")


TOKEN = re.compile(r"\w+")


def mark(part: str, known: set[str]) -> str:
    """Marks the words of an escaped part that are known; the names of entities aren't words."""
    return re.sub(r"&\w+;|\w+", lambda m: f"<mark>{m[0]}</mark>" if m[0].lower() in known else m[0], part)


def top(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(name) <= k)


def text_list(found: DataFrame, k: int = LIST, by: str = "hits") -> DataFrame:
    return top(found, [F.desc(by), F.col("chunk_id")], k)


def chat_list(found: DataFrame) -> DataFrame:
    """Top 200 by score, then two different terms or an identifier, then ranked anew."""
    pool = top(found, [F.desc("hits"), F.col("chunk_id")], POOL, "place")
    return text_list(pool.where((F.col("n_terms") >= 2) | F.col("identifier")).drop("place"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def knn(vectors: DataFrame, queries: DataFrame, k: int = POOL, id_col: str = "vec_id", vector_col: str = "embedding", by: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity and rank of the nearest k vectors of each query; queries: query_id, query_vector.

    Exact, as products of blocks: each task keeps the best k of its vectors for every query, and these are merged. A
    batch of up to 4096 queries goes to every task; a larger one is cut into blocks that meet blocks of the vectors.
    by: a column that both have; only vectors with the query's value are compared.
    """
    same = F.lit("") if by is None else F.col(by).cast("string")
    wanted = queries.select("query_id", "query_vector", same.alias("by")).where("query_vector IS NOT NULL AND by IS NOT NULL")
    known = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), same.alias("by")).where("embedding IS NOT NULL AND by IS NOT NULL")
    few = wanted.limit(SMALL_BATCH + 1).toPandas()
    if len(few) <= SMALL_BATCH:
        found = known.mapInArrow(nearest(few, k), NEAREST)
    else:
        rows = -(-known.count() // 20_000) or 1
        columns = -(-wanted.count() // SMALL_BATCH)
        left = known.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        right = wanted.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(columns)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda v, w: scored(w, v, k), NEAREST)
    return top(found, [F.desc("similarity"), F.col("vec_id")], k)


NEAREST = "query_id long, vec_id long, similarity double"


def nearest(queries: pd.DataFrame, k: int):
    """vec_id, embedding, by -> the best k of a task's vectors for each query (query_id, query_vector, by)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                best.add(batch.slice(at, STEP).to_pandas())
        yield from best.batches()

    return emit


def scored(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of a block of vectors for each query with the same value of `by`."""
    best = Best(queries, k)
    for at in range(0, len(vectors), STEP):
        best.add(vectors.iloc[at : at + STEP])
    return pd.concat([NONE, *best.frames()])


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


NONE = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
STEP = 4096  # vectors that are multiplied at once, with 256 queries


class Best:
    """The best k vectors of each query so far, ties by the smaller id: two numbers for each place of a list and no more."""

    def __init__(self, queries: pd.DataFrame, k: int):
        self.k, self.query_ids, self.q = k, queries.query_id.to_numpy(), unit(queries.query_vector)
        self.of = {value: np.asarray(rows) for value, rows in queries.reset_index(drop=True).groupby("by", sort=False).indices.items()}
        self.similarity, self.vec_id = np.full((len(queries), k), -2.0), np.zeros((len(queries), k), np.int64)

    def add(self, vectors: pd.DataFrame, rows: np.ndarray | None = None) -> None:
        """vec_id, embedding, by; rows: the places of the queries that are asked, or all of them."""
        for value, v in vectors.groupby("by", sort=False):
            own = self.of.get(value, np.zeros(0, np.int64))
            own = own if rows is None else np.intersect1d(own, rows)
            if len(own):
                ids, x = v.vec_id.to_numpy(), unit(v.embedding)
                for at in range(0, len(own), 256):
                    self._merge(own[at : at + 256], ids, x)

    def _merge(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        close = np.round(self.q[own] @ x.T, 6) + 0.0
        close[np.isnan(close)] = -2
        floor = self.similarity[own, -1:]
        if len(ids) > self.k and (close >= floor).sum() > 2 * self.k * len(own):
            floor = np.maximum(floor, np.partition(close, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None])
        row, column = np.nonzero((close >= floor) & (close > -2))
        if not len(row):
            return
        touched, at = np.unique(row, return_inverse=True)
        old = own[touched]
        similarity = np.concatenate([self.similarity[old].ravel(), close[row, column]])
        vec_id = np.concatenate([self.vec_id[old].ravel(), ids[column]])
        at = np.concatenate([np.repeat(np.arange(len(old)), self.k), at])
        order = np.lexsort((vec_id, -similarity, at))
        first = np.searchsorted(at[order], np.arange(len(old)))
        take = order[first[:, None] + np.arange(self.k)]
        self.similarity[old], self.vec_id[old] = similarity[take], vec_id[take]

    def frames(self) -> Iterator[pd.DataFrame]:
        for at in range(0, len(self.query_ids), 256):
            row, place = np.nonzero(self.similarity[at : at + 256] > -2)
            yield pd.DataFrame({"query_id": self.query_ids[at + row], "vec_id": self.vec_id[at + row, place], "similarity": self.similarity[at + row, place]})

    def batches(self) -> Iterator[pa.RecordBatch]:
        for found in self.frames():
            yield pa.RecordBatch.from_pandas(found.astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"}), preserve_index=False)


def fuse(text: DataFrame, vector: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two lists with query_id, doc_id, chunk_id, rank (and similarity)."""
    both = text.select("query_id", "doc_id", "chunk_id", "rank", F.lit(True).alias("by_text"), F.lit(None).cast("double").alias("similarity")).unionByName(
        vector.select("query_id", "doc_id", "chunk_id", "rank", F.lit(False).alias("by_text"), "similarity")
    )
    return both.groupBy("query_id", "doc_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("rank"))), 9).alias("score"), F.bool_or("by_text").alias("by_text"),
        F.bool_or(~F.col("by_text")).alias("by_vector"), F.max("similarity").alias("similarity"),
    )


def best_per_note(fused: DataFrame, per_note: int, limit: int) -> DataFrame:
    near = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id")
    kept = fused.withColumn("per_note", F.row_number().over(near)).where(F.col("per_note") <= per_note)
    return top(kept, [F.desc("score"), F.col("doc_id"), F.col("per_note")], limit)


def evidence(hits: DataFrame, limit: int = 8, per_note: int = 2, budget: int = 8000) -> DataFrame:
    """Greedy choice in rank order within a budget of characters: what doesn't fit is skipped, later hits may fit."""
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<doc_id:bigint,rank:int,size:bigint>>").alias("chosen"))

    def step(state: Column, hit: Column) -> Column:
        same = F.size(F.filter(state["chosen"], lambda c: c["doc_id"] == hit["doc_id"]))
        fits = (F.size(state["chosen"]) < limit) & (same < per_note) & (state["used"] + hit["size"] <= budget)
        taken = F.struct((state["used"] + hit["size"]).alias("used"), F.concat(state["chosen"], F.array(hit)).alias("chosen"))
        return F.when(fits, taken).otherwise(state)

    ordered = hits.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "size"))), lambda h: F.struct(h["doc_id"].cast("long").alias("doc_id"), h["rank"].cast("int").alias("rank"), h["size"].cast("long").alias("size"))).alias("hits")
    )
    return ordered.select("query_id", F.posexplode(F.aggregate("hits", empty, step, lambda s: s["chosen"])).alias("n", "hit")).select(
        "query_id", (F.col("n") + 1).alias("n"), "hit.doc_id", "hit.rank", "hit.size"
    )
