"""Ranked lexical search over an index clustered by recursive graph bisection.

1. An Arrow pass counts the terms of every document (its length over all of them) and keeps the counts of those terms
   that some query asks for; the other postings could be read by no query of the batch. Document frequencies, the number
   of documents and the sum of their lengths are exact, over all rows.
2. Recursive graph bisection (Dhulipala et al., 2016) is fitted on a bounded sample of documents: halves swap documents
   while that lowers the logarithmic cost of the terms' gaps. The fit is a tree of terms' leanings, down which every
   document goes to its cluster. Clusters are stored as shards of bounded rows, whatever their size: a row of the index
   is a term in a shard, with the places and integer impacts of its documents, in the order of their ids.
3. A query's bound in a cluster is the sum of its terms' largest impacts there. Clusters are visited by falling bound,
   in rounds: the best few, then more, then all whose bound still reaches the last score a query holds. That stop is
   exact, equal scores included: a cluster whose bound equals it is visited if it holds a smaller id.

A shard meets blocks of queries in one task and keeps the best `top` for each. Only a sample of bounded rows, cluster
sizes (1024 at most), totals, and query terms up to `vocabulary_held` reach the driver; beyond that the counts of all
terms meet the query terms in a join.

Defined results: a null text has no terms; documents without terms don't count; each row is a document and each query
row a query of its own, whatever their ids; of equal scores the smaller id is first, null ids last (2^63-1 counts as
null); queries without known terms get no rows; other columns are ignored; empty tables give no rows; very long texts
are counted whole.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.byte_bpe import cut_blocks
from quillspark.llm.common import Scratch, ascii_lower, checkpointed, require

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LAST_ID = (1 << 63) - 1
IDS = -1  # the row of a shard that lists its documents' ids
FORWARD = "doc long, id long, n long, terms array<long>, tfs array<long>"


def counter(numbers: dict[str, int] | None, block_bytes: int):
    """(doc, words, id) -> (doc, id, n, terms, tfs) of rows with words; terms: those numbered, or all as strings."""
    known = None if numbers is None else pa.array(numbers, pa.string())
    ids = None if numbers is None else np.array([*numbers.values(), -1], np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for docs, sizes, places, data, edges in cut_blocks(batch, block_bytes) if batch.num_rows else ():
                own = batch.column(2).slice(done, len(docs))
                done += len(docs)
                texts = pa.array([data[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())
                row = np.repeat(np.arange(len(docs)), sizes)
                if known is not None:
                    at = pa.compute.index_in(texts, known).fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)
                    asked = at[places] < len(ids) - 1
                    row, places = row[asked], places[asked]
                pair, tf = np.unique(row * max(1, len(texts)) + places, return_counts=True)
                row, word = pair // max(1, len(texts)), pair % max(1, len(texts))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(docs)))]).astype(np.int32))
                terms = texts.take(pa.array(word)) if known is None else pa.array(ids[at[word]])
                columns = [docs, own, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))]
                out = pa.RecordBatch.from_arrays(columns, names=["doc", "id", "n", "terms", "tfs"])
                yield out.filter(pa.array(sizes > 0))

    return emit


class Bisection:
    """A tree of halves fitted on a sample: keys[level] are node * len(terms) + term, leans[level] > 0 towards the right."""

    def __init__(self, docs: list[np.ndarray], depth: int, rounds: int = 12):
        sizes = np.array([len(d) for d in docs], np.int64)
        self.terms, term = np.unique(np.concatenate(docs) if docs else np.zeros(0, np.int64), return_inverse=True)
        self.depth, self.keys, self.leans = depth, [], []
        doc, node = np.repeat(np.arange(len(docs)), sizes), np.zeros(len(docs), np.int64)
        for _ in range(depth):
            kinds, pair = np.unique(node[doc] * len(self.terms) + term, return_inverse=True)
            half = np.bincount(node, minlength=1)
            order = np.argsort(node, kind="stable")
            place = np.arange(len(node)) - np.repeat(np.cumsum(half) - half, half)
            side = np.zeros(len(node), np.int64)
            side[order] = place >= (half[node[order]] + 1) // 2
            n = np.maximum(1, (half + 1) // 2)[kinds // max(1, len(self.terms))]

            def cost(left: np.ndarray, right: np.ndarray, n: np.ndarray = n) -> np.ndarray:
                return left * np.log2(n / (left + 1)) + right * np.log2(n / (right + 1))

            for _ in range(rounds):
                right = np.bincount(pair, side[doc], len(kinds))
                left = np.bincount(pair, minlength=len(kinds)) - right
                now = cost(left, right)
                to_right, to_left = now - cost(np.maximum(left - 1, 0), right + 1), now - cost(left + 1, np.maximum(right - 1, 0))
                gain = np.bincount(doc, np.where(side[doc] == 0, to_right[pair], to_left[pair]), len(node))
                # the k-th best of each half change places while both together gain
                order = np.lexsort((-gain, side, node))
                rank = np.zeros(len(node), np.int64)
                first = np.flatnonzero(np.concatenate([[True], (node[order][1:] != node[order][:-1]) | (side[order][1:] != side[order][:-1])]))
                rank[order] = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
                key = node * (len(node) + 1) + rank
                ones, others = order[side[order] == 0], order[side[order] == 1]
                _, a, b = np.intersect1d(key[ones], key[others], assume_unique=True, return_indices=True)
                swap = gain[ones[a]] + gain[others[b]] > 1e-9
                side[ones[a][swap]], side[others[b][swap]] = 1, 0
                if swap.sum() * 100 < len(node):
                    break
            right = np.bincount(pair, side[doc], len(kinds))
            left = np.bincount(pair, minlength=len(kinds)) - right
            lean = cost(left + 1, right) - cost(left, right + 1)
            told = left + right > 2  # fewer say nothing about other documents
            self.keys.append(kinds[told])
            self.leans.append(lean[told])
            node = 2 * node + side

    def clusters(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The cluster of each of n documents by its postings (doc, term)."""
        node = np.zeros(n, np.int64)
        if not len(self.terms):
            return node
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        doc, at = doc[self.terms[at] == term], at[self.terms[at] == term]
        for keys, leans in zip(self.keys, self.leans, strict=True):
            own = node[doc] * len(self.terms) + at
            k = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            lean = np.where(keys[k] == own, leans[k], 0.0) if len(keys) else np.zeros(len(own))
            node = 2 * node + (np.bincount(doc, lean, n) > 0)
        return node


def router(tree: Bisection):
    """Forward rows -> with their cluster."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            cluster = tree.clusters(np.repeat(np.arange(batch.num_rows), sizes), batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], names=["doc", "id", "n", "terms", "tfs", "cluster"])

    return emit


def inverter(documents: int, length: int):
    """The rows of a shard -> a row per term: places in the order of ids and impacts; and the ids by place."""

    def invert(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("doc", "ascending")]).combine_chunks()
        sizes = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(rows.num_rows), sizes)
        term, tf = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
        m = 100 - 25 + (25 * rows["n"].to_numpy() * documents) // length
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[place])
        order = np.lexsort((place, term))
        term, place, impact = term[order], place[order], impact[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        ends = np.concatenate([first, [len(term), len(term) + rows.num_rows]]).astype(np.int32)
        ids = rows["id"].to_numpy()
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in ((place, np.arange(rows.num_rows)), (impact, ids))]
        bound = np.append(np.maximum.reduceat(impact, first) if len(first) else first, ids.min())
        n = len(first) + 1
        return pa.Table.from_arrays(
            [pa.array(np.full(n, rows[c][0].as_py())) for c in ("cluster", "shard")] + [pa.array(np.append(term[first], IDS)), pa.array(bound), *lists],
            names=["cluster", "shard", "term", "bound", "places", "impacts"],
        )

    return invert


INDEX = "cluster long, shard long, term long, bound long, places array<long>, impacts array<long>"


def scorer(top: int):
    """(a shard's index rows, its visits by a block of queries) -> (query, id, score), the best `top` of each."""

    def score(index: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "id": [], "score": []}, dtype="int64")]
        if len(visits):
            ids = index[index.term == IDS].impacts.iloc[0]
            lists = {t: (p, i) for t, p, i in zip(index.term, index.places, index.impacts, strict=True) if t != IDS}
            for query, least, terms, weights in zip(visits["query"], visits.least, visits.terms, visits.weights, strict=True):
                scores = np.zeros(len(ids), np.int64)
                for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                    if t in lists:
                        scores[lists[t][0]] += w * lists[t][1]
                at = np.flatnonzero(scores >= max(1, least))
                at = at[np.argsort(-scores[at], kind="stable")[:top]]  # places are in the order of ids
                out.append(pd.DataFrame({"query": query, "id": ids[at], "score": scores[at]}))
        return pd.concat(out)

    return score


def forward_rows(scratch: Scratch, docs: DataFrame, vocabulary: DataFrame, vocabulary_held: int, block_bytes: int) -> DataFrame:
    """doc (a number), id, n, terms and tfs of each row that has any term; docs: id, text; vocabulary: term, number."""
    words = docs.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("doc"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("words"), "id")
    held = vocabulary.limit(vocabulary_held + 1).collect()
    if len(held) <= vocabulary_held:
        return scratch.save(words.mapInArrow(counter({r.term: r.number for r in held}, block_bytes), FORWARD))
    every = scratch.save(words.mapInArrow(counter(None, block_bytes), "doc long, id long, n long, terms array<string>, tfs array<long>"))
    own = every.select("doc", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("doc", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    own = own.join(vocabulary, "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("number", "tf"))).alias("t"))
    none = F.array().cast("array<long>")
    rows = every.select("doc", "id", "n").join(own, "doc", "left")
    return scratch.save(rows.select("doc", "id", "n", F.coalesce("t.number", none).alias("terms"), F.coalesce("t.tf", none).alias("tfs")))


def sampled(forward: DataFrame, total: int, sample_rows: int, most_terms: int) -> list[np.ndarray]:
    """Term lists of about sample_rows documents with 2 to most_terms terms asked for, chosen by a hash of their number."""
    share = min(1.0, sample_rows / max(1, total))
    rows = forward.where((F.size("terms") > 1) & (F.size("terms") <= most_terms) & (F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(1 << 30)) <= int(share * (1 << 30))))
    return [np.array(t, np.int64) for t in rows.select("doc", "terms").limit(sample_rows).toPandas().sort_values("doc").terms]


class ClusteredIndex:
    """The index of a table of documents for the terms of a batch of queries, in tables of a Scratch."""

    def __init__(self, scratch: Scratch, docs: DataFrame, queries: DataFrame, shard_rows: int, cluster_rows: int, sample_rows: int, vocabulary_held: int, block_bytes: int):
        asked = queries.select("query", F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
        asked = scratch.save(asked.groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")))
        vocabulary = scratch.save(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("number")))
        forward = forward_rows(scratch, docs, vocabulary, vocabulary_held, block_bytes)
        at = scratch.n
        self.documents, self.length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        seen = forward.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.ln((2 * F.lit(self.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long") * F.col("times")
        self.asked = scratch.save(asked.join(vocabulary, "term").join(seen, "number").select("query", F.col("number").alias("term"), weight.alias("weight")))
        # clusters of some cluster_rows documents, 1024 at most, of 16 documents of the sample at least
        sample = sampled(forward, self.documents, sample_rows, 2048)
        depth = max(0, min(10, math.ceil(math.log2(max(1, self.documents / cluster_rows))), int(math.log2(max(1, len(sample) / 16)))))
        placed = scratch.save(forward.where(F.size("terms") > 0).mapInArrow(router(Bisection(sample, depth)), FORWARD + ", cluster long"))
        scratch.drop(at)
        at = scratch.n
        sizes = {r.cluster: -(-r.n // shard_rows) for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
        wide = {c: n for c, n in sizes.items() if n > 1}
        parts = F.coalesce(F.create_map(*[F.lit(x) for c, n in wide.items() for x in (c, n)])[F.col("cluster")], F.lit(1)) if wide else F.lit(1)
        shard = F.shiftleft("cluster", 40) + F.pmod(F.xxhash64("doc"), parts)
        rows = placed.withColumn("shard", shard).groupBy("shard").applyInArrow(inverter(self.documents, self.length), INDEX)
        self.rows = scratch.save(rows)
        scratch.drop(at)

    def bounds(self) -> DataFrame:
        """query, cluster, bound, and the smallest id in the cluster."""
        own = self.rows.groupBy("cluster", "term").agg(F.max(F.when(F.col("term") != IDS, F.col("bound"))).alias("bound"), F.min("bound").alias("least_id"))
        held = self.asked.join(own.where(F.col("term") != IDS), "term").groupBy("query", "cluster").agg(F.sum(F.col("weight") * F.col("bound")).alias("bound")).where("bound > 0")
        return held.join(own.where(F.col("term") == IDS).select("cluster", "least_id"), "cluster")

    def visit(self, visits: DataFrame, blocks: int, top: int) -> DataFrame:
        """query, id, score: the best of each visit (query, cluster, least)."""
        lists = self.asked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
        own = visits.join(lists, "query").select("query", "cluster", "least", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
        shards = self.rows.where(F.col("term") == IDS).select("cluster", "shard")
        wanted = own.select("cluster", "block").distinct().join(shards, "cluster").select("shard", "block")
        # renamed, so that the two sides, which come from the same tables, have columns of their own
        left = self.rows.join(wanted, "shard").select("shard", "block", "term", "places", "impacts").toDF("shard_", "block_", "term", "places", "impacts")
        right = own.join(shards, "cluster").select("shard", "block", "query", "least", "terms", "weights").toDF("shard", "block", "query", "least", "terms", "weights")
        return left.groupBy("shard_", "block_").cogroup(right.groupBy("shard", "block")).applyInPandas(scorer(top), "query long, id long, score long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def ranked_search(
    docs: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text",
    shard_rows: int = 8192, cluster_rows: int = 1024, sample_rows: int = 8192, first_visits: int = 4, query_block: int = 256, vocabulary_held: int = 1_000_000, block_bytes: int = 4 << 20,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each query with a score above 0, of equal scores the smaller ids."""
    with Scratch(docs.sparkSession) as scratch:
        asked = scratch.save(require(queries, [query_col, query_text_col]).toDF("item_id", "text").withColumn("query", F.monotonically_increasing_id()))
        rows = require(docs, [id_col, text_col]).toDF("id", "text").withColumn("id", F.coalesce("id", F.lit(LAST_ID)))
        index = ClusteredIndex(scratch, rows, asked.select("query", "text"), shard_rows, cluster_rows, sample_rows, vocabulary_held, block_bytes)
        blocks = -(-asked.count() // query_block) or 1
        turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "cluster"))
        bounds = scratch.save(index.bounds().withColumn("turn", turn))
        best, low, high = None, 0, first_visits
        while True:
            if best is None:
                visits = bounds.withColumn("least", F.lit(0).cast("long")).where(F.col("turn") <= high)
            else:
                last = best.where(F.col("rank") == top).select("query", F.col("score").alias("least"), F.col("id").alias("last_id"))
                reach = F.col("least").isNull() | (F.col("bound") > F.col("least")) | (F.col("bound") == F.col("least")) & (F.col("least_id") <= F.col("last_id"))
                visits = bounds.where(F.col("turn") > low).join(last, "query", "left").where(reach).where(F.col("turn") <= high).na.fill(0, ["least"])
            visits = scratch.save(visits.select("query", "cluster", "least"))
            if best is not None and visits.isEmpty():
                break
            found = index.visit(visits, blocks, top)
            best = scratch.save(best_of(found if best is None else found.unionByName(best.drop("rank")), top))
            low, high = high, 1 << 30 if low else 4 * high
        ranked = best.join(asked.select("query", "item_id"), "query")
        doc_id = F.when(F.col("id") < LAST_ID, F.col("id")).alias(id_col)
        return checkpointed(ranked.select(F.col("item_id").alias(query_col), F.col("rank").cast("int").alias("rank"), doc_id, "score"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
