"""Embedding near-duplicates by a forest of random-projection trees with spill.

Trees are fitted on a bounded sample: each node splits at the sample's median along a random direction. All vectors
go down every tree; a vector near a split goes to both sides, so a close pair is rarely torn apart, and over several
trees hardly ever. Beyond the depth that the sample supports, nodes split at their sample's mean along directions
seeded by their path, so leaves stay small at any size. Vectors are compared within leaves and labels only; large
leaves are compared in pairs of blocks of bounded size, with the row counts added up instead of emitting pairs. A pair
that shares several leaves counts in the first of them. Identical vectors of a label are one class with a multiplicity.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
link with nothing; vectors of different dimensions don't link, each dimension has a forest of its own; labels may be of
any type; repeated rows are copies, each with its row, as are different vectors with one id, of which each has its own
links; a null id is never a component's name but where it has no other; other columns are ignored; an empty table gives
no rows.

A pair at the threshold lies within 0.2 of each other, and parts at a split of 64 dimensions in some 2 % of cases with
this spill; with six trees it meets in a leaf with a probability above 0.999 for tables up to millions of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, checkpointed, connected_components, require


class Forest:
    """Directions and thresholds as arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, fitted: int, spill: float, seed: int = 17):
        self.trees, self.depth, self.fitted, self.spill, self.seed = trees, depth, min(depth, fitted), spill, seed
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        nodes = (1 << self.fitted) - 1
        self.directions = rng.standard_normal((trees, nodes, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, nodes))
        self.means = np.zeros((trees, 1 << self.fitted, dim))
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for k in range(nodes):
                own = rows.pop(k)
                place = sample[own] @ self.directions[t, k]
                self.cuts[t, k] = np.median(place) if len(own) else 0.0
                rows[2 * k + 1], rows[2 * k + 2] = own[place < self.cuts[t, k]], own[place >= self.cuts[t, k]]
            for k, own in rows.items():
                if len(own):
                    self.means[t, k - nodes] = sample[own].mean(axis=0)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf number over all trees) of every leaf that a vector falls into."""
        out_rows, out_leaves = [], []
        for t in range(self.trees):
            rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                if level < self.fitted:
                    place = np.einsum("ij,ij->i", vectors[rows], self.directions[t, nodes]) - self.cuts[t, nodes]
                else:
                    place = np.zeros(len(rows))
                    for k in np.unique(nodes):
                        top = k
                        while top >= (2 << self.fitted) - 1:
                            top = (top - 1) >> 1
                        at = nodes == k
                        direction = np.random.default_rng([self.seed, t, int(k)]).standard_normal(vectors.shape[1])
                        mean = self.means[t, top - ((1 << self.fitted) - 1)]
                        place[at] = (vectors[rows[at]] - mean) @ (direction / np.linalg.norm(direction))
                left, right = place < self.spill, place >= -self.spill
                rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
            out_rows.append(rows)
            out_leaves.append(nodes - ((1 << self.depth) - 1) + (t << self.depth))
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def descend(forest: Forest):
    """(rep, label, size, embedding) -> (rep, label, size, embedding, leaves)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows, leaves = forest.leaves(unit(flat.reshape(batch.num_rows, -1)))
            order = np.lexsort((leaves, rows))
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["rep", "label", "size", "embedding", "leaves"])

    return emit


def compare(threshold: float, step: int = 256):
    """Two blocks of a leaf -> for each class how many vectors it links with here, and links that connect the blocks."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.i.iloc[0] == pdf.j.iloc[0]
        left = pdf[pdf.side == 0].sort_values("rep")
        right = left if same else pdf[pdf.side == 1].sort_values("rep")
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "links": [], "other": []}, dtype="int64")
        leaf = int(pdf.leaf.iloc[0])
        x, y = (unit(np.stack(p.embedding.to_numpy()).astype(np.float64)) for p in (left, right))
        earlier = sorted({int(v) for p in (left, right) for c in p.leaves for v in c if v < leaf})
        number = {v: k for k, v in enumerate(earlier)}

        def member(p: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(p), max(1, len(earlier))), np.float32)
            for row, c in enumerate(p.leaves):
                for v in c:
                    if v < leaf:
                        out[row, number[int(v)]] = 1
            return out

        in_left, in_right = member(left), member(right)
        ids_l, ids_r = left.rep.to_numpy(), right.rep.to_numpy()
        size_l, size_r = left["size"].to_numpy(), right["size"].to_numpy()
        links_l, links_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        root = np.arange(len(left) + (0 if same else len(right)))
        shift = 0 if same else len(left)

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for at in range(0, len(left), step):
            close = x[at : at + step] @ y.T >= threshold
            if same:
                close &= ids_l[at : at + step, None] != ids_r
            if not close.any():
                continue
            counted = close & ~((in_left[at : at + step] @ in_right.T) > 0)
            links_l[at : at + step] += counted @ size_r
            if not same:
                links_r += size_l[at : at + step] @ counted
            for k in np.flatnonzero(close.any(axis=1)):
                own = top(at + k)
                for r in {top(v) for v in np.unique(root[np.flatnonzero(close[k]) + shift])}:
                    root[max(own, r)] = min(own, r)
                    own = min(own, r)
        ids = ids_l if same else np.concatenate([ids_l, ids_r])
        links = links_l if same else np.concatenate([links_l, links_r])
        out = pd.DataFrame({"rep": ids, "links": links, "other": ids[[top(k) for k in range(len(ids))]]})
        return out[(out.links > 0) | (out.rep != out.other)]

    return pairs


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
    trees: int = 6, leaf_rows: int = 256, spill: float = 0.01, sample_rows: int = 20_000, block: int = 2048,
) -> DataFrame:
    """id, n_links, component_id and kept of each row. The driver holds sample_rows vectors of one dimension at most."""
    spark = vectors.sparkSession
    # a label of any type as text, so that equal ones, and only these, are equal
    rows = require(vectors, [id_col, vector_col, label_col]).toDF("vec_id", "embedding", "label").withColumn("label", F.when(F.col("label").isNotNull(), F.to_json(F.struct("label"))))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    usable, useless = rows.where(F.coalesce(fit, F.lit(False))), rows.where(~F.coalesce(fit, F.lit(False)))
    empty = useless.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    with Scratch(spark) as scratch:
        kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats travel as floats
        plain = F.transform("embedding", lambda v: v.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
        usable = usable.select("vec_id", "label", plain.alias("embedding"))
        key = F.sha2(F.concat_ws(",", F.col("label"), F.transform("embedding", lambda v: v.cast("string"))), 256)
        keyed = scratch.save(usable.withColumn("key", key))
        # classes have numbers of their own: ids may repeat or be null
        classes = keyed.groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        classes = scratch.save(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("rep")))
        total = classes.count()
        if not total:
            return checkpointed(empty.withColumn("kept", F.lit(True)).withColumnRenamed("vec_id", id_col))
        # a dimension with more classes than a leaf holds has a forest of its own; any other is one leaf
        large = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows).collect()}
        schema = f"rep long, label string, size long, embedding array<{kind}>, leaves array<long>"
        down = classes.where(~F.col("dim").isin(*large)).select("rep", "label", "size", "embedding", F.array(F.lit(0).cast("long")).alias("leaves"))
        for dim, n in sorted(large.items()):
            own = classes.where(F.col("dim") == dim)
            share = min(1.0, sample_rows / n)
            sample = own.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").limit(sample_rows).toPandas()
            sample_vectors = unit(np.stack(sample.embedding.to_numpy()).astype(np.float64)) if len(sample) else np.zeros((0, dim))
            forest = Forest(sample_vectors, trees, max(0, int(np.ceil(np.log2(n / leaf_rows)))), max(0, int(np.log2(max(1, len(sample) / 32)))), spill)
            down = down.unionByName(own.select("rep", "label", "size", "embedding").mapInArrow(descend(forest), schema))
        down = scratch.save(down.withColumn("dim", F.size("embedding")))
        placed = down.withColumn("leaf", F.explode("leaves"))
        sizes = scratch.save(placed.groupBy("leaf", "label", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", "label", "dim", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
        blocked = (
            placed.join(sizes, ["leaf", "label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        )
        names = ["leaf", "label", "dim", "rep", "size", "embedding", "leaves"]
        as_left = blocked.where("own <= other").select(*names, F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
        as_right = blocked.where("other < own").select(*names, F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
        found = scratch.save(as_left.unionByName(as_right).groupBy("leaf", "label", "dim", "i", "j").applyInPandas(compare(threshold), "rep long, links long, other long"))
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        parts = connected_components(scratch, found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
        placed_in = scratch.save(
            classes.select("key", "rep", "size", "least_id").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
            .select("key", "least_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
        )
        named = placed_in.groupBy("component").agg(F.min("least_id").alias("component_id"))
        known = scratch.save(placed_in.join(named, "component").select("key", "n_links", "component_id"))
        linked = keyed.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
        return checkpointed(
            linked.unionByName(empty).select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
        )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
