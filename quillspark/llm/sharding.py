"""K-d tree sharding: recursive splits at distributed weighted medians along the widest dimension.

A node that is to hold several shards is split where the weight is divided in proportion to the shards on each side
(the median, for an even number). Dimensions are metadata derived from the text, and ties are broken by a hash of the
text, so equal texts have equal places and always meet in one shard, without a join. Each round reads one narrow
checkpointed table; tasks return a histogram of bounded size for each open node, which is refined until the split is
exact to a few parts in 100,000 of the node's weight, or to a single text.

Defined results: a null text is empty and has size 1; repeated rows and equal texts share a shard; a single group of
copies that outweighs a shard stays whole, so the rest is balanced around it; an empty table gives no rows; other
columns are ignored; very long texts count whole.
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
from pyspark.sql import types as T

from quillspark.llm.common import Scratch, checkpointed, require

BINS_LOG2, VALUE_BITS, HASH_BITS = 12, 24, 24
KEY_BITS = VALUE_BITS + HASH_BITS


class Node:
    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.dim = self.low = self.high = self.cut = None
        self.left: Node | None = None
        self.right: Node | None = None


def place_keys(node: Node, dims: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Place along the node's dimension: the scaled value, then the hash."""
    span = node.high - node.low
    value = np.zeros(len(dims)) if span <= 0 else (dims[:, node.dim] - node.low) / span
    return (np.clip(value, 0, 1) * ((1 << VALUE_BITS) - 1)).astype(np.int64) << HASH_BITS | tie


def leaves(root: Node, dims: np.ndarray, tie: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
    """The tree's present leaves with the rows that lie in each."""
    todo = [(root, np.arange(len(dims)))]
    while todo:
        node, rows = todo.pop()
        if node.left is None:
            yield node, rows
            continue
        right = place_keys(node, dims[rows], tie[rows]) >= node.cut
        todo += [(node.left, rows[~right]), (node.right, rows[right])]


def columns(batch: pa.RecordBatch, n_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dims = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_dims)], axis=1)
    return dims, batch.column(n_dims).to_numpy(zero_copy_only=False), batch.column(n_dims + 1).to_numpy(zero_copy_only=False)


def ranges(root: Node, n_dims: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[float, float, int]] = {}
        for batch in batches:
            dims, tie, weight = columns(batch, n_dims)
            for node, rows in leaves(root, dims, tie):
                if node.shards > 1 and len(rows):
                    total = int(weight[rows].sum())
                    for d in range(n_dims):
                        lo, hi, w = found.get((node.first, d), (np.inf, -np.inf, 0))
                        found[node.first, d] = (min(lo, dims[rows, d].min()), max(hi, dims[rows, d].max()), w + total)
        yield pa.RecordBatch.from_pylist(
            [{"node": n, "dim": d, "low": float(x[0]), "high": float(x[1]), "weight": x[2]} for (n, d), x in found.items()],
            pa.schema([("node", pa.int32()), ("dim", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("weight", pa.int64())]),
        )

    return emit


def histogram(root: Node, n_dims: int, windows: dict[int, tuple[int, int]]):
    """windows: for each open node the prefix of the key that is refined and its length in bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, tie, weight = columns(batch, n_dims)
            for node, rows in leaves(root, dims, tie):
                if node.first in windows and node.shards > 1 and len(rows):
                    prefix, bits = windows[node.first]
                    key = place_keys(node, dims[rows], tie[rows])
                    inside = (key >> (KEY_BITS - bits)) == prefix
                    bins = (key[inside] >> (KEY_BITS - bits - BINS_LOG2)) & ((1 << BINS_LOG2) - 1)
                    sums.setdefault(node.first, np.zeros(1 << BINS_LOG2, np.int64))
                    np.add.at(sums[node.first], bins, weight[rows][inside])
        rows = [{"node": n, "bin": int(b), "weight": int(s[b])} for n, s in sums.items() for b in np.flatnonzero(s)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("node", pa.int32()), ("bin", pa.int32()), ("weight", pa.int64())]))

    return emit


def grow(points: DataFrame, n_dims: int, shards: int, exact: float = 2e-5) -> Node:
    """points: the dimensions, a hash and a weight. The driver holds at most shards * 4096 sums."""
    root = Node(0, shards)
    scale: list[float] | None = None
    while True:
        found = points.mapInArrow(ranges(root, n_dims), "node int, dim int, low double, high double, weight long").groupBy("node", "dim").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("weight").alias("weight")
        ).collect()
        extent = {(r.node, r.dim): r for r in found}
        nodes = {n.first: n for n, _ in leaves(root, np.zeros((0, n_dims)), np.zeros(0, np.int64)) if n.shards > 1}
        if not nodes:
            return root
        if scale is None:
            scale = [max(1e-300, extent[0, d].high - extent[0, d].low) if (0, d) in extent else 1.0 for d in range(n_dims)]
        state = {}
        for first, node in nodes.items():
            if (first, 0) not in extent:  # nothing there
                node.dim, node.low, node.high, node.cut = 0, 0.0, 1.0, 0
                continue
            node.dim = max(range(n_dims), key=lambda d: ((extent[first, d].high - extent[first, d].low) / scale[d], -d))
            node.low, node.high = extent[first, node.dim].low, extent[first, node.dim].high
            weight = extent[first, 0].weight
            state[first] = {"prefix": 0, "bits": 0, "below": 0, "goal": weight * (node.shards // 2) / node.shards, "weight": weight}
        while state:
            sums: dict[int, dict[int, int]] = {}
            windows = {k: (s["prefix"], s["bits"]) for k, s in state.items()}
            for r in points.mapInArrow(histogram(root, n_dims, windows), "node int, bin int, weight long").groupBy("node", "bin").agg(F.sum("weight").alias("weight")).collect():
                sums.setdefault(r.node, {})[r.bin] = r.weight
            for first in list(state):
                s, below, at = state[first], state[first]["below"], 0
                for at in sorted(sums[first]):
                    if below + sums[first][at] >= s["goal"]:
                        break
                    below += sums[first][at]
                s["prefix"], s["bits"], s["below"] = s["prefix"] << BINS_LOG2 | at, s["bits"] + BINS_LOG2, below
                own = sums[first][at]
                if s["bits"] >= KEY_BITS or own <= exact * s["weight"]:
                    after = abs(below + own - s["goal"]) < abs(below - s["goal"])
                    nodes[first].cut = (s["prefix"] + after) << (KEY_BITS - s["bits"])
                    del state[first]
        for node in nodes.values():
            half = node.shards // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)


def shard_of(root: Node, n_dims: int):
    @F.pandas_udf(T.IntegerType())
    def assign(dims: pd.DataFrame, tie: pd.Series) -> pd.Series:
        out = np.zeros(len(tie), np.int32)
        for node, rows in leaves(root, dims.to_numpy(np.float64), tie.to_numpy()):
            out[rows] = node.first
        return pd.Series(out)

    return assign


def kd_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_slot_group: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; shards are nearly equal in bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    points = require(docs, [id_col, text_col]).toDF("doc_id", "text").select(
        "doc_id", (size + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.log1p(size.cast("double")).alias("d0"),  # length
        (size / F.greatest(F.char_length(text), F.lit(1))).alias("d1"),  # bytes per character: the script
        ((F.char_length(text) - F.char_length(F.translate(text, " \n\t", ""))) / F.greatest(F.char_length(text), F.lit(1))).alias("d2"),  # white space
        F.pmod(F.xxhash64(text), F.lit(1 << HASH_BITS)).alias("tie"),
    )
    with Scratch(docs.sparkSession) as scratch:
        points = scratch.save(points)
        root = grow(points.select("d0", "d1", "d2", "tie", "size"), 3, shards)
        groups = max(1, points.count() // (shards * rows_per_slot_group), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
        placed = points.withColumn("shard", shard_of(root, 3)(F.struct("d0", "d1", "d2"), "tie")).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)))
        return checkpointed(
            slotted(scratch.save(placed)).select(
                F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
            )
        )


def slotted(placed: DataFrame) -> DataFrame:
    """Gapless numbers in each shard: numbers within a part of it, after the counts of the parts before."""
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return (
        placed.withColumn("number", numbers).join(counts.select("shard", "part", before.alias("before")), ["shard", "part"])
        .withColumn("slot", (F.col("before") + F.col("number") - 1).cast("long"))
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
