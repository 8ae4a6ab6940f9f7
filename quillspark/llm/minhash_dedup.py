"""MinHash near-deduplication with sequential Bayesian verification.

1. One Arrow pass hashes words and shingles of whole texts with numpy and keeps a digest of the shingle set, a MinHash
   signature and its band keys. Rows with the same set fold into a class by a map-side minimum, so copies cost nothing.
2. Band buckets: every member is paired with two leaders, never with all others. A large bucket is dealt into parts of
   some `fan` members that have leaders of their own, which are paired with the bucket's, so no leader is hot.
3. Verification reads signatures batch by batch and drops a pair as soon as the posterior probability of a similarity
   at or above the threshold is below `miss` (uniform prior, binomial matches); survivors are compared on full sets.
4. Links give components. A bucket that is one component by now needs nothing. Where several are left, the texts
   outside a bucket's main component are compared with all texts around it, in blocks of bounded rows and bytes that
   return only links which unite components: no link between components is lost, and no pairs are emitted.

Classes have numbers of their own in all of this, so ids may repeat with other texts or be null.

Defined results: a null text counts as empty; texts without words have an empty set and stay alone; fewer words than
`width` make one shingle of all of them; the smallest id of a component stays; rows repeated with id and text share one
fate; a null id counts only where a component has no other, and is kept there; extra columns are ignored; empty tables
give empty results. Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, checkpointed, connected_components, require, text_key
from quillspark.llm.kernels import Hasher, mix, text_chunks

BANDS, ROWS, BATCH = 32, 5, 32
SPACES = np.array([0x20, 9, 10, 11, 12, 13], np.uint8)
WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(UPPER_TO_LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


@lru_cache(4)
def fewest_matches(threshold: float, miss: float, total: int, batch: int) -> list[tuple[int, int]]:
    """For each number n of compared values: the fewest matches m with P(similarity >= threshold | m of n) >= miss."""
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            # Beta(m + 1, n - m + 1) above the threshold, as a binomial sum
            above = sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if above >= miss:
                out.append((n, m))
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Of pairs of signatures (rows), which pass every batch; a pair that fails one isn't read further."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds:
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        alive, at = alive[matches[alive] >= least], n
    return alive


def signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(0)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        blank = np.zeros(256, bool)
        blank[SPACES] = True
        n_hashes = BANDS * ROWS
        a = mix(np.arange(1, n_hashes + 1, dtype=np.uint64)) | np.uint64(1)
        b = mix(np.arange(1, n_hashes + 1, dtype=np.uint64) + np.uint64(1 << 40))
        band_salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(1 << 41))
        weights = mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(1 << 42)) | np.uint64(1)
        for batch in batches:
            for own, data, offsets in text_chunks(batch):
                data = lower[data]
                hasher.load(data)
                edge = np.diff(np.concatenate([[True], blank[data], [True]]).astype(np.int8))
                starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                words = mix(hasher.spans(starts, ends))
                first = np.searchsorted(starts, offsets)
                rows = []
                for k, (i, text_key) in enumerate(own):
                    w = words[first[k] : first[k + 1]]
                    if not len(w):
                        rows.append((i, text_key, 0, b"", b"", []))
                        continue
                    n = min(width, len(w))
                    h = sum(w[j : len(w) - n + 1 + j] * weights[j] for j in range(n)) + np.uint64(n)
                    h = np.unique(mix(h))
                    sig = np.full(n_hashes, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(h), 2048):
                        np.minimum(sig, (h[at : at + 2048, None] * a + b).min(axis=0), out=sig)
                    sig >>= np.uint64(16)
                    keys = np.zeros(BANDS, np.uint64) + band_salt
                    for r in range(ROWS):
                        keys = mix(keys + sig.reshape(BANDS, ROWS)[:, r])
                    rows.append((i, text_key, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), sig.astype(np.uint16).tobytes(), keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary()),
                        pa.array([r[5] for r in rows], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_digest", "sig", "bands"],
                )

    return sign


def verifier(width: int, percent: int, miss: float):
    """Rows (a, sig_a, text_a, b, sig_b, text_b) -> the (a, b) whose full sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = fewest_matches(percent / 100, miss, BANDS * ROWS, BATCH)
        kept: dict[int, set] = {}

        def full(i: int, text: str) -> set:
            if i not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[i] = shingle_set(text, width)
            return kept[i]

        for batch in batches:
            if not batch.num_rows:
                continue
            sig_a, sig_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (1, 4))
            found_a, found_b = [], []
            ids_a, text_a, ids_b, text_b = batch.column(0), batch.column(2), batch.column(3), batch.column(5)
            for k in surviving(sig_a, sig_b, bounds):
                a, b = ids_a[k].as_py(), ids_b[k].as_py()
                x, y = full(a, text_a[k].as_py()), full(b, text_b[k].as_py())
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return verify


def crosser(width: int, percent: int, miss: float):
    """A block of strays and a block of texts around the same component -> links that unite components.

    Pairs of one component, also of one united here, need no comparison; the others are verified as above.
    """

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds = fewest_matches(percent / 100, miss, BANDS * ROWS, BATCH)
        strays, around = pdf[pdf.stray].sort_values("node"), pdf[~pdf.stray].sort_values("node")
        found: list[tuple[int, int]] = []
        if len(strays) and len(around):
            sig_l, sig_r = (np.frombuffer(b"".join(x.sig), np.uint16).reshape(len(x), -1) for x in (strays, around))
            names, comp = np.unique(np.concatenate([strays.component, around.component]), return_inverse=True)
            comp_l, comp_r = comp[: len(strays)], comp[len(strays) :]
            ids_r, texts_r = around.node.to_numpy(), around.text.to_numpy()
            root, sets = np.arange(len(names)), {}
            for k, (i, text) in enumerate(zip(strays.node, strays.text, strict=True)):
                own, at = None, np.flatnonzero(root[comp_r] != root[comp_l[k]])
                for j in at[surviving(np.broadcast_to(sig_l[k], (len(at), sig_l.shape[1])), sig_r[at], bounds)]:
                    if root[comp_r[j]] == root[comp_l[k]]:
                        continue
                    own = own or shingle_set(text, width)
                    other = sets.get(j) or sets.setdefault(j, shingle_set(texts_r[j], width))
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((min(i, ids_r[j]), max(i, ids_r[j])))
                        root[root == root[comp_r[j]]] = root[comp_l[k]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cross


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-4,
    fan: int = 256, block: int = 256, block_bytes: int = 4 << 20,
) -> DataFrame:
    """id, n_shingles, component_id, kept and text_key (xxhash64 of the text) of every row.

    Links are where 100 * intersection >= percent * union.
    """
    spark: SparkSession = docs.sparkSession
    texts = require(docs, [id_col, text_col]).toDF("doc_id", "text").select("doc_id", text_key("text").alias("text_key"), "text")
    with Scratch(spark) as scratch:
        signed = scratch.save(texts.mapInArrow(signer(width), "doc_id long, text_key long, n_shingles long, set_digest binary, sig binary, bands array<long>"))
        classes = scratch.save(
            signed.where("n_shingles > 0").groupBy("set_digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key", "sig", "bands")).alias("m"))
            .select(F.monotonically_increasing_id().alias("node"), "set_digest", "first_id", "m.*")
        )
        members = scratch.save(classes.select("node", F.explode("bands").alias("key")))
        sizes = scratch.save(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        met = scratch.save(
            members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.ceil(F.col("size") / fan)).cast("int"))
        )
        order = F.struct(F.xxhash64(F.lit(7), "node"), "node")
        parts = scratch.save(met.groupBy("key", "part").agg(F.min("node").alias("first"), F.min(order).alias("other")).select("key", "part", "first", F.col("other.node").alias("other")))
        order = F.struct(F.xxhash64(F.lit(7), "other"), "other")
        tops = parts.groupBy("key").agg(F.min("first").alias("top"), F.min(order)["other"].alias("top_other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        led = met.join(parts, ["key", "part"]).select("node", F.explode(F.array("first", "other")).alias("leader"))
        leaders = parts.join(tops, "key").select(F.explode(F.array("first", "other")).alias("node"), "top", "top_other").select("node", F.explode(F.array("top", "top_other")).alias("leader"))
        pairs = led.unionByName(leaders).where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        # a row is found again by its id (nulls apart) and its text
        key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id0"), F.col("text_key")]
        wanted = classes.join(met.select("node").distinct(), "node", "left_semi").select("node", "sig", *key)
        sides = scratch.save(texts.select(*key, "text").join(wanted, ["id0", "text_key"]).dropDuplicates(["id0", "text_key"]).select("node", "sig", "text"))

        def verified(candidates: DataFrame) -> DataFrame:
            a, b = (sides.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
            rows = candidates.join(b, "b").join(a, "a").select("a", "sig_a", "text_a", "b", "sig_b", "text_b")
            return scratch.save(rows.mapInArrow(verifier(width, percent, miss), "a long, b long"))

        links = verified(pairs)
        united = scratch.save(connected_components(scratch, links))
        # buckets of three or more that still hold several components: around the main component of each such bucket,
        # every text of another component is compared with all texts that share a bucket with it
        placed = scratch.save(
            met.where("size > 2").select("key", "node").join(united, "node", "left")
            .select("key", "node", F.coalesce("component", "node").alias("component"))
        )
        shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        main = shares.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main")).where("parts > 1").select("key", "main")
        roles = scratch.save(
            placed.join(scratch.save(main), "key").groupBy("main", "node").agg(F.first("component").alias("component"))
            .withColumn("stray", F.col("component") != F.col("main"))
        )
        if not roles.isEmpty():
            full = scratch.save(roles.join(sides, "node"))
            size = F.octet_length("text").cast("long")

            def cuts(n: Column, size: Column) -> Column:
                return F.greatest(F.ceil(n / block), F.ceil(F.coalesce(size, F.lit(0)) / block_bytes)).cast("int")

            blocks = full.groupBy("main").agg(
                cuts(F.count_if("stray"), F.sum(F.when(F.col("stray"), size))).alias("rows"), cuts(F.count(F.lit(1)), F.sum(size)).alias("columns")
            )
            full = full.join(scratch.save(blocks), "main")
            hashed, zero = F.xxhash64("node"), F.lit(0)
            names = ["main", "node", "component", "sig", "text"]
            as_stray = full.where("stray").select(*names, F.lit(True).alias("stray"), F.pmod(hashed, "rows").cast("int").alias("i"), F.explode(F.sequence(zero, F.col("columns") - 1)).alias("j"))
            as_other = full.where("rows > 0").select(*names, F.lit(False).alias("stray"), F.pmod(hashed, "columns").cast("int").alias("j"), F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"))
            more = scratch.save(as_stray.unionByName(as_other).groupBy("main", "i", "j").applyInPandas(crosser(width, percent, miss), "a long, b long"))
            united = scratch.save(connected_components(scratch, links.unionByName(more)))
        named = classes.select("set_digest", "first_id", "node").join(united, "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        found = scratch.save(named.join(smallest, "component").select("set_digest", "component_id"))
        alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        out = signed.select("doc_id", "n_shingles", "set_digest", "text_key").join(found, "set_digest", "left").select(
            F.col("doc_id").alias(id_col), "n_shingles", alone.alias("component_id"), F.col("doc_id").eqNullSafe(alone).alias("kept"), "text_key"
        )
        return checkpointed(out)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
