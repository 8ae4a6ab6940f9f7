"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Texts become token ids in one Arrow pass that keeps only the pieces' places and checksums. Full pieces are sequences
by themselves; the others are dealt by a hash of their numbers into groups of some `group_rows` pieces, and each packs its own
(Csirik et al., 2006): every piece, longest first, goes where the sum of the squared counts of open bins per residual
gap becomes smallest, and no more bins are opened than could hold the group while an open one fits. Then the emptiest
bins are taken apart and their pieces placed by best fit, for as long as that saves bins. A group's rows are bounded by
its parameter, so tasks don't grow with the input, and each group leaves one bin unfilled, as a rule.

Defined results: a null or empty text is the closing token alone; only documents of more than `size` tokens are cut,
and their first piece is the shorter one; repeated rows are packed each; other columns are ignored; an empty table
gives no pieces. Very long texts are tokenised whole.
"""

from __future__ import annotations

import bisect
import json
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, checkpointed, require
from quillspark.llm.kernels import rows_of

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def worker_cache() -> dict:
    """Lives as long as a Python worker, which serves many tasks."""
    return sys.modules.setdefault("quillspark_worker_cache", types.ModuleType("quillspark_worker_cache")).__dict__


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


def encoder(vocabulary: str):
    """text -> ids as the tokenizers library gives them for this vocabulary file (its content).

    Ids of a byte-level BPE vocabulary are ranks, so tiktoken's faster merge loop gives the same ids; texts that hold
    one of the added special strings go to tokenizers itself.
    """
    cache = worker_cache()
    key = ("bpe", zlib.crc32(vocabulary.encode()))
    if key not in cache:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        model = json.loads(vocabulary)
        special = [x["content"] for x in model.get("added_tokens", [])]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        merger = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        library = Tokenizer.from_str(vocabulary)
        cache[key] = merger.encode_ordinary, lambda t: library.encode(t, add_special_tokens=False).ids, special
    fast, slow, special = cache[key]
    return lambda text: slow(text) if any(s in text for s in special) else fast(text)


def tokenised(vocabulary: str, size: int, closing: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for i, text in rows_of(batch):
                ids = np.array([*encode(text or ""), closing], "<u4")
                end = len(ids) - (len(ids) - 1) // size * size
                start = piece = 0
                while start < len(ids):
                    rows.append((i, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + size, piece + 1
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), r, strict=True)) for r in rows],
                pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]),
            )

    return emit


def sum_of_squares(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item, in the order given.

    The rule may open bins up to the fewest that could hold all items; then only an item that fits nowhere opens one.
    Of equal changes the tightest gap counts.
    """
    fewest = -(-int(lengths.sum()) // size)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    bins, used = np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths):
        # taking a bin from gap g to gap g - s changes the sum by 2 * (count[g - s] - count[g] + 1)
        change = 2 * (count[: size - s + 1] - count[s:] + 1)
        change[0] -= 2 * count[0] + 1  # a full bin doesn't count
        change[count[s:] == 0] = never
        change[size - s] = 2 * count[size - s] + 1 if used < fewest else never
        at = int(np.argmin(change))
        g = at + s if change[at] != never else size
        if g == size:
            b, used = used, used + 1
        else:
            b = open_at[g].pop()
            count[g] -= 1
        bins[k] = b
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
    return bins


def best_fit(lengths: np.ndarray, items: np.ndarray, gaps: list[tuple[int, int]], size: int, first: int) -> dict[int, int]:
    """item -> bin, longest first, each into the smallest gap that takes it; gaps: (gap, bin), new bins from `first`."""
    gaps, out = sorted(gaps), {}
    for k in sorted(items.tolist(), key=lambda k: (-lengths[k], k)):
        s = int(lengths[k])
        at = bisect.bisect_left(gaps, (s, -1))
        gap, b = gaps.pop(at) if at < len(gaps) else (size, first)
        first += b == first
        out[k] = b
        bisect.insort(gaps, (gap - s, b))
    return out


def dissolved(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """The bins with the emptiest of them taken apart, ever more, for as long as that may save a bin.

    At the end all have been, so there are never more bins than best fit decreasing needs.
    """
    fewest, take = -(-int(lengths.sum()) // size), 4
    while (n := int(bins.max(initial=-1)) + 1) > fewest:
        gap = size - np.bincount(bins, lengths, n).astype(np.int64)
        order = np.lexsort((np.arange(n), -gap))
        open_bins = order[:take]
        place = np.full(n, -1)
        place[order[take:]] = np.arange(n - len(open_bins))
        new = place[bins]
        items = np.flatnonzero(np.isin(bins, open_bins))
        kept = [(int(gap[b]), int(place[b])) for b in order[take:]]
        for k, b in best_fit(lengths, items, kept, size, n - len(open_bins)).items():
            new[k] = b
        if new.max() + 1 < n:
            bins, take = new, 4
        elif take >= n:
            break
        else:
            take *= 4
    return bins


def offsets_in(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where each item begins in its bin, in the order given."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    out = np.zeros(len(lengths), np.int64)
    out[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return out


def packer(size: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "nameless", "doc_id", "piece", "number"], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = pdf.length.to_numpy()
        bins = dissolved(lengths, sum_of_squares(lengths, size), size)
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "nameless"]].assign(sequence_id=(pdf.part.to_numpy() << 32) + bins, offset=offsets_in(lengths, bins))

    return pack


def pack_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, closing: int = 0, group_rows: int = 50_000
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        pieces = require(docs, [id_col, text_col]).mapInArrow(tokenised(vocabulary, size, closing), PIECE)
        pieces = scratch.save(pieces.withColumn("number", F.monotonically_increasing_id()))
        short = pieces.where(F.col("length") < size)
        groups = -(-short.count() // group_rows)
        out = pieces.where(F.col("length") == size).withColumns({"sequence_id": F.col("number") + F.lit(1 << 61), "offset": F.lit(0).cast("long")}).drop("number")
        # by the number of the row, which doesn't repeat as ids may
        dealt = short.withColumns({"part": F.pmod(F.xxhash64("number"), F.lit(max(1, groups))), "nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
        packed = dealt.groupBy("part").applyInPandas(packer(size), PIECE + ", nameless boolean, sequence_id long, offset long")
        packed = packed.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
        return checkpointed(out.unionByName(packed).withColumnRenamed("doc_id", id_col))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
