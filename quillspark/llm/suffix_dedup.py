"""Repeated byte windows by a depth-limited radix sort of suffixes, most significant digits first.

Suffixes only matter through their first `window` bytes, and only in groups of equals. The passes order them by ever
longer keys and never beyond that depth; what is alone in its group leaves, and the groups at full depth are exactly
the repeated windows. Two things differ from a sort of all suffixes byte by byte, which would shuffle some 14 times the
input: suffixes are sampled (one stands for a run of windows), and a digit is a hash of its bytes, since only equality
counts. Three digits are used (for 200 bytes: keys of 73, 185 and 200 bytes):

1. The windows of a text are bundled by their minimiser, the smallest hash among the short spans of a window. Equal
   windows choose it at the same place, so bundles with the same short span (the first digit) are the only places
   where equal windows can be. About one bundle for 64 bytes is shuffled, as hashes only.
2. A bundle whose whole bytes occur twice is repeated as a whole: its members leave at once, and one stays as a
   witness. Bundles whose first digit is unique leave too. The rest (edges of copies) is cut into narrower bundles
   whose common part, the next digit, is longer.
3. What then is open is compared window by window, at full depth.

Equality of whole bytes is judged by a 96-bit BLAKE2 digest of them. Groups are counted with a map-side combine; their
members meet the results in a join where a group of more than a thousandth of all rows (a thousand such at most) is
broadcast, so a passage in a third of all texts is never gathered in a task. Memory in a task follows a chunk of half a
MB: longer texts are read in overlapping segments, and what is collected belongs to one of these. Rows have numbers of
their own.

Defined results: a null text is empty; texts shorter than the window have no spans; ids may repeat or be null, each row
is judged by its own text; repeated rows are each other's copies; other columns are ignored; empty tables give empty
results. Texts of one repeated character are handled exactly, with a bundle for each byte.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Scratch, checkpointed, require, text_key
from quillspark.llm.kernels import CHUNK_BYTES, Hasher, mix, rows_of, window_min

PLACE_BITS = np.uint64(28)
NARROW = 16
DIGEST = 12


def bundle_width(window: int) -> int:
    return min(128, 1 << max(0, int(math.log2(window / 1.5))))


def bundles(data: np.ndarray, offsets: np.ndarray, window: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each bundle and the place of its minimiser, in the chunk."""
    width = bundle_width(window)
    short = window - width + 1
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(len(data) - short + 1)
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    keys = (mix(hasher.spans(at, at + short)) & ~mask) | at.astype(np.uint64)
    place = (window_min(keys, width)[:n] & mask).astype(np.int64)
    ends = np.repeat(offsets[1:] - 1, np.diff(offsets))[:n]
    valid = np.arange(n) + window <= ends
    place[~valid] = -1
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [n - 1]])
    real = place[first] >= 0
    return first[real], last[real], place[first][real]


def segments(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, z) -> chunks: the row and first byte of each segment, all bytes with a blank after each, the start offsets.

    Segments of one text overlap by a window less one byte, so each window lies in exactly one.
    """
    rows, starts, parts, offsets, size = [], [], [], [0], 0
    for row, z in rows_of(batch):
        raw = zstandard.decompress(z)
        for at in range(0, len(raw) - window + 1, CHUNK_BYTES):
            part = raw[at : at + CHUNK_BYTES + window - 1]
            if rows and size + len(part) > CHUNK_BYTES:
                yield np.array(rows), np.array(starts), np.frombuffer(b"".join(parts), np.uint8), np.array(offsets)
                rows, starts, parts, offsets, size = [], [], [], [0], 0
            rows.append(row)
            starts.append(at)
            parts += [part, b" "]
            size += len(part) + 1
            offsets.append(size)
    if rows:
        yield np.array(rows), np.array(starts), np.frombuffer(b"".join(parts), np.uint8), np.array(offsets)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    view, blake = memoryview(data), hashlib.blake2b
    return pa.array([blake(view[a:b], digest_size=DIGEST).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())


def first_digit(window: int):
    """A bundle is coded as its first byte << 16 | number of further windows << 8 | place of the minimiser in it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, short = Hasher(0), window - bundle_width(window) + 1
        for batch in batches:
            for rows, starts, data, offsets in segments(batch, window):
                hasher.load(data)
                first, last, place = bundles(data, offsets, window, hasher)
                at = np.searchsorted(offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hasher.spans(place, place + short).view(np.int64)), digests(data, first, last + window),
                        pa.array(rows[at]), pa.array(((first - offsets[at] + starts[at]) << 16) | ((last - first) << 8) | (place - first)),
                    ],
                    names=["key", "whole", "row", "bundle"],
                )

    return emit


def pieces(window: int):
    """(row, z) -> (row, part, z): the segments of each text, which overlap as in `segments`."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row, z in rows_of(batch):
                raw = zstandard.decompress(z)
                for part, at in enumerate(range(0, len(raw) - window + 1, CHUNK_BYTES)):
                    own = z if len(raw) <= CHUNK_BYTES else squeezer.compress(raw[at : at + CHUNK_BYTES + window - 1])
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.int64()), pa.array([own], pa.binary())], names=["row", "part", "z"])

    return emit


def contexts(window: int):
    """(row, part, z, bundles, settled) -> the bytes that each bundle's windows cover."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> pa.RecordBatch:
            columns = [pa.array(rows, pa.int64()), pa.array(codes, pa.int64()), pa.array(flags, pa.bool_()), pa.array(out, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["row", "bundle", "settled", "bytes"])

        for batch in batches:
            rows, codes, flags, out = [], [], [], []
            for row, part, z, wanted, settled in rows_of(batch):
                raw = zstandard.decompress(z)
                for code, flag in zip(wanted, settled, strict=True):
                    start, more = (code >> 16) - part * CHUNK_BYTES, (code >> 8) & 255
                    rows.append(row)
                    codes.append(code)
                    flags.append(flag)
                    out.append(raw[start : start + more + window])
                    if len(rows) >= 4096:
                        yield full()
                        rows, codes, flags, out = [], [], [], []
            yield full()

    return emit


def next_digit(window: int, narrow: int):
    """Bundles with their bytes -> bundles of at most `narrow` windows, aligned to the minimiser; narrow 1: windows.

    The key is the part that all windows of a place have in common (at narrow 1: the window), whole is all they cover.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(0)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(at, 2048)
                texts = batch.column(3).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                base = np.concatenate([[0], np.cumsum([len(r) for r in texts])])[:-1]
                code = batch.column(1).to_numpy()
                start, more, low = code >> 16, (code >> 8) & 255, -(code & 255)
                hasher.load(data)
                # windows from low to low + more relative to the minimiser, cut at multiples of narrow
                a, b = low // narrow, (low + more) // narrow
                count = b - a + 1
                row = np.repeat(np.arange(len(texts)), count)
                cell = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                left = np.maximum(cell * narrow, low[row])
                right = np.minimum(cell * narrow + narrow - 1, (low + more)[row])
                zero = base[row] - low[row]  # where the minimiser is in data
                key = hasher.spans(zero + cell * narrow + narrow - 1, zero + cell * narrow + window)
                key = mix(key + mix((cell + 512).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), digests(data, zero + left, zero + right + window), pa.array(batch.column(0).to_numpy()[row]),
                        pa.array(((start[row] + left - low[row]) << 16) | ((right - left) << 8) | -left),
                        pa.array(code[row]), pa.array(batch.column(2).to_numpy(zero_copy_only=False)[row]),
                    ],
                    names=["key", "whole", "row", "bundle", "parent", "settled"],
                )

    return emit


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames: they are shuffled twice."""
    squeezer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [squeezer.compress((t or "").encode("utf-8", "surrogatepass")) for (t,) in rows_of(batch.select([3]))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["row", "doc_id", "text_key", "z"])


def members(rows: DataFrame, groups: DataFrame, by: list[str], size: str, total: int) -> DataFrame:
    """The rows whose group is among `groups`, which says how large each is: large groups are broadcast, not gathered."""
    large = F.col(size) > max(64, total // 1000)
    hot = F.broadcast(groups.where(large).select(*by))
    cold = rows.join(hot, by, "left_anti").join(groups.where(~large).select(*by), by, "left_semi")
    return cold.select(*rows.columns).unionByName(rows.join(hot, by, "left_semi").select(*rows.columns))


def radix_pass(scratch: Scratch, rows: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """rows: key, whole, row, bundle, parent, settled -> (bundles that are repeated as a whole, bundles that go on).

    Equal bundles go on as one: settled if it has copies. Keys with one bundle, or with settled ones only, are done.
    """
    total = rows.count()
    groups = scratch.save(
        rows.groupBy("key", "whole").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "parent", "bundle")).alias("one"), F.min("settled").alias("settled")
        )
    )
    at = scratch.n
    repeated = scratch.save(members(rows.where(~F.col("settled")), groups.where("copies > 1"), ["key", "whole"], "copies", total).select("row", "bundle"))
    if last:
        return repeated, None
    pending = ~(F.col("settled") | (F.col("copies") > 1))
    open_keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(pending).alias("pending")).where("kinds > 1 AND pending").select("key", "kinds")
    going = scratch.save(members(groups, open_keys, ["key"], "kinds", total).select("one.*", (~pending).alias("settled")))
    scratch.drop(at)
    return repeated, going


def compressed(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number), doc_id, text_key and z of each row, written once."""
    texts = require(docs, [id_col, text_col]).toDF("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key("text").alias("text_key"), "text")
    return scratch.save(texts.mapInArrow(squeeze, "row long, doc_id long, text_key long, z binary"))


def repeated_spans(scratch: Scratch, texts: DataFrame, window: int) -> DataFrame:
    """row and spans of each row of `compressed` that has any: sorted, disjoint [start, end) pairs in a flat array."""
    first = scratch.save(texts.select("row", "z").mapInArrow(first_digit(window), "key long, whole binary, row long, bundle long"))
    at = scratch.n
    shared = scratch.save(first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = scratch.save(members(first, shared, ["key"], "n", first.count()).withColumns({"parent": F.col("bundle"), "settled": F.lit(False)}))
    for number in (at, at + 1):
        scratch.drop(number)
    at = scratch.n
    found, going = radix_pass(scratch, rows)
    scratch.drop(at)
    # what is collected belongs to a segment of a text
    part = F.floor(F.shiftright("bundle", 16) / CHUNK_BYTES).alias("part")
    per_part = going.groupBy("row", part).agg(F.collect_list("bundle").alias("bundles"), F.collect_list("settled").alias("settled"))
    parts = texts.select("row", "z").mapInArrow(pieces(window), "row long, part long, z binary").join(per_part, ["row", "part"])
    wide = scratch.save(parts.select("row", "part", "z", "bundles", "settled").mapInArrow(contexts(window), "row long, bundle long, settled boolean, bytes binary"))
    schema = "key long, whole binary, row long, bundle long, parent long, settled boolean"
    cut = scratch.save(wide.mapInArrow(next_digit(window, NARROW), schema))
    at = scratch.n
    narrow, going = radix_pass(scratch, cut)
    scratch.drop(at)
    parts = going.groupBy("row", "parent").agg(F.collect_list(F.struct("bundle", "settled")).alias("parts"))
    last = scratch.save(
        wide.drop("settled").withColumnRenamed("bundle", "parent").join(parts, ["row", "parent"])
        .select("row", "parent", "bytes", F.explode("parts").alias("part"))
        .select(
            "row", F.col("part.bundle").alias("bundle"), F.col("part.settled").alias("settled"),
            F.expr(f"substring(bytes, CAST((part.bundle >> 16) - (parent >> 16) + 1 AS INT), CAST(((part.bundle >> 8) & 255) + {window} AS INT))").alias("bytes"),
        )
    )
    single, _ = radix_pass(scratch, scratch.save(last.mapInArrow(next_digit(window, 1), schema)), last=True)
    start = F.shiftright("bundle", 16)
    every = found.unionByName(narrow).unionByName(single).select("row", start.alias("start"), (start + F.shiftright("bundle", 8).bitwiseAND(F.lit(255)) + window).alias("end"))
    # first within segments, where a text of few letters has many, then the few that are left of a text
    spans = every.groupBy("row", F.floor(F.col("start") / CHUNK_BYTES).alias("part")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    spans = spans.select("row", merged(F.col("s.start"), F.col("s.end")).alias("spans"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)), lambda k: F.struct(F.get("spans", k).alias("start"), F.get("spans", k + 1).alias("end")))
    spans = spans.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("s"))
    return spans.select("row", merged(F.col("s.start"), F.col("s.end")).alias("spans"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def merged(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Sorted by start: overlapping and touching spans become one."""

    def one(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        reach = np.maximum.accumulate(end)
        new = np.concatenate([[True], start[1:] > reach[:-1]])
        return np.stack([start[new], reach[np.concatenate([new[1:], [True]])]], axis=1).ravel()

    return pd.Series([one(np.asarray(s), np.asarray(e)) for s, e in zip(starts, ends, strict=True)])


def kept_bytes(raw: bytes, spans) -> bytes:
    if spans is None or not len(spans):
        return raw
    edges = [0, *spans, len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


@F.pandas_udf(T.StringType())
def without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without its spans; a character that a span cuts goes with it."""
    return pd.Series([None if t is None else kept_bytes(t.encode("utf-8", "surrogatepass"), s).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)])


@F.pandas_udf(T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string"))
def summary(z: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for x, s in zip(z, spans, strict=True):
        raw = zstandard.decompress(x)
        kept = kept_bytes(raw, s)
        out.append((len(raw), len(raw) - len(kept), 0 if s is None else len(s) // 2, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """The rows with their texts cut; all columns stay."""
    with Scratch(docs.sparkSession) as scratch:
        texts = compressed(scratch, docs, id_col, text_col)
        # a row is found again by its id (nulls apart) and its text; rows with the same have the same spans
        key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("text_key").alias("__text")]
        spans = texts.select("row", *key).join(repeated_spans(scratch, texts, window), "row").groupBy("__id", "__text").agg(F.first("spans").alias("__spans"))
        rows = docs.withColumns({"__id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))), "__text": text_key(f"`{text_col}`")})
        joined = rows.join(checkpointed(spans), ["__id", "__text"], "left")
        return joined.withColumn(text_col, without_spans(F.col(f"`{text_col}`"), F.col("__spans"))).select(*docs.columns)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    with Scratch(docs.sparkSession) as scratch:
        texts = compressed(scratch, docs, id_col, text_col)
        spans = repeated_spans(scratch, texts, window)
        joined = texts.select("row", "doc_id", "z").join(spans, "row", "left")
        return checkpointed(joined.select(F.col("doc_id").alias(id_col), summary("z", "spans").alias("r")).select(id_col, "r.*"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
