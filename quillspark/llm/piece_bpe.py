"""SentencePiece BPE: merge rounds over flat symbol arrays of distinct words.

Spark cuts each text where a space is followed by something else; with the space written as U+2581, no piece of the
vocabulary reaches over such a cut. The distinct words of a block of texts become flat numpy arrays of symbols, cut
further between two characters that stand side by side in no piece, and are merged in rounds: every word finds the
smallest rank among its adjacent pairs (a segmented minimum), joins the leftmost pair of that rank, and the arrays are
compacted; words without a pair leave. One pair a word and round, since a join may open a better pair beside it. Runs of
more than `longest` symbols, where a join in each round would cost its square, are merged by the same rule with a heap.

Characters outside the vocabulary become the pieces of their bytes. Decoding concatenates the pieces of the ids, with
spaces for U+2581 and without the first one.

Words are distinct per block of texts (some 4 MB, or one longer text), so nothing is shuffled, and memory follows the
block. Models of another kind than BPE with the identity as normalisation, byte pieces and no pieces of the user's own
are refused.

Defined results: a null or empty text has no tokens; repeated rows are encoded each, null ids stay null; other columns
are ignored; an empty table gives no rows; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.byte_bpe import Spread, cut_blocks
from quillspark.llm.common import require

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
UNKNOWN_TEXT = " ⁇ "
BROKEN = "�"


class Model:
    """Pieces, ranks and kinds of a model file, by id. Equal scores have equal ranks."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        self.pieces, self.kinds = [p.piece for p in proto.pieces], [p.type for p in proto.pieces]
        known = trained.model_type == trained.BPE and trained.byte_fallback and set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not trained.treat_whitespace_as_suffix
        if not known or not plain or not norm.add_dummy_prefix or any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("only BPE models with byte pieces, no normalisation and no pieces across words are served")
        _, self.ranks = np.unique([-p.score for p in proto.pieces], return_inverse=True)
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]


class Tables:
    """What a task looks up. Symbols are ids of pieces, then `codes` plus the code point of any other character."""

    def __init__(self, model: Model):
        pieces = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        self.codes = len(model.pieces)
        self.char = np.arange(0x110000, dtype=np.int64) + self.codes
        for p, i in pieces.items():
            if len(p) == 1:
                self.char[ord(p)] = i

        def symbol(part: str) -> int | None:
            return pieces.get(part, int(self.char[ord(part)]) if len(part) == 1 else None)

        found = sorted(
            (a << 32 | b, i) for p, i in pieces.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None
        )
        self.keys = np.array([k for k, _ in found] + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([i for _, i in found] + [-1], np.int64)
        self.none = int(model.ranks.max()) + 1
        self.rank = np.append(model.ranks[self.joined[:-1]], self.none)
        beside = {ord(x) << 32 | ord(y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
        self.beside = np.array([*sorted(beside), np.iinfo(np.int64).max], np.int64)
        self.byte_ids, self._table = np.array(model.byte_ids, np.int64), None

    def table(self) -> dict[int, tuple[int, int]]:
        """Rank and piece of each pair, for runs merged one by one."""
        if self._table is None:
            self._table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.joined.tolist(), strict=True), strict=True))
        return self._table

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the tables; the last one for pairs that make no piece."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two characters stand side by side in no piece."""
        key = x << 32 | y
        return self.beside[np.searchsorted(self.beside, key)] != key


def merge_run(symbols: list[int], tables: Tables) -> list[int]:
    """The merges of one run over a linked list with a heap of pairs."""
    n = len(symbols)
    own, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    at = tables.pairs(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
    heap = [(int(tables.rank[p]), k, symbols[k], symbols[k + 1], int(tables.joined[p])) for k, p in enumerate(at.tolist()) if tables.rank[p] < tables.none]
    heapq.heapify(heap)
    while heap:
        _, k, a, b, token = heapq.heappop(heap)
        j = after[k]
        if own[k] != a or j < 0 or own[j] != b:
            continue
        own[k], own[j], after[k] = token, -1, after[j]
        if after[k] >= 0:
            before[after[k]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right >= 0 and (hit := tables.table().get(own[left] << 32 | own[right])):
                heapq.heappush(heap, (hit[0], left, own[left], own[right], hit[1]))
    return [s for s in own if s >= 0]


def merge_rounds(run: np.ndarray, symbol: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The merged symbols with the run of each; runs are numbered in order, each in a stretch."""
    pair = np.full(len(run), len(tables.keys) - 1)
    same = np.flatnonzero(run[1:] == run[:-1])
    pair[same] = tables.pairs(symbol[same], symbol[same + 1])
    done = [(run[:0], symbol[:0])]
    while len(run):
        begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        rank = tables.rank[pair]
        least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(run))))
        live = least < tables.none
        if not live.all():
            done.append((run[~live], symbol[~live]))
            run, symbol, pair, rank, least = run[live], symbol[live], pair[live], rank[live], least[live]
            if not len(run):
                break
        at = np.flatnonzero(rank == least)
        at = at[np.concatenate([[True], run[at][1:] != run[at][:-1]])]
        symbol[at] = tables.joined[pair[at]]
        keep = np.ones(len(run), bool)
        keep[at + 1] = False
        run, symbol, pair = run[keep], symbol[keep], pair[keep]
        now = at - np.arange(len(at))  # each earlier run has lost one symbol
        pair[now] = len(tables.keys) - 1
        left = now[(now + 1 < len(run)) & (run[np.minimum(now + 1, len(run) - 1)] == run[now])]
        pair[left] = tables.pairs(symbol[left], symbol[left + 1])
        right = now[(now > 0) & (run[now - 1] == run[now])]
        pair[right - 1] = tables.pairs(symbol[right - 1], symbol[right])
    run, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(run, kind="stable")
    return run[order], symbol[order]


def merge_words(data: bytes, lengths: np.ndarray, tables: Tables, longest: int) -> Spread:
    """Ids of each word; data: their UTF-8 bytes in a row, lengths: bytes of each."""
    raw = np.frombuffer(data, np.uint8)
    code = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)[(raw & 0xC0) != 0x80]
    cut = np.concatenate([[True], (word[1:] != word[:-1]) | tables.apart(code[:-1], code[1:])])[: len(word)]
    run, symbol = np.cumsum(cut) - 1, tables.char[code]
    of_run = word[cut]
    sizes = np.bincount(run, minlength=len(of_run)) if len(run) else np.zeros(0, np.int64)
    long_runs = np.flatnonzero(sizes > longest)
    starts = np.cumsum(sizes) - sizes
    parts = [merge_rounds(run[short := ~np.isin(run, long_runs)], symbol[short], tables)] if len(long_runs) else [merge_rounds(run, symbol, tables)]
    for k in long_runs.tolist():
        own = np.array(merge_run(symbol[starts[k] : starts[k] + sizes[k]].tolist(), tables), np.int64)
        parts.append((np.full(len(own), k), own))
    run, symbol = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(long_runs):
        order = np.argsort(run, kind="stable")
        run, symbol = run[order], symbol[order]
    word = of_run[run]
    unknown = symbol >= tables.codes
    if unknown.any():
        kinds, which = np.unique(symbol[unknown], return_inverse=True)
        spelt = [tables.byte_ids[list(chr(c - tables.codes).encode("utf-8", "surrogatepass"))] for c in kinds.tolist()]
        bytes_of = Spread(np.concatenate(spelt), np.array([len(s) for s in spelt]))
        lists, counts = bytes_of.of(which)[0], np.ones(len(symbol), np.int64)
        counts[unknown] = bytes_of.counts[which]
        word, wide = np.repeat(word, counts), np.repeat(unknown, counts)
        symbol = np.repeat(symbol, counts)
        symbol[wide] = lists
    return Spread(symbol, np.bincount(word, minlength=len(lengths)))


def pieces_bytes(model: Model) -> list[bytes]:
    """What each id adds to a decoded text."""
    out = [p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, k in zip(model.pieces, model.kinds, strict=True)]
    for b, i in enumerate(model.byte_ids):
        out[i] = bytes([b])
    return out


def decoded(ids: list[int], model: Model) -> str:
    """The text of any list of ids: broken bytes become U+FFFD each, one space at the begin goes."""
    out, raw, first, spaced = [], bytearray(), True, False
    value = {i: b for b, i in enumerate(model.byte_ids)}

    def flush() -> None:
        at = 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at : at + n]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(BROKEN)
                n = 1
            at += n
        raw.clear()

    for i in ids:
        if i in value:
            raw.append(value[i])
            continue
        flush()
        first = first and not spaced and not any(out)
        piece = model.pieces[i]
        if model.kinds[i] == CONTROL:
            spaced = False
        elif model.kinds[i] == UNKNOWN:
            out.append(UNKNOWN_TEXT)
        else:
            spaced = first and piece.startswith(SPACE)
            out.append(piece[spaced:].replace(SPACE, " "))
    flush()
    return "".join(out)


def results(ids: pa.Array, sizes: np.ndarray, places: np.ndarray, words: Spread, decimal: Spread, pieces: Spread | None) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids_sha256 and ids, or decoded_sha256 where pieces are given, some 100,000 words at a time."""

    def shas(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
        view = memoryview(values)
        return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())

    ends = np.cumsum(sizes.astype(np.int64))
    begins, first = ends - sizes, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, begins[first] + 100_000, "right")))
        at = np.append(begins[first:last], ends[last - 1]) - begins[first]
        tokens, edges = words.of(places[begins[first] : ends[last - 1]])
        edges = edges[at]
        some = np.diff(edges) > 0
        text, where = decimal.of(tokens)
        where = where[edges]
        columns = {"doc_id": ids.slice(first, last - first), "n_tokens": pa.array(np.diff(edges)), "ids_sha256": shas(text, where[:-1], where[1:] - some)}
        if pieces is None:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        else:
            text, where = pieces.of(tokens)
            where = where[edges]
            columns["decoded_sha256"] = shas(text, where[:-1] + some, where[1:])  # a text begins with the space put before it
        yield pa.RecordBatch.from_pydict(columns)
        first = last


def spread_of(lists: list[bytes]) -> Spread:
    return Spread(np.frombuffer(b"".join(lists), np.uint8), np.array([len(x) for x in lists], np.int64))


def encoder(model: Model, block_bytes: int, longest: int, with_texts: bool):
    """(doc_id, words) -> results."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, decimal = Tables(model), spread_of([b"%d," % i for i in range(len(model.pieces))])
        pieces = spread_of(pieces_bytes(model)) if with_texts else None
        for batch in batches:
            for ids, sizes, places, data, edges in cut_blocks(batch, block_bytes) if batch.num_rows else ():
                words = merge_words(data[edges[0] : edges[-1]].tobytes(), np.diff(edges), tables, longest)
                yield from results(ids, sizes, places, words, decimal, pieces)

    return emit


def words_of(text: Column) -> Column:
    """A text with a space before it, cut before each run of spaces; every space is written as U+2581."""
    marked = F.translate(F.concat(F.lit(" "), text), " ", SPACE)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(f"{SPACE}+[^{SPACE}]*"), F.lit(0)))


def encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, with_texts: bool, block_bytes: int, longest: int) -> DataFrame:
    words = require(docs, [id_col, text_col]).toDF("doc_id", "text").select("doc_id", words_of(F.col("text")).alias("words"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, " + ("decoded_sha256 string" if with_texts else "ids array<int>")
    return words.mapInArrow(encoder(Model(model_path), block_bytes, longest, with_texts), schema).withColumnRenamed("doc_id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, longest: int = 512) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and ids of each row."""
    return encoded(docs, model_path, id_col, text_col, False, block_bytes, longest)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with `decoded`, the text of their ids."""
    model = Model(model_path)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decoded([int(i) for i in x], model) for x in ids], dtype="object")

    return rows.withColumn("decoded", text(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, longest: int = 512) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row; the text is put together anew from the ids."""
    return encoded(docs, model_path, id_col, text_col, True, block_bytes, longest)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
