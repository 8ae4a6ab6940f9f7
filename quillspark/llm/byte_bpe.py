"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

The fold joins a word's adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank. The ranks are
tables: for a pair of token ids `slots` holds the rank of the joined token at `places[left] + right`, so a lookup is two
array reads; a token's id is its rank. Decoding concatenates the binary pieces of the ids.

There are two forms of the fold with equal results. By Spark's higher-order functions (`native`), the tables are
literals and a piece is one long that packs the rank of its pair with the next piece, its number and its id, so the
smallest long names the pair to join. Spark interprets these functions, at some 30 microseconds a word, which is above
the limit of the check tool on the tables given (see README), so the default folds with numpy in the Arrow task, all
words of a block at once, one join in each word a round.

Words are distinct per block of texts (some 4 MB, or one longer text), so no text, word or id is shuffled and memory
follows the block. A fold costs the square of a word's length, so words of more than `longest` bytes (runs without a
break, hundreds of times the usual) are merged by the same rule with a heap.

Defined results: a null or empty text has no tokens; repeated rows are encoded each, null ids stay null; other columns
are ignored; an empty table gives no rows; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import require

BLOCK = "doc_ids array<long>, sizes array<int>, places binary, words array<array<int>>, long_at array<int>, long_ids array<array<int>>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """slots[places[a] + b] == b << bits | rank of the token a + b for a pair of ids that makes one; other slots never
    begin with b.

    Rows of the sparse matrix (left, right) -> rank are laid over each other, at distinct places, where they don't
    collide. The id `end` stands for the ends of a word and pairs with nothing.
    """

    def __init__(self, ranks: dict[bytes, int]):
        rows: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    rows.setdefault(a, {})[b] = rank
        self.end = max(ranks.values(), default=-1) + 1
        self.bits = (self.end + 1).bit_length()
        rng, nothing = np.random.default_rng(1), (1 << self.bits) - 1 << self.bits
        slots = np.full(self.end + (1 << 17), nothing, np.int64)
        places, begun = np.zeros(self.end + 1, np.int64), set()
        for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            right, tries = np.array(sorted(row)), 0
            while (at := int(rng.integers(1, len(slots) - right[-1]))) in begun or (slots[at + right] != nothing).any():
                tries += 1
                if tries % 200 == 0:
                    slots = np.concatenate([slots, np.full(1 << 16, nothing, np.int64)])
            slots[at + right] = right << self.bits | np.array([row[b] for b in right.tolist()])
            places[a] = at
            begun.add(at)
        places[[a for a in range(self.end + 1) if a not in rows]] = len(slots)
        self.places, self.slots = places, np.concatenate([slots, np.full(self.end + 1, nothing, np.int64)])
        self.longest = (1 << 63 - 3 * self.bits) - 2
        # the first piece of each pair of bytes: the rank of both and the id of the first; a byte's successor 256 is the end
        above, one = 63 - 2 * self.bits, [ranks[bytes([b])] for b in range(256)]
        both = [[ranks.get(bytes([a, b]), 1 << self.bits) for b in range(256)] + [1 << self.bits] for a in range(256)]
        self.starts = [rank << above | one[a] for a in range(256) for rank in both[a]]

    def column(self) -> Column:
        content = {"starts": self.starts, "places": self.places.tolist(), "slots": self.slots.tolist()}
        return F.from_json(F.lit(json.dumps(content, separators=(",", ":"))), "struct<starts:array<bigint>,places:array<int>,slots:array<bigint>>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a fold over nothing, whose finish sees the start."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def fold_words(words: Column, table: PairTable) -> Column:
    """Token ids of each word of an array; a word is the array of its bytes, each with the next: byte * 257 + next."""
    bits = table.bits
    id_mask, above = (1 << bits) - 1, 63 - 2 * bits  # rank and check | number | id
    number_mask = (1 << above) - 1 - id_mask
    nothing = (1 << bits) << above

    def fold(word: Column, starts: Column, places: Column, slots: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """In place for a packed long; `nothing` or more for a pair that makes no token."""
            return F.shiftleft(F.get(slots, F.get(places, a.cast("int")) + b.cast("int")).bitwiseXOR(F.shiftleft(b, bits)), above)

        def id_of(piece: Column) -> Column:
            return piece.bitwiseAND(F.lit(id_mask))

        def joined(pieces: Column, least: Column, token: Column, at: Column) -> Column:
            # pieces at and at + 1 (from 0) become one: its left neighbour and itself get new ranks
            pair = F.array(
                let(F.get(pieces, at - 1), lambda x: x.bitwiseAND(F.lit((1 << above) - 1)).bitwiseOR(rank(id_of(x), token))),
                least.bitwiseAND(F.lit(number_mask)).bitwiseOR(token).bitwiseOR(let(id_of(F.get(pieces, at + 2)), lambda x: rank(token, x))),
            )
            tail = F.transform(F.slice(pieces, at + 3, F.size(pieces)), lambda x: x - F.lit(1 << bits))
            return F.concat(F.slice(pieces, F.lit(1), at - 1), pair, tail)

        def step(pieces: Column, _: Column) -> Column:
            return let(F.array_min(pieces), lambda least: F.when(least >= F.lit(nothing), pieces).otherwise(
                let(F.shiftright(least, above), lambda token: let(F.shiftright(least.bitwiseAND(F.lit(number_mask)), bits).cast("int"), lambda at: joined(pieces, least, token, at)))
            ))

        packed = F.transform(word, lambda b, k: F.get(starts, b).bitwiseOR(F.shiftleft((k + 1).cast("long"), bits)))
        first, last = (F.array(F.lit(nothing | number | table.end).cast("long")) for number in (0, number_mask))
        steps = F.when(F.size(word) > 1, F.sequence(F.lit(2), F.size(word))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.concat(first, packed, last), step, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda x: id_of(x).cast("int")))

    return let(table.column(), lambda t: let(t["starts"], lambda b: let(t["places"], lambda p: let(t["slots"], lambda s: F.transform(words, lambda w: fold(w, b, p, s))))))


def decode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of each array of ids of an array: its binary pieces in a row, carried as characters up to U+00FF."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return let(table, lambda t: F.transform(words, lambda ids: F.encode(F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""), "ISO-8859-1")))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a linked list with a heap of pairs: for words too long to fold."""
    n = len(word)
    piece, after, before = [word[k : k + 1] for k in range(n)], [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, k, word[k : k + 2]) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, token = heapq.heappop(heap)
        j = after[k] if piece[k] else -1
        if j < 0 or piece[k] + piece[j] != token:
            continue
        piece[k], piece[j], after[k] = token, b"", after[j]
        if after[k] >= 0:
            before[after[k]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right >= 0 and (r := ranks.get(piece[left] + piece[right])) is not None:
                heapq.heappush(heap, (r, left, piece[left] + piece[right]))
    return [ranks[p] for p in piece if p]


def whole_tokens(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Tokens that their own bytes don't merge into (none in a vocabulary whose ranks are merges): words for themselves."""
    return {t: r for t, r in ranks.items() if merge_long(t, ranks) != [r]}


def cut_blocks(batch: pa.RecordBatch, block_bytes: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, words) -> blocks: ids, words of each text, the number of each word in the block's list of distinct
    words, and the bytes of that list with their edges."""
    lists, ids = batch.column(1), batch.column(0)
    words, ends = lists.values, lists.offsets.to_numpy()
    at = np.frombuffer(words.buffers()[1], np.int32 if words.type == pa.string() else np.int64)[words.offset :][ends] if len(words) else ends
    start = 0
    while start < len(ids):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + block_bytes, "right")) - 1)
        own = words.slice(ends[start], ends[stop] - ends[start]).dictionary_encode()
        known = own.dictionary.cast(pa.large_binary())
        edges = np.frombuffer(known.buffers()[1], np.int64)[known.offset :][: len(known) + 1] if len(known) else np.zeros(1, np.int64)
        data = np.frombuffer(known.buffers()[2], np.uint8) if len(known) and known.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield ids.slice(start, stop - start), np.diff(ends[start : stop + 1]), own.indices.to_numpy(zero_copy_only=False), data, edges
        start = stop


class Apart:
    """Words of a block that aren't folded: very long ones, and tokens that their bytes don't merge into."""

    def __init__(self, ranks: dict[bytes, int], longest: int):
        self.ranks, self.longest, self.whole = ranks, longest, whole_tokens(ranks)

    def of(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        there = np.diff(edges) > self.longest
        if self.whole:
            there |= np.array([data[a:b].tobytes() in self.whole for a, b in zip(edges, edges[1:], strict=False)], bool)
        words = [data[edges[k] : edges[k + 1]].tobytes() for k in np.flatnonzero(there)]
        return there, [[self.ranks[w]] if w in self.ranks else merge_long(w, self.ranks) for w in words]


def fold_block(data: np.ndarray, edges: np.ndarray, table: PairTable, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words and their number in each: one join in every open word a round."""
    bits, end, none = table.bits, table.end, np.int64(1 << table.bits)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = table.slots[table.places[a] + b]
        return np.where(slot >> bits == b, slot & (none - 1), none)

    lengths = np.diff(edges)
    word, piece = np.repeat(np.arange(len(lengths)), lengths), one[data[edges[0] : edges[-1]]]
    after = np.append(piece[1:], end)
    after[np.cumsum(lengths)[lengths > 0] - 1] = end
    ranks, done = rank(piece, after), [(word[:0], piece[:0])]
    while len(word):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(begins, len(word)))
        least = np.repeat(np.minimum.reduceat(ranks, begins), sizes)
        open_ = least < none
        if not open_.all():
            done.append((word[~open_], piece[~open_]))
            word, piece, ranks, least = word[open_], piece[open_], ranks[open_], least[open_]
            if not len(word):
                break
        at = np.flatnonzero(ranks == least)
        at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])]
        piece[at] = ranks[at]
        keep = np.ones(len(word), bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))  # every earlier word has lost one piece
        word, piece, ranks = word[keep], piece[keep], ranks[keep]
        follows = np.minimum(now + 1, len(word) - 1)
        inside = (now + 1 < len(word)) & (word[follows] == word[now])
        ranks[now] = rank(piece[now], np.where(inside, piece[follows], end))
        before = now[(now > 0) & (word[now - 1] == word[now])]
        ranks[before - 1] = rank(piece[before - 1], piece[before])
    word, piece = (np.concatenate(x) for x in zip(*done, strict=True))
    return piece[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(lengths))


class Spread:
    """Lists of elements -> the elements of runs of lists."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, others: dict[int, list] | None = None):
        self.counts = counts.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        parts, size = [values], len(values)
        for at, own in (others or {}).items():
            self.starts[at], self.counts[at] = size, len(own)
            parts.append(np.asarray(own, values.dtype))
            size += len(own)
        self.values = np.concatenate(parts)

    def of(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of the lists in a row, and where each list begins."""
        n = self.counts[lists]
        edges = np.concatenate([[0], np.cumsum(n)])
        return self.values[np.repeat(self.starts[lists] - edges[:-1], n) + np.arange(edges[-1])], edges


def pieces_of(ranks: dict[bytes, int]) -> Spread:
    """The bytes of each id."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return Spread(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))


def results(ids: pa.Array, sizes: np.ndarray, places: np.ndarray, words: Spread, pieces: Spread | None) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids_sha256 and ids, or decoded_sha256 where pieces are given, some 100,000 words at a time."""

    def shas(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        view = memoryview(values)
        return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())

    ends = np.cumsum(sizes.astype(np.int64))
    begins, first = np.concatenate([[0], ends])[:-1], 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, begins[first] + 100_000, "right")))
        at = np.concatenate([begins[first:last], ends[last - 1 : last]]) - begins[first]
        tokens, edges = words.of(places[begins[first] : ends[last - 1]])
        edges = edges[at]
        columns = {"doc_id": ids.slice(first, last - first), "n_tokens": pa.array(np.diff(edges)), "ids_sha256": shas(tokens, edges)}
        if pieces is None:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        else:
            data, where = pieces.of(tokens)
            columns["decoded_sha256"] = shas(data, where[edges])
        yield pa.RecordBatch.from_pydict(columns)
        first = last


def encoder(ranks: dict[bytes, int], table: PairTable, block_bytes: int, longest: int, with_texts: bool):
    """(doc_id, words) -> results, folded here."""
    apart, pieces = Apart(ranks, longest), pieces_of(ranks) if with_texts else None
    one = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, places, data, edges in cut_blocks(batch, block_bytes) if batch.num_rows else ():
                there, lists = apart.of(data, edges)
                lengths = np.diff(edges)
                kept = data[edges[0] : edges[-1]][np.repeat(~there, lengths)]
                tokens, counts = fold_block(kept, np.concatenate([[0], np.cumsum(np.where(there, 0, lengths))]), table, one)
                yield from results(ids, sizes, places, Spread(tokens, counts, dict(zip(np.flatnonzero(there).tolist(), lists, strict=True))), pieces)

    return emit


def block_rows(ranks: dict[bytes, int], block_bytes: int, longest: int):
    """(doc_id, words) -> one row per block, for the fold in Spark."""
    apart = Apart(ranks, longest)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, places, data, edges in cut_blocks(batch, block_bytes) if batch.num_rows else ():
                there, lists = apart.of(data, edges)
                lengths = np.diff(edges)
                after = np.append(data[1:], 0).astype(np.int32)
                after[edges[1:][lengths > 0] - 1] = 256
                values = (data.astype(np.int32) * 257 + after)[edges[0] : edges[-1]][np.repeat(~there, lengths)]
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(there, 0, lengths))]).astype(np.int32)), pa.array(values))
                row = [0, len(ids)]
                arrays = [
                    pa.ListArray.from_arrays(row, ids), pa.ListArray.from_arrays(row, pa.array(sizes, pa.int32())), pa.array([places.astype("<i4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays([0, len(words)], words), pa.array([np.flatnonzero(there).tolist()], pa.list_(pa.int32())), pa.array([lists], pa.list_(pa.list_(pa.int32()))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_ids", "sizes", "places", "words", "long_at", "long_ids"])

    return emit


def block_results(ranks: dict[bytes, int], with_texts: bool):
    """One row per block with the ids of its words -> results."""
    pieces = pieces_of(ranks) if with_texts else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, places, long_at, lists, long_ids = (batch.column(c)[row] for c in range(6))
                values = lists.values.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                words = Spread(values, lists.values.value_lengths().to_numpy(zero_copy_only=False), dict(zip(long_at.as_py(), long_ids.as_py(), strict=True)))
                yield from results(ids.values, sizes.values.to_numpy(zero_copy_only=False), np.frombuffer(places.as_py(), "<i4"), words, pieces)

    return emit


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, with_texts: bool, native: bool, block_bytes: int, longest: int) -> DataFrame:
    table = PairTable(ranks)
    longest = min(longest, table.longest)
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    words = require(docs, [id_col, text_col]).toDF("doc_id", "text").select("doc_id", found.alias("words"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, " + ("decoded_sha256 string" if with_texts else "ids array<int>")
    if native:
        blocks = words.mapInArrow(block_rows(ranks, block_bytes, longest), BLOCK).select("doc_ids", "sizes", "places", "long_at", fold_words(F.col("words"), table).alias("ids"), "long_ids")
        out = blocks.mapInArrow(block_results(ranks, with_texts), schema)
    else:
        out = words.mapInArrow(encoder(ranks, table, block_bytes, longest, with_texts), schema)
    return out.withColumnRenamed("doc_id", id_col)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", native: bool = False, block_bytes: int = 4 << 20, longest: int = 4096
) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and ids of each row."""
    return encoded(docs, load_ranks(ranks_path), pattern, id_col, text_col, False, native, block_bytes, longest)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with `decoded`, the bytes of their ids, by Spark's own functions."""
    return rows.withColumn("decoded", F.get(decode_words(F.array(F.col(ids_col)), load_ranks(ranks_path)), 0))


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", native: bool = False, block_bytes: int = 4 << 20, longest: int = 4096
) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row; the ids are decoded anew for the last."""
    return encoded(docs, load_ranks(ranks_path), pattern, id_col, text_col, True, native, block_bytes, longest)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
