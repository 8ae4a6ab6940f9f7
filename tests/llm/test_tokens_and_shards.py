"""Tokenising, packing and sharding against the libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.llm.byte_bpe import decode, encode, load_ranks, merge_long, round_trip
from quillspark.llm.packing import dissolved, offsets_in, pack_documents, sum_of_squares
from quillspark.llm.sharding import kd_shards

ODD = [
    None, "", " ", "\n\n  \t x", "It's we'll THE'RE", "naïve Ça 漢字かな 🙂🙂 123４", "a b c\u0085d", "x" * 3000, "ab" * 500, "日本" * 300,
    "<|endoftext|> and <|endoftext|>", "  lead", "trail  ", "\x00\x1c\x1f", "don't", "!!!???...", "0" * 600, "one two three\n" * 50,
]


def frame(spark, texts):
    rows = [Row(doc_id=i, text=t, words="w", key=1, size="s", shard=-1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, key int, size string, shard int")


def real_texts(spark, n=150):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()]


@pytest.mark.parametrize("native", [False, True])
def test_bpe_equals_tiktoken(spark, native):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    truth = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + real_texts(spark)
    got = {r.doc_id: r for r in round_trip(frame(spark, texts), path, P.PATTERN, native=native, block_bytes=1 << 16).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = truth.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), repr(t)[:80]
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_ids_and_bytes_are_results(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = [*ODD, "x" * 6000 + " y", "ab cd"]
    rows = decode(encode(frame(spark, texts), path, P.PATTERN), path).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() and len(r.ids) == r.n_tokens for r in rows) and len(rows) == len(texts)
    twice = round_trip(frame(spark, ["a b"]).union(frame(spark, ["a b"])).union(frame(spark, [None]).withColumn("doc_id", F.lit(None).cast("long"))), path, P.PATTERN)
    assert sorted((r.doc_id is None, r.n_tokens) for r in twice.collect()) == [(False, 2), (False, 2), (True, 0)]


def test_long_words_merge_like_short_ones():
    import tiktoken

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    truth = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abeintsa") for _ in range(rng.randint(2, 400)))
        assert merge_long(w.encode(), ranks) == truth.encode_ordinary(w)


def test_packing_against_tokenizers(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    truth = Tokenizer.from_file(path)
    texts = ODD + real_texts(spark) + [" ".join(f"w{k}" for k in range(3000))]
    rows = pack_documents(frame(spark, texts), path, size=256, group_rows=60).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = [*truth.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert pieces[0].start == 0 and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 256 for r in pieces[1:]) and (len(ids) > 256 or len(pieces) == 1)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    full: dict = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def best_fit_decreasing(lengths, size):
    gaps = []
    for s in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else size) - s)
    return len(gaps)


@pytest.mark.parametrize(("seed", "low", "high", "n"), [(3, 1, 700, 1500), (4, 300, 1024, 400), (5, 200, 520, 600), (6, 1, 2, 5), (7, 1, 1025, 1)])
def test_packing_needs_no_more_bins_than_best_fit_decreasing(seed, low, high, n):
    lengths = np.sort(np.random.default_rng(seed).integers(low, high, n))[::-1]
    bins = dissolved(lengths, sum_of_squares(lengths, 1024), 1024)
    assert np.bincount(bins, lengths).max() <= 1024 and len(set(bins)) == bins.max() + 1 <= best_fit_decreasing(lengths, 1024)
    ends = offsets_in(lengths, bins) + lengths
    assert all(max(ends[bins == b]) == lengths[bins == b].sum() for b in set(bins))


def test_sequences_of_the_query(spark):
    """At the bound for the given table: as few as its tokens could fill."""
    from quillspark.llm.queries import op5_best_fit_packing

    totals = op5_best_fit_packing(spark, "/root/testdata/sf0.001").agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).first()
    assert totals.n <= -(-totals.tokens // 2048) + 1


def test_shards(spark):
    texts = ODD + real_texts(spark, 200) + ["same text"] * 50
    rows = kd_shards(frame(spark, texts), shards=4, rows_per_slot_group=5).collect()
    assert len(rows) == len(texts)
    at, load, slots = {}, {}, {}
    for r in rows:
        t = texts[r.doc_id]
        raw = (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert at.setdefault(raw, r.shard) == r.shard
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(load) == {0, 1, 2, 3}
    assert max(load.values()) - min(load.values()) < 0.2 * sum(load.values()) / 4 + 2 * max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_a_given_table_are_within_a_few_percent(spark):
    from quillspark.llm.queries import op4_kd_sharding

    rows = op4_kd_sharding(spark, "/root/testdata/sf0.01").collect()
    load = [sum(r["size"] for r in rows if r.shard == k) for k in range(16)]
    mean = sum(load) / 16
    assert max(load) < 1.05 * mean and min(load) > 0.95 * mean


def test_shards_and_packs_of_odd_rows(spark):
    rows = [(1, "a")] * 3 + [(1, "b"), (None, "a"), (None, None), (2, None), (3, "long " * 60_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    placed = kd_shards(odd, shards=2).collect()
    assert len(placed) == len(rows) and len({r.shard for r in placed if r.text_crc32 == zlib.crc32(b"a")}) == 1
    for shard in (0, 1):
        own = sorted(r.slot for r in placed if r.shard == shard)
        assert own == list(range(len(own)))
    path = P.path("byte_bpe_50k.json")
    packed = pack_documents(odd, path).collect()
    short = [r for r in packed if r.doc_id != 3]
    assert len(short) == len(rows) - 1 and all(r.piece == 0 for r in short)
    assert sum(r.length for r in packed if r.doc_id == 3) > 60_000 and max(r.length for r in packed) == 2048
    at = {}
    for r in packed:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 and sorted(o for o, _ in parts) == [sum(n for o2, n in parts if o2 < o) for o, _ in sorted(parts)] for parts in at.values())
    assert round_trip(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == len(rows)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert kd_shards(empty, shards=4).count() == 0
    assert pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert round_trip(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
