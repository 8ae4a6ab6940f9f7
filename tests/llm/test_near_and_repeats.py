"""MinHash near-duplicates and repeated windows against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from quillspark.llm.minhash_dedup import fewest_matches, near_duplicates, shingle_set
from quillspark.llm.suffix_dedup import remove_repeats, repeat_report

SCHEMA = "doc_id long, text string, lang string, key string, spans string"


def frame(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", key="k", spans="s") for i, t in texts], SCHEMA)


def brute_components(texts, width, percent):
    sets = {i: shingle_set(t, width) for i, t in texts}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_repeats(texts, window):
    raws = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(r[s : s + window] for _, r in raws for s in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - window + 1):
            if count[r[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, words=60):
    """Near copies, passages that many share, edits, hot exact copies and odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base = text(70), text(words * 2)
    out = []
    for _ in range(n):
        kind = rng.random()
        w = text(rng.randint(1, words * 3))
        if kind < 0.25:
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.45:
            k = rng.randint(0, len(w))
            w = w[:k] + passage[rng.randint(0, 20) :] + w[k:]
        elif kind < 0.6:
            w = list(base)
        out.append(" ".join(w))
    out += [None, "", " \n\t", "one", "One", "two words", "x" * 700, "ab" * 400, "x" * 300]
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    texts = corpus(seed, 220)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts), width=4, percent=80, block=16).collect()}
    assert got == brute_components(texts, 4, 80)


def test_repeated_and_null_ids_are_judged_by_their_own_text(spark):
    w, x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "wxy")
    rows = [(1, w), (1, x), (2, w + " q"), (3, x + " q"), (1, w), (None, y), (None, y + " q"), (5, None), (None, None), (6, "z " * 30_000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), width=4).collect()), key=str)
    want = [(1, 57, 1, True)] * 3 + [(2, 58, 1, False), (3, 58, 1, False), (5, 0, 5, True), (6, 1, 6, True), (None, 0, None, True), (None, 57, None, True), (None, 58, None, True)]
    assert got == sorted(want, key=str)


def test_large_buckets_have_leaders_of_parts(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(150)] = f"e{i}{rng.random()}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts), width=4, fan=8, block=16, block_bytes=9000).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 4, 80).items()}


def test_chain_links_reach_across_leaders(spark):
    words = [f"w{i}" for i in range(140)]
    texts = [(k, " ".join(words[k * 4 : k * 4 + 100])) for k in range(10)]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts), width=4, percent=80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 4, 80).items()}


def test_posterior_bounds_grow_with_evidence():
    bounds = fewest_matches(0.8, 1e-4, 160, 32)
    assert [n for n, _ in bounds] == [32, 64, 96, 128, 160]
    assert all(0 < m < 0.8 * n for n, m in bounds)


@pytest.mark.parametrize(("seed", "window"), [(3, 200), (4, 40), (5, 200)])
def test_repeats_match_brute_force(spark, seed, window):
    texts = corpus(seed, 150)
    got = sorted(map(tuple, repeat_report(frame(spark, texts), window=window).collect()), key=str)
    assert got == brute_repeats(texts, window)


def test_repeats_of_repeated_and_null_ids(spark):
    z, u = " ".join(f"zz{i}" for i in range(60)), " ".join(f"u{i}" for i in range(70))
    rows = [(1, z), (1, u), (2, u), (None, u + " more"), (None, None), (3, "é" * 90 + z[:199]), (3, "é" * 90 + z[:199]), (4, z[10:250])]
    got = [tuple(r) for r in repeat_report(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(rows, 200), key=str)
    cut = remove_repeats(frame(spark, rows))
    assert sorted((str(r.doc_id), r.text) for r in cut.collect() if r.text) == sorted([("None", " more"), ("1", z[:10] + z[250:])])


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    from quillspark.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    texts = corpus(9, 60, words=200)
    assert sorted(map(tuple, repeat_report(frame(spark, texts)).collect()), key=str) == brute_repeats(texts, 200)


def test_same_row_twice_is_its_own_copy(spark):
    text = " ".join(f"unique{i}" for i in range(60))
    rows = repeat_report(frame(spark, [(1, text), (1, text)])).collect()
    assert [(r.n_removed, r.n_spans) for r in rows] == [(len(text), 1)] * 2


def test_empty_table_and_columns(spark):
    empty = frame(spark, [])
    assert near_duplicates(empty).count() == 0
    assert repeat_report(empty).count() == 0
    cut = remove_repeats(frame(spark, [(1, "é" * 150), (2, "é" * 150 + "z"), (3, None)]))
    assert cut.columns == ["doc_id", "text", "lang", "key", "spans"]
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "", 2: "z", 3: None}
