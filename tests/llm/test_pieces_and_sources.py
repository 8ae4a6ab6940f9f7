"""SentencePiece against the library, divergences of sources against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.llm.piece_bpe import Model, decode, decoded, encode, round_trip
from quillspark.llm.source_audit import source_audit

MODEL = P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n\n  \t x", "It's we'll", "naïve Ça 漢字かな 🙂🙂 123４", "a▁b ▁ ▁▁c", "x" * 3000, " " * 2000, "ab" * 700, "日本語の文章" * 200, "<s>a</s> <unk> <0x41>",
    "  lead", "trail  ", "\x00\x1c\x1f", "a" + " " * 40 + "b", "one two three\n" * 50, "é ﬁ ㎏ 　 wide",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def frame(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, words="w", ids=1) for i, t in enumerate(texts)], "doc_id long, text string, words string, ids int")


@pytest.mark.parametrize("longest", [4, 512])
def test_pieces_equal_the_library(spark, library, longest):
    rng = random.Random(3)
    parts = ["the", "ing", " ", "  ", "é", "ñ", "字", "🙂", "\n", "▁", "x", "tion", "1", "."]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(100).collect()]
    got = {r.doc_id: r for r in round_trip(frame(spark, texts), MODEL, block_bytes=1 << 14, longest=longest).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids), repr(t)[:80]
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(t)[:80]
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest(), repr(t)[:80]


def test_ids_and_texts_are_results(spark, library):
    rows = decode(encode(frame(spark, ODD), MODEL), MODEL).collect()
    assert len(rows) == len(ODD)
    assert all(r.ids == library.encode(ODD[r.doc_id] or "") and r.decoded == library.decode(r.ids) for r in rows)


def test_any_ids_decode_as_the_library_does(library):
    rng, model = random.Random(5), Model(MODEL)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randint(3, 258), rng.randint(0, 31999), 259, 260]) for _ in range(rng.randint(0, 8))]
        assert decoded(ids, model) == library.decode(ids), ids


def test_odd_rows_of_pieces(spark):
    twice = round_trip(frame(spark, ["a b"]).union(frame(spark, ["a b"])).union(frame(spark, [None]).withColumn("doc_id", F.lit(None).cast("long"))), MODEL)
    assert sorted((r.doc_id is None, r.n_tokens) for r in twice.collect()) == [(False, 2), (False, 2), (True, 0)]
    assert round_trip(frame(spark, []), MODEL).count() == 0


def brute_audit(docs, least, shown):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        found[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def estimates(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: estimates(found[lang, s]) for s in sources}
        q = estimates(sum((found[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if found[lang, s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:shown])]
    return sorted(out)


def sources_frame(spark, docs, parts=3):
    return spark.createDataFrame([(1, *d, "x", 7) for d in docs], "doc_id long, text string, lang string, source string, term string, n int").repartition(parts)


@pytest.mark.parametrize("pairs_held", [4, 1 << 18])
def test_divergence_equals_brute_force(spark, pairs_held):
    rng = random.Random(11)
    words = ["The", "of", "ñandú", "über", "x1y", "É", "日本", "a", "b", "c", "rare"]
    docs = []
    for k in range(300):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é", "hot", "hot", "hot"])
        few = words[: rng.randint(1, len(words))]
        text = " ".join(rng.choice(few) for _ in range(rng.randint(0, 30)))
        docs.append((rng.choice([text, text, text, None, "", "?!"]), lang, source))
    docs += [("only here", "xx", "s1"), (None, "xx", "s2"), ("lonely", "yy", "s1")] + [("copy copy", "en", "hot")] * 40
    got = source_audit(sources_frame(spark, docs), least_documents=4, terms_shown=3, pairs_held=pairs_held)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(docs, 4, 3)


def test_divergence_of_nothing(spark):
    assert source_audit(sources_frame(spark, [], 1)).count() == 0
    assert [r.value for r in source_audit(sources_frame(spark, [(None, None, "a"), ("", None, None)], 1)).collect()] == [0, 0]


def test_combiner_flushes_and_runs_cross_batches(spark):
    from quillspark.llm.source_audit import term_runs

    docs = [(f"common w{k % 50} w{k % 50}", "en", f"s{k % 7}") for k in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = {r.term: r for r in term_runs(sources_frame(spark, docs), 10, rows_held=20, block_bytes=300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows["common"].documents == 2000 and rows["common"].sources == [f"s{k}" for k in range(7)] and sum(rows["common"].counts) == 2000
    assert "w1" not in rows and rows["w"].documents == 2000 and sum(rows["w"].counts) == 4000
