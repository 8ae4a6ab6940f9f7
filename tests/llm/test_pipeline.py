"""Stages of the pipeline against brute force on small inputs; toxicity by held-out accuracy."""

import random

from pyspark.sql import Row

import corpus_pipeline
from quillspark.llm.common import Scratch
from quillspark.llm.exact_dedup import DigestIndex, exact_dedup, mark_against
from quillspark.llm.stages import exact_dedup_stage, near_dedup_stage, suffix_dedup_stage, toxicity_stage
from quillspark.llm.toxicity import Likeness, fit, kernel, score_documents, train
from tests.llm.test_near_and_repeats import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or "")) for i, t in texts], SCHEMA)


def labelled(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    insults = ["grubhead", "zworfel", "pathkick"]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            w = rng.choice(insults)
            words.insert(rng.randrange(len(words)), w if rng.random() < 0.8 else w[:4] + "." + w[4:])
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def test_exact_dedup(spark):
    texts = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 100_000), (9, "X" * 100_000), (2, "sAME")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, texts)).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True), 7: (7, 1, True), 8: (9, 2, False), 9: (9, 2, True)}
    assert exact_dedup(frame(spark, [])).count() == 0
    kept = exact_dedup_stage(spark, frame(spark, texts), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 9]


def test_index_over_batches(spark):
    index = DigestIndex(spark, "test_index", buckets=4)
    try:
        index.add(frame(spark, [(1, "a"), (2, "b"), (3, "B")]))
        index.add(frame(spark, [(9, "A"), (10, "c"), (11, "c"), (1, "B"), (None, "d")]))
        index.add(frame(spark, []))
        want = [(None, 1), (3, 3), (9, 2), (11, 2)]
        for _ in range(2):
            assert sorted(((r.keep_id, r.group_size) for r in index.groups().collect()), key=str) == sorted(want, key=str)
            assert "Exchange" not in plan_of(index.groups())
            index.compact()
        assert index.rows().count() == 4
        marks = sorted((r.doc_id, r.keep_id, r.kept) for r in mark_against(index, frame(spark, [(1, "a"), (9, "A"), (9, "A")])).collect())
        assert marks == [(1, 9, False), (9, 9, True), (9, 9, True)]
    finally:
        index.drop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_folds_copies_before_the_shuffle_and_is_joined_in_its_buckets(spark, monkeypatch):
    """What add() writes first must come from an aggregate on both sides of the exchange, below no join."""
    plans = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: plans.append(plan_of(df)) or save(self, df))
    monkeypatch.setattr(DigestIndex, "append", lambda self, rows: plans.append(plan_of(rows)))
    index = DigestIndex(spark, "test_plan_index", buckets=4)
    try:
        index.add(frame(spark, [(1, "a"), (2, "b")]))
    finally:
        index.drop()
    folded, new = plans
    assert "Join" not in folded and folded.index("HashAggregate") < folded.index("Exchange") < folded.rindex("HashAggregate")
    assert "SortMergeJoin" in new and "LeftAnti" in new and "HashAggregate" not in new and new.count("Exchange") == 1


def test_kernel_tolerates_gaps_and_insertions():
    exact, gapped, spaced, other = kernel(["grubhead", "grub-head", "g.r.u.b.h.e.a.d", "nonsense"], "grubhead")
    assert exact == 1 and 0.3 < gapped < 1 and spaced > other and other < 0.05
    alike = Likeness(["grubhead"]).documents(["fine words. you G r u b h e a d there", None, ""])
    assert alike[0, 0] == 1 and not alike[1].any() and not alike[2].any()
    once, thrice = Likeness(["grub"]).documents(["grubby grubby plain", "grubby grubs grubber plain"])
    assert once[0] == thrice[0] == 1 and thrice[1] > once[1] and thrice[2] > once[2]


def test_marks_that_speak_by_their_number(spark):
    import numpy as np

    rng = random.Random(8)
    plain = ["house", "river", "stone", "quiet", "green", "walks", "under", "seven", "paper", "cloud"]
    texts, toxic = [], []
    for k in range(600):
        words = [rng.choice(plain) + str(rng.randint(0, 99)) for _ in range(30)]
        bad = k % 6 == 0
        # clean texts hold one such word at times, toxic ones several
        words += [f"vorkel{rng.choice('abcdefgh')}{rng.choice('mnopq')}" for _ in range(rng.randint(3, 6) if bad else k % 4 == 1)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(bad)
    model = fit(texts[:400], np.array(toxic[:400]))
    got = model.of(Likeness(model.landmarks).documents(texts[400:])) >= 0.5
    assert (got == np.array(toxic[400:])).mean() > 0.97


def test_long_labelled_texts_are_learnt_from(spark):
    rows = labelled(2, 300)
    filler = "calm words of no weight " * 4000
    docs = frame(spark, [(i, filler + t) for i, t, _ in rows])
    labels = spark.createDataFrame([Row(doc_id=i, toxic=y, quality=1) for i, _, y in rows])
    assert {t[:4] for t in train(docs, labels).landmarks} == {"zwor", "path", "grub"}
    assert train(docs, labels, sample_bytes=1).landmarks == []  # one text, then the bound


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(1, 900)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "zworfel " * 20_000)])
    labels = spark.createDataFrame([Row(doc_id=i, toxic=y, quality=1) for i, _, y in rows])
    scores = {r.doc_id: r for r in score_documents(docs, train(docs, labels)).collect()}
    assert len(scores) == 903
    held = [(scores[i], y) for i, _, y in rows if scores[i].held_out]
    assert len(held) > 100
    assert sum(s.predicted == y for s, y in held) / len(held) > 0.97
    assert scores[5000].score == scores[5001].score < 0.5 and scores[5002].predicted == 1
    assert all(0 <= s.score <= 1 for s in scores.values())


def test_toxicity_without_examples(spark):
    import numpy as np

    docs = frame(spark, [(1, "a b c"), (2, None)])
    assert [r.predicted for r in score_documents(docs, fit(["a b c"], np.array([False]))).collect()] == [0, 0]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in score_documents(docs, train(docs, none)).collect()] == [0, 0]
    assert score_documents(docs.limit(0), train(docs, none)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Without toxic examples: exact copies, near copies and repeated passages by hand, then the packed tokens' number."""
    from tokenizers import Tokenizer

    import public_tokenizers as P
    from tests.llm.test_near_and_repeats import corpus

    texts = [(i, t) for i, t in corpus(21, 120, words=80)] + [(None, "a row without an id " * 3), (7, "another text under a known id"), (7, "another text under a known id")]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for i, t in texts:
        if fold(t) not in best or (i or -1) > (best[fold(t)][0] or -1):
            best[fold(t)] = (i, t)
    left = list(best.values())
    numbered = [(n, t) for n, (_, t) in enumerate(sorted(left, key=lambda r: (r[0] is None, r[0] or 0)))]
    order = sorted(left, key=lambda r: (r[0] is None, r[0] or 0))
    parts = brute_components(numbered, 5, 80)
    left = [order[n] for n, (_, c) in parts.items() if n == c]
    raws = [(t or "").encode() for _, t in left]
    count = {}
    for r in raws:
        for s in range(len(r) - 199):
            count[r[s : s + 200]] = count.get(r[s : s + 200], 0) + 1
    want = {}
    encode = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for (i, t), r in zip(left, raws, strict=True):
        gone = bytearray(len(r))
        for s in range(len(r) - 199):
            if count[r[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore")
        want[(i, kept)] = len(encode.encode(kept, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    expected = {}
    for (i, _), n in want.items():
        expected[i] = expected.get(i, 0) + n
    assert tokens == expected and None in tokens


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scores_of_odd_rows(spark):
    rows = labelled(5, 400)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([Row(doc_id=i, toxic=y, quality=1) for i, _, y in rows])
    odd = frame(spark, [(1, "zworfel"), (1, "zworfel"), (1, "plain"), (None, "zworfel"), (None, None), (2, "Z.w.o.r.f.e.l you")])
    got = sorted((str(r.doc_id), r.predicted, r.held_out) for r in score_documents(odd, train(docs, labels)).collect())
    assert len(got) == 6 and [p for i, p, _ in got if i == "1"] == [0, 1, 1] and not any(h for i, _, h in got if i == "None")


def test_stages_keep_columns_and_decide(spark, tmp_path):
    rows = labelled(2, 400)
    labels = spark.createDataFrame([Row(doc_id=i, toxic=y, quality=1) for i, _, y in rows])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    base = " ".join(f"word{k}" for k in range(80))
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(1000, base + " a"), (1001, base + " b"), (1002, base.upper() + " A")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean = toxicity_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    gone = {i for i, _, y in rows if y}
    left = {r.doc_id for r in clean.collect()}
    assert len(left & gone) < 0.1 * len(gone) and len(left) > 0.97 * (403 - len(gone))
    near = near_dedup_stage(spark, docs, "")
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80).items() if c == i}
    assert {r.doc_id for r in near.collect()} == want and 1001 not in want
    cut = {r.doc_id: r for r in suffix_dedup_stage(spark, docs, "").collect()}
    assert len(cut) == docs.count() and cut[1000].text == " a"[-1:] and cut[1000].n_chars == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed[0].__fields__) and len({r.doc_id for r in packed} & gone) < 0.1 * len(gone)
