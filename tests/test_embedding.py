"""The store of vectors by content: claims, overlapping runs, stale texts."""

import pytest

from quillspark.operators.embedding import EmbeddingStore
from quillspark.sources.versions import Tables


def lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


def counting(path):
    """A model that notes every text it is called with."""

    def embed(texts):
        import uuid

        (path / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def called(path):
    return sorted(t for f in path.iterdir() for t in f.read_text().split("\n"))


def frame(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id int, text string")


def test_equal_texts_are_embedded_once_over_overlapping_runs(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    embed, store = counting(calls), EmbeddingStore(Tables(spark, f"{tmp_path}/t"), "m", dims=2, parts=4)
    texts = frame(spark, "a", "bb", "a", None, "ccc", "dddd")
    # the first run has claimed two keys and not written yet when the second one fills
    first = store.claim(store.missing(texts), "first", most=2)
    assert first.count() == 2
    assert store.fill(texts, embed, owner="second") == 2 and store.fill(texts, embed, owner="third") == 0
    from quillspark.operators.embedding import VECTOR, embedder

    store.write(first.mapInPandas(embedder(embed, 8, 2), VECTOR), "first")
    assert called(calls) == ["a", "bb", "ccc", "dddd"] and store.fill(texts, embed) == 0
    assert [(r.text, r.embedding and r.embedding[0]) for r in store.vectors(texts).orderBy("chunk_id").collect()] == [("a", 1.0), ("bb", 2.0), ("a", 1.0), (None, None), ("ccc", 3.0), ("dddd", 4.0)]
    assert store.tables.read(store.claims).count() == 0
    # another model has keys of its own
    assert EmbeddingStore(store.tables, "other", parts=4).fill(texts, embed) == 4


def test_claims_end_and_failures_leave_the_store_as_it_was(spark, tmp_path):
    store = EmbeddingStore(Tables(spark, f"{tmp_path}/t"), "m", parts=2)
    texts = frame(spark, "a", "b")
    assert store.claim(store.missing(texts), "dead", lease=10, now=1000.0).count() == 2
    assert store.claim(store.missing(texts), "late", lease=10, now=1005.0).count() == 0
    assert store.claim(store.missing(texts), "late", lease=1e9, now=1011.0).count() == 2
    with pytest.raises(Exception, match="vectors for"):
        store.fill(texts, lambda t: [], owner="late")
    assert store.missing(texts).count() == 2 and store.fill(texts, lengths, owner="late") == 2


def test_superseded_texts_are_passed_over(spark, tmp_path):
    store = EmbeddingStore(Tables(spark, f"{tmp_path}/t"), "m", parts=2)
    texts = frame(spark, "old state", "stays")
    assert store.fill(texts, lengths, current=lambda: frame(spark, "stays", "new state")) == 1
    assert [r.text for r in store.missing(texts).collect()] == ["old state"] and store.tables.read(store.claims).count() == 0
