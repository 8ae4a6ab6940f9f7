"""A text index that grows by edits against one built anew."""

import random

from pyspark.sql import functions as F

from quillspark.operators import search, text_index
from quillspark.operators.text_index import TextIndex
from quillspark.sources.versions import Tables

CHUNK = "doc_id long, chunk_id long, content string, heading string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "straße", "x1", "zeta", "eta"]


def chunks_of(rng, doc):
    return [(doc, doc * 100 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8))), f"Head{doc % 3}") for k in range(rng.randint(1, 3))]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "chunk_id", "pos", "term", "weight").collect()))


def frequencies(df):
    return {r.term: r.n for r in df.groupBy("term").agg(F.countDistinct("chunk_id").alias("n")).collect()}


def test_edits_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    index, now = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=4), {}
    for batch in range(4):
        edited = {d: chunks_of(rng, d) for d in (range(20) if batch == 0 else rng.sample(range(24), 5))}
        gone = [] if batch == 0 else [d for d in rng.sample(range(24), 3) if d not in edited]
        now = {**{d: c for d, c in now.items() if d not in gone}, **edited}
        before = index.tables.parts("postings")
        index.update(spark.createDataFrame([c for own in edited.values() for c in own], CHUNK), spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        assert all(index.tables.parts("postings")[p] == own for p, own in before.items())  # older segments stay as they are
        want = search.postings(spark.createDataFrame([c for own in now.values() for c in own], CHUNK))
        assert rows(index.rows()) == rows(want)
        assert {r.term: r.n for r in index.frequencies().collect()} == frequencies(want)
    asked = spark.createDataFrame([(1, "alpha"), (1, "head1"), (2, "straße"), (2, "nowhere")], "query_id int, term string")
    found = sorted(map(tuple, search.matches(index.rows(asked), asked).collect()))
    assert found == sorted(map(tuple, search.matches(want, asked).collect())) and found
    assert index.segments() == [1, 2, 3, 4]
    index.merge()
    assert index.segments() == [5] and index.tables.parts("tombstones") == {}
    assert rows(index.rows()) == rows(want) and {r.term: r.n for r in index.frequencies().collect()} == frequencies(want)
    assert sorted(map(tuple, search.matches(index.rows(asked), asked).collect())) == found
    index.update(spark.createDataFrame(chunks_of(rng, 5), CHUNK), spark.createDataFrame([(7,)], "doc_id long"))
    assert 7 not in {r.doc_id for r in index.rows().collect()}


def test_searches_name_their_parts_and_terms(spark, tmp_path):
    index = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=16)
    data = [(k, k, f"word{k} common", "") for k in range(200)]
    index.update(spark.createDataFrame(data[:150], CHUNK))
    index.update(spark.createDataFrame(data[150:], CHUNK))
    found = index.rows(spark.createDataFrame([("word7",)], "term string"))
    read = [f for f in found.inputFiles() if "/postings-" in f]
    assert [r.doc_id for r in found.collect()] == [7] and 1 <= len(read) <= 2  # one part of each segment
    assert "In(term" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(term" in found._jdf.queryExecution().executedPlan().toString()
    assert index.rows(spark.createDataFrame([("word7",), ("word8",)], "term string"), most=1).count() == 2


def test_empty_notes_marks_and_merging_by_itself(spark, tmp_path):
    index = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=2, most_segments=2)
    assert index.rows().count() == 0 and index.frequencies().count() == 0
    frame = lambda *r: spark.createDataFrame(r, CHUNK)
    version = index.update(frame((1, 10, "one two", ""), (2, 20, "two", "")), mark=("s", 0))
    assert index.update(frame((1, 10, "changed", "")), mark=("s", 0)) == version
    index.update(frame((1, 11, "", "")))  # a note whose text is empty
    assert rows(index.rows()) == [(2, 20, 0, "two", 0.1)] and {r.term: r.n for r in index.frequencies().collect()} == {"two": 1}
    assert len(index.rows(version=version).collect()) == 3
    index.update(frame(), spark.createDataFrame([(2,)], "doc_id long"))
    assert len(index.segments()) <= 1 and index.rows().count() == 0 and index.frequencies().count() == 0


def test_a_common_term_is_sorted_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 40)
    index = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=2)
    data = [(k, k, f"the word{k % 3} the", "") for k in range(300)]
    index.update(spark.createDataFrame(data, CHUNK))
    asked = spark.createDataFrame([(1, "the")], "query_id int, term string")
    files = lambda: {f for f in index.rows(asked).inputFiles() if "/postings-" in f}
    assert len(files()) > 3 and rows(index.rows()) == rows(search.postings(spark.createDataFrame(data, CHUNK)))
    assert {(r.doc_id, r.hits) for r in search.matches(index.rows(asked), asked).collect()} == {(k, 2) for k in range(300)}
    index.merge()
    assert len(files()) > 3 and index.rows().count() == 900 and {r.term: r.n for r in index.frequencies().collect()}["the"] == 300


def test_postings_of_a_search_are_dealt_by_notes_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 100)
    index = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=2)
    data = [(k, 10 * k, f"the word{k} the", "") for k in range(300)]
    index.update(spark.createDataFrame(data, CHUNK))
    index.update(spark.createDataFrame([(5, 50, "of the", "")], CHUNK), spark.createDataFrame([(6,)], "doc_id long"))
    asked = spark.createDataFrame([(1, "the"), (2, "word7"), (2, "the")], "query_id int, term string")
    found, few = index.rows(asked), index.rows(asked, most=1)
    # 301 terms of chunks are asked for at first, a quarter of 100 of them lie in a task
    assert found.rdd.getNumPartitions() == few.rdd.getNumPartitions() == search.matches(found, asked).rdd.getNumPartitions() == 12
    assert rows(found) == rows(few)
    hits = {(r.query_id, r.doc_id): r.hits for r in search.matches(found, asked).collect()}
    assert hits == {(q, k): 2 - (k == 5) + (q == 2 and k == 7) for q in (1, 2) for k in range(300) if k != 6}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_of_a_large_batch_stay_where_their_chunks_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 10)
    staged, stage = {}, Tables.stage
    monkeypatch.setattr(Tables, "stage", lambda self, name, rows, **more: staged.setdefault(name, []).append(exchanges(rows)) or stage(self, name, rows, **more))
    index, data = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=2), [(k, 10 * k + i, f"the word{k} the", None) for k in range(200) for i in range(2)]
    index.update(spark.createDataFrame(data, CHUNK).repartition(8, "doc_id"))
    # the one exchange deals the chunks; each of the 8 pieces is in one of the two parts of the notes
    assert staged["postings"] == staged["notes"] == [1] and len(index.tables.read("notes").inputFiles()) == 8
    for sent in (text_index.SENT, 3):
        monkeypatch.setattr(text_index, "SENT", sent)
        edited = [(k, 10 * k, f"of word{k % 7}", "Head") for k in range(0, 200, 2)]
        data = [c for c in data if c[0] % 2 and c[0] != 9 + sent % 2] + edited
        index.update(spark.createDataFrame(edited, CHUNK).repartition(4, "doc_id"), spark.createDataFrame([(9 + sent % 2,)], "doc_id long"))
        want = search.postings(spark.createDataFrame(data, CHUNK))
        assert rows(index.rows()) == rows(want) and {r.term: r.n for r in index.frequencies().collect()} == frequencies(want)
    index.merge()
    assert rows(index.rows()) == rows(want) and {r.term: r.n for r in index.frequencies().collect()} == frequencies(want)


def test_repeated_chunks_and_chunks_without_text_count_as_in_a_plain_count(spark, tmp_path):
    index = TextIndex(Tables(spark, f"{tmp_path}/t"), parts=2)
    data = [(1, 10, "one two two", "two"), (1, 10, "one three", ""), (1, 11, "two", None), (2, 20, None, "lost"), (3, 30, " .\n", ""), (None, None, "nobody", "")]
    index.update(spark.createDataFrame(data, CHUNK))
    want = search.postings(spark.createDataFrame(data, CHUNK))
    counted = {t: n for t, n in frequencies(want).items() if n}
    assert {r.term: r.n for r in index.frequencies().collect()} == counted == {"one": 1, "two": 2, "three": 1}
    index.update(spark.createDataFrame([(1, 10, "one", "")], CHUNK), spark.createDataFrame([(3,), (None,)], "doc_id long"))
    assert {r.term: r.n for r in index.frequencies().collect()} == {"one": 1}
