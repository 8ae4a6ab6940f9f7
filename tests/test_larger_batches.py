"""What grows with a batch: how often its rows are read, and how much a task holds of them."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import markdown
from quillspark.operators import resolution, search, vector_index
from quillspark.streaming.ingest import index_notes

MENTION = "source_id long, type string, name string, aliases array<string>, confidence double, evidence string"
RELATION = "source_id long, subject string, relation string, object string, confidence double, evidence string"


def test_mentions_of_a_batch_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    rows = [(1, "tool", "Hammer", ["The  Hammer"], 0.9, "a"), (1, "tool", "Saw", None, 0.5, None), (2, "tool", "the hammer", [""], 0.7, "b"), (2, "tool", None, ["saw"], 0.6, None)]
    mentions = spark.createDataFrame(rows, MENTION).withColumn("name", counted("name"))
    said = spark.createDataFrame([(1, "hammer", "part_of", "SAW", 0.8, "a")], RELATION)
    entities = spark.createDataFrame([(10, "tool", "Saw", "saw", "accepted")], "id long, type string, name string, norm_name string, status string")
    aliases = spark.createDataFrame([(11, "tool", "The hammer", "the hammer")], "entity_id long, type string, alias string, norm_alias string")
    found = resolution.resolve(mentions, said, entities, aliases)
    edges = {(r.src_type, r.src_id, r.relation, r.dst_id, r.confidence, r.status) for r in found.edges.collect()}
    assert edges == {("source", 1, "mentions", 11, 0.9, "proposed"), ("source", 1, "mentions", 10, 0.5, "proposed"), ("source", 2, "mentions", 11, 0.7, "proposed"), ("entity", 11, "part_of", 10, 0.8, "proposed")}
    assert [tuple(r) for r in found.parents.collect()] == [(11, 10)] and read.value == len(rows)


def test_chunks_are_given_back_for_a_few_notes_at_once():
    notes = pd.Series([None, "", *(f"# H{k}\n\n" + "Some words. " * (k * 7) for k in range(150))])
    parts = list(markdown.chunk_note.func(iter([notes, notes[:1]])))
    assert max(map(len, parts)) <= 64 and sum(map(len, parts)) == len(notes) + 1
    got = [[(c["ordinal"], c["headings"], c["content"]) for c in own] for part in parts for own in part]
    assert got == [markdown.chunk(n or "") for n in [*notes, None]]


def test_a_batch_of_notes_is_parsed_and_chunked_by_one_worker_a_task(spark):
    texts = [None, "", "---\ntitle: T\ntags: [a, b]\n---\n# H\n\ntext", "---\n- no mapping\n---\nbody", *(f"# H{k}\n\n" + "Some words. " * (k * 7) for k in range(100))]
    rows = [(f"f/n{k}.md", str(k), t, None) for k, t in enumerate(texts)] + [("x.md", "x", "gone", "encoding")]
    found = index_notes(spark.createDataFrame(rows, "path string, hash string, text string, read_error string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = []
    for path, mark, text, error in rows:
        title, body, _, _, _, tags = markdown.parse(text or "", path)
        want += [(path, mark, title, tags, n, above, part) for n, above, part in markdown.chunk(body) if not error]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_cells_of_queries_are_given_back_in_bounded_batches():
    batch = pa.RecordBatch.from_pydict({"query_id": [*range(20)], "query_vector": [[float(k), 1.0] for k in range(20)], "by": [""] * 20})
    parts = list(vector_index.with_cells(lambda q: [np.arange(1000 if k else 0) for k in range(len(q))])(iter([batch])))
    assert max(p.num_rows for p in parts) <= search.STEP
    rows = [(r["query_id"], r["cell"], r["query_vector"]) for p in parts for r in p.to_pylist()]
    assert rows == [(k, c, [float(k), 1.0]) for k in range(1, 20) for c in range(1000)]


def shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    nothing = spark.sparkContext._jvm.java.util.ArrayList()
    stages = store.stageList(nothing, False, False, none, nothing)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_common_words_of_a_web_search_are_not_shuffled(spark):
    common = [f"c{k}" for k in range(40)]
    text = {k: " ".join(common[k % 5 :]) + (" rare" if k % 50 == 0 else "") for k in range(300)}
    chunks = spark.createDataFrame([(k, 10 * k, t) for k, t in text.items()], "doc_id long, chunk_id long, content string").repartition(4, "doc_id")
    queries = spark.createDataFrame([(1, " ".join([*common[5:], "rare"])), (2, 'rare "c38 c39" -c0'), (3, "rare absent")], "query_id int, text string")
    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    # as on large tables: only what is counted is sent to every task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.query_id, r.doc_id, r.hits) for r in search.web_matches(search.postings(chunks), chunks, queries).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # chunks with the rare word begin with c0, which the second search bars
    assert got == {(1, k, 36) for k in range(0, 300, 50)}
    rows = shuffled(spark) - before
    assert rows < 2 * sum(len(t.split()) for t in text.values()) // 3
