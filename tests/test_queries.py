"""Registered queries on tables of their own, against their SQL or a plain count."""

import duckdb
import numpy as np
import pytest

from quillspark.plans import catalog, corpus


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(folder, name, used):
    con = duckdb.connect()
    for t in used:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.sql(catalog.SQL[name]).fetchall())


DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_tombstones_counts_no_note_that_died_at_that_time_before(spark, tmp_path):
    docs = [(k, "a\nb", "en", "s", 3) for k in range(1500)]
    # notes 702 and 1422 have been deleted at the very time of the query
    sf = tables(spark, tmp_path, documents=(docs, DOCUMENTS), labels=([(k, None, 1) for k in (1, 702, 1422)], LABELS))
    got = [tuple(r) for r in catalog.QUERIES["tombstones"](spark, sf).collect()]
    assert got == by_sql(sf, "tombstones", ["documents", "labels"]) and got[0][0] == 149


def test_index_search_gives_what_its_sql_gives_beyond_its_reach(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((4, 8))
    # some vectors are copies, so that ranks are ties; 2000 are more than the cells of the first search hold
    rows = [(k, [round(float(x), 2) for x in base[k % 4] * (k % 3 > 0) + rng.standard_normal(8)], k % 5) for k in range(2000)]
    rows += [(2000 + k, rows[0][1], 0) for k in range(300)]
    sf = tables(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(tuple(r) for r in catalog.QUERIES["knn_index_top200"](spark, sf).collect())
    want = by_sql(sf, "knn_index_top200", ["embeddings"])
    assert len(got) == 115 * 200 and {(q, r): v for q, v, _, r in got} == {(q, r): v for q, v, _, r in want}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_counted_where_their_document_lies(spark, tmp_path):
    docs = [(k, f"alpha beta w{k}\nbeta gamma beta", "en", "s", 30) for k in range(60)]
    sf = tables(spark, tmp_path, documents=(docs, DOCUMENTS), labels=([(3, None, 1)], LABELS), benchmark=([(1, "alpha gamma w7"), (2, "beta beta")], "item_id long, text string"))
    assert exchanges(catalog.QUERIES["tokenise_postings"](spark, sf)) == 1
    for name in ("tokenise_postings", "fts_or_rank", "chat_pool_top200", "text_index_search", "text_index_frequencies"):
        got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, sf).collect())
        assert got == by_sql(sf, name, ["documents", "labels", "benchmark"]) and got, name


def test_text_is_shuffled_once_where_labels_are_many(spark, tmp_path):
    docs = [(k, f"alpha w{k}\nbeta", "en", "s", 12) for k in range(60)]
    sf = tables(spark, tmp_path, documents=(docs, DOCUMENTS), labels=([(k, None, int(k % 5 == 0)) for k in range(40)], LABELS))
    # without a broadcast, and with other partitions of joins than pieces of documents
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "3"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines = corpus.chunks(spark, sf)
        # documents by their ids, and labels to them
        assert exchanges(lines) == 2 and exchanges(lines.groupBy("doc_id").count()) == 2
        assert sorted(r.doc_id for r in lines.collect()) == sorted([k for k in range(60) if k >= 40 or k % 5] * 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
