"""The inverted vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import resolution, search
from quillspark.operators.vector_index import VectorIndex
from quillspark.sources.versions import Tables


def clustered(n=1500, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((25, dim))
    return [(k, [float(x) for x in base[k % 25] + rng.standard_normal(dim) * 0.35], "ab"[k % 2]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string").repartition(3)


def queries(rows, step=20):
    return rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "kind")


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def test_recall_is_tuned_and_only_probed_cells_are_read(spark, tmp_path):
    rows = frame(spark, clustered())
    index = VectorIndex(Tables(spark, f"{tmp_path}/t"))
    index.build(rows)
    probes = index.tune(10)
    cells = len(index.sizes(index.tables.latest()))
    assert 30 <= cells <= 39 and probes < cells / 2
    exact, found = pairs(search.knn(rows, queries(rows), 10)), index.search(queries(rows), 10)
    assert len(exact & pairs(found)) >= 0.9 * len(exact)
    one = index.search(queries(rows).where("query_id = 40"), 10, reach=1)
    assert len({f.split("part=")[1].split("/")[0] for f in one.inputFiles()}) == probes
    assert pairs(index.search(queries(rows), 10, probes=cells)) == exact


def test_puts_equal_a_rebuild_and_others_folders_stay(spark, tmp_path):
    rows = clustered(600)
    index = VectorIndex(Tables(spark, f"{tmp_path}/t"))
    index.build(frame(spark, rows[:500]), cells=12)
    before = index.tables.parts(index.rows)
    moved = [(7, rows[8][1], "a"), (3, rows[3][1], "b")] + rows[500:] + [(900, None, "a"), (901, [0.0] * 12, "a"), (902, [float("nan")] * 12, "a")]
    index.put(frame(spark, moved), gone=spark.createDataFrame([(11,), (99_999,)], "vec_id long"))
    now = frame(spark, [r for r in rows[:500] if r[0] not in (7, 3, 11)] + moved[:-3])
    asked = queries(now, 7)
    assert pairs(index.search(asked, 15, probes=12)) == pairs(search.knn(now, asked, 15))
    after = index.tables.parts(index.rows)
    assert sum(after[p][: len(own)] == own for p, own in before.items() if p in after) >= len(before) - 3  # only cells of 7, 3 and 11 are anew
    index.put(frame(spark, []), gone=now.select("vec_id"))
    assert index.search(asked, 5).count() == 0 and index.tables.parts(index.rows) == {}


def test_large_batches_and_kinds(spark, tmp_path, monkeypatch):
    rows = frame(spark, clustered(400))
    index = VectorIndex(Tables(spark, f"{tmp_path}/t"))
    index.build(rows, cells=6)
    want = [(r.query_id, r.vec_id, r.rank) for r in index.search(queries(rows, 5), 4, by="kind").orderBy("query_id", "rank").collect()]
    exact = [(r.query_id, r.vec_id, r.rank) for r in search.knn(rows, queries(rows, 5), 4, by="kind").orderBy("query_id", "rank").collect()]
    assert want == exact and all(a % 2 == b % 2 for a, b, _ in want)
    monkeypatch.setattr(search, "SMALL_BATCH", 9)
    assert [(r.query_id, r.vec_id, r.rank) for r in index.search(queries(rows, 5), 4, by="kind").orderBy("query_id", "rank").collect()] == want
    assert [(r.query_id, r.vec_id, r.rank) for r in search.knn(rows, queries(rows, 5), 4, by="kind").orderBy("query_id", "rank").collect()] == want


def test_spaces_are_apart_and_have_one_dimension(spark, tmp_path):
    tables = Tables(spark, f"{tmp_path}/t")
    narrow, wide = VectorIndex(tables, "narrow"), VectorIndex(tables, "wide")
    narrow.build(frame(spark, clustered(60, 4)))
    wide.build(frame(spark, clustered(60, 6)))
    rows = frame(spark, clustered(60, 6))
    assert pairs(wide.search(queries(rows), 3)) == pairs(search.knn(rows, queries(rows), 3))
    assert all("-narrow-" in f or "/vectors-narrow" in f for f in narrow.search(queries(frame(spark, clustered(60, 4))), 3).inputFiles())
    with pytest.raises(Exception, match="dimensions"):
        narrow.put(rows)
    with pytest.raises(ValueError, match="dimensions"):
        narrow.build(rows.union(frame(spark, clustered(5, 4))))
    empty = VectorIndex(tables, "empty")
    empty.build(frame(spark, []))
    assert empty.search(queries(rows), 3).count() == 0


def test_similar_names_by_cells_and_exactly(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = clustered(300)
    vectors = spark.createDataFrame([(k, v) for k, v, _ in rows] + [(1000 + k, rows[5][1]) for k in range(40)], "id long, embedding array<double>")
    entities = spark.createDataFrame([(k, t, "rejected" if k % 50 == 1 else "accepted") for k, _, t in rows] + [(1000 + k, "b", "accepted") for k in range(40)], "id long, type string, status string")
    asked = [("ab"[k % 2], f"n{k}", [float(x) for x in np.array(rows[k][1]) + rng.standard_normal(12) * 0.02]) for k in range(0, 300, 3)] + [("b", "same", rows[5][1]), ("b", "again", rows[5][1]), ("c", "no type", rows[5][1]), ("a", "none", None)]
    names = spark.createDataFrame(asked, "type string, norm string, vector array<double>")
    truth = {}
    for t, n, v in asked:
        best = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), k) for k, w, u in rows if v is not None and u == t and k % 50 != 1]
        if best and min(best)[0] <= -0.9:
            truth[t, n] = min(best)[1]
    got = {(r.type, r.norm): r.id for r in resolution.similar(names, vectors, entities).collect()}
    assert got == truth and got["b", "same"] == 5
    index = VectorIndex(Tables(spark, f"{tmp_path}/t"))
    index.build(resolution.open_vectors(vectors, entities))
    index.tune(10)
    by_cells = {(r.type, r.norm): r.id for r in resolution.similar(names, vectors, entities, index=index).collect()}
    assert sum(by_cells.get(k) == v for k, v in truth.items()) >= 0.9 * len(truth)
