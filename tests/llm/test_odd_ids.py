"""Rows whose ids are null or repeat, and labels of any type."""

import numpy as np
import public_tokenizers as P
import pytest

from quillspark.llm.embedding_dedup import near_vectors
from quillspark.llm.packing import pack_documents


def brute(rows):
    """(n_links, component) of each row, by its place."""
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [[b for b in range(len(rows)) if a != b and rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98] for a in range(len(rows))]
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in set(links[todo.pop()]) - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[k][0], len(links[k]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_null_and_repeated_ids_have_links_of_their_own(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 8))
    label = {"int": lambda k: k % 2, "string": lambda k: ["a,b", 'a"', "ä"][k % 3], "bigint": lambda k: (1 << 40) + k % 2}[kind]
    rows = []
    for k in range(240):
        own = None if k % 7 == 0 else (k % 5 if k % 3 == 0 else (1 << 60) + k)
        rows.append((own, [float(x) for x in base[k % 12] + rng.standard_normal(8) * 0.03], None if k % 41 == 5 else label(k // 12)))
    rows += [(None, rows[1][1], rows[1][2]), (9, rows[1][1], rows[1][2]), (None, [9.0] + [0.0] * 7, label(0))]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = near_vectors(frame, leaf_rows=1000, block=16).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    forest = near_vectors(frame, leaf_rows=32, block=16, spill=0.05, trees=6).collect()
    assert len(forest) == len(rows) and sum(r.n_links for r in forest) >= 0.95 * sum(n for _, n, _ in brute(rows))


def test_many_null_and_repeated_ids_are_dealt_to_many_groups(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(1 << 60 | 1, f"more {k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pack_documents(frame, P.path("byte_bpe_50k.json"), size=64, group_rows=50).collect()
    assert sorted({r.doc_id or 0 for r in got}) == [0, 1 << 60 | 1] and sum(r.doc_id is None for r in got) == 300 == sum(r.doc_id is not None for r in got)
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) == 12 and max(groups.values()) < 100
