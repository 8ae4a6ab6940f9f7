"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm.common import Scratch
from quillspark.llm.lexical_search import Bisection, ClusteredIndex, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def docs_frame(spark, docs):
    return spark.createDataFrame([(i, t, "w", 5, 9) for i, t in docs], "doc_id long, text string, terms string, id int, query int").repartition(3)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, id int, bound string")


def made(seed=4, n=400):
    rng = random.Random(seed)
    topics = [[f"w{t}x{k}" for k in range(12)] for t in range(6)]
    common = ["The", "of", "é", "日本", "a1"]
    docs = []
    for i in range(n):
        topic = rng.choice(topics)
        docs.append((i * 3, " ".join(rng.choice(topic if rng.random() < 0.6 else common) for _ in range(rng.randint(0, 25)))))
    docs += [(5000 - k, "w0x1 w0x2 the copy w0x3") for k in range(60)] + [(None, "w1x1 w1x2"), (None, None), (7, None), (8, ""), (9, "?! ."), (12, "w2x1 w2x1 OF"), (12, "w2x1 w2x1 of")]
    docs.append((6000, "w3x1 " * 5000 + "the of"))
    items = [(k, " ".join(rng.choice(topics[k % 6] + common) for _ in range(rng.randint(1, 9)))) for k in range(25)]
    items += [(100, "w0x1 w0x2 the copy"), (100, "w0x1 w0x2 the copy"), (101, None), (102, "never seen"), (103, "W0X1 w0x1"), (None, "w1x1 the")]
    return docs, items


@pytest.mark.parametrize("setting", [{}, {"cluster_rows": 8, "first_visits": 1, "shard_rows": 16, "query_block": 7}, {"vocabulary_held": 3, "block_bytes": 300, "cluster_rows": 40}])
def test_search_equals_brute_force(spark, setting):
    docs, items = made()
    got = ranked_search(docs_frame(spark, docs), items_frame(spark, items), top=5, **setting)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items, 5)


def test_few_results_and_empty_tables(spark):
    docs, items = made(n=10)
    assert ranked_search(docs_frame(spark, []), items_frame(spark, items)).count() == 0
    assert ranked_search(docs_frame(spark, docs), items_frame(spark, [])).count() == 0
    assert ranked_search(docs_frame(spark, [(1, None), (2, "")]), items_frame(spark, items)).count() == 0
    got = ranked_search(docs_frame(spark, docs), items_frame(spark, items), top=500)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items, 500)


def test_clusters_hold_topics_and_bounds_skip_them(spark):
    docs, items = made(n=600)
    asked = items_frame(spark, items).selectExpr("item_id AS query", "text")
    with Scratch(spark) as scratch:
        index = ClusteredIndex(scratch, docs_frame(spark, docs).selectExpr("coalesce(doc_id, 1) AS id", "text"), asked, 64, 60, 2000, 1000, 1 << 20)
        bounds = index.bounds().collect()
        clusters = {b.cluster for b in bounds}
        assert len(clusters) > 4
        # a query of one topic's words has most of its bound in few clusters
        spread = [len([b for b in bounds if b["query"] == q and 2 * b.bound > max(x.bound for x in bounds if x["query"] == q)]) for q in range(6)]
        assert min(spread) < len(clusters) / 2
        assert index.rows.where("size(places) > 64").count() == 0


def test_bisection_lowers_the_cost_of_gaps():
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.choice(np.arange(40) + 40 * (k % 8), 10)) for k in range(512)]
    tree = Bisection(docs, 3)
    of = tree.clusters(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs), len(docs))
    kinds = [len(np.unique(of[k::8])) for k in range(8)]
    assert len(np.unique(of)) == 8 and sum(kinds) <= 16  # eight topics in eight clusters, nearly one each
