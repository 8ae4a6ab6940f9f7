"""Golden cases and scenarios of the library's own operators."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.markdown import LIMIT, SHARED, chunk, json_safe, parse, split_front, tags_of
from quillspark.operators import evaluation, graph, ingest, search
from quillspark.sources.versions import Tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tags_terms_and_names(spark):
    assert one(spark, X.normalise_tags(F.lit("#A, b  ##c,a"))) == ["a", "b", "c"]
    assert one(spark, X.normalise_tags(F.lit("x" * 101 + ",ok"))) == ["ok"]
    assert len(one(spark, X.normalise_tags(F.lit(",".join(f"t{k}" for k in range(70)))))) == 64
    assert one(spark, X.chat_terms(F.lit("Why is nas-01 slow at v1.2 with Proxmox backups?"))) == ["nas-01", "v1.2", "proxmox", "backups", "slow", "with", "why"]
    assert one(spark, X.normalise_name(F.lit("  Straße   Ⅳ"))) == "strasse iv"
    assert one(spark, X.deep_link(F.lit("My vault"), F.lit("a b/ü*.md"))) == "obsidian://open?vault=My%20vault&file=a%20b%2F%C3%BC%2A.md"
    assert one(spark, X.excerpt(F.lit("a  <b>\n& c"))) == "a &lt;b&gt; &amp; c"
    assert one(spark, X.trail(F.lit("T"), F.array(F.lit("T"), F.lit("U")))) == ["U"]


def test_chunker_edges():
    assert chunk("```\n# not a heading\n```\n# Learning C#\ntext") == [(0, [], "```\n# not a heading\n```"), (1, ["Learning C#"], "text")]
    assert [len(c) for _, _, c in chunk("x" * 1600)] == [1600]
    token = [c for _, _, c in chunk("x" * 5000)]
    assert all(len(c) <= LIMIT for c in token) and token[0] == "x" * 1398 and token[1].startswith("x" * SHARED + "\n\n")
    paragraphs = [c for _, _, c in chunk("\n\n".join(["word " * 90] * 12))]
    assert all(len(c) <= LIMIT for c in paragraphs) and all(b.startswith("word") for b in paragraphs) and len(paragraphs) == 4
    sentences = [c for _, _, c in chunk("One two three four. " * 200)]
    assert all(len(c) <= LIMIT for c in sentences) and all("  " not in c for c in sentences)
    assert chunk("# A\n\n## B\nb\n# C\nc") == [(0, ["A", "B"], "b"), (1, ["C"], "c")]
    assert chunk("   ### Deep ##\nd\n#no\n~~~\n# code\n~~~~ x\n# After\na") == [(0, ["Deep"], "d\n#no\n~~~\n# code\n~~~~ x"), (1, ["After"], "a")]


def test_notes_are_parsed():
    text = "---\ntitle: Hi\ntags:\n- a\n- B\n- 3\nwhen: 2024-01-02\nsize: .inf\n---\n[[x|y]] [[x]]\n```\n[[z]]\n```\n`[[w]]` [[n#h|a]]"
    title, body, front, broken, links, tags = parse(text, "p/q.md")
    assert (title, broken, links, tags) == ("Hi", False, ["x", "n"], ["a", "b"]) and body.startswith("[[x|y]]")
    assert front == '{"size": "inf", "tags": ["a", "B", 3], "title": "Hi", "when": "2024-01-02"}'
    assert parse("text\n## Sub\n# Head\n", "p/q.md")[0] == "Head" and parse("```\n# no\n", "p/q.r.md")[0] == "q.r"
    for bad in ("---\nbroken\n---\nx", "---\na: [\n---\nx", "---\n- 1\n---\nx"):
        assert split_front(bad) == (None, bad, True)
    assert json_safe({1: (float("nan"), "a\x00", {2})}) == {"1": ["nan", "a", [2]]}
    import datetime

    odd = {None: datetime.date(2026, 1, 2), True: ["\\u0000", "\\\x00", -float("inf"), 1.5], (1, 2): {"x": {"b", "a"}}, "n\x00": object}
    assert json_safe(odd) == {"None": "2026-01-02", "True": ["\\u0000", "\\", "-inf", 1.5], "(1, 2)": {"x": ["a", "b"]}, "n": str(object)}
    assert [tags_of(v) for v in (None, 5, {"a": 1}, "#A, b  ##c,a", ["X", 1, "#x", "y" * 101])] == [[], [], [], ["a", "b", "c"], ["x"]]
    assert len(tags_of([f"t{k}" for k in range(70)])) == 64


def test_web_search_takes_all_words_phrases_or_and_not(spark):
    lines = {1: "red disk in the old box", 2: "old disk red", 3: "Red disk, new", 4: "box or bag", 5: "nas-01 disk", 6: "01 nas disk red"}
    chunks = spark.createDataFrame([(k, k * 10, v) for k, v in lines.items()], "doc_id long, chunk_id long, content string")
    words = " ".join(f"w{k}" for k in range(40))
    full, cut = spark.createDataFrame([(7, 70, words)], chunks.schema), spark.createDataFrame([(8, 80, words.rsplit(" ", 1)[0])], chunks.schema)
    want = {
        "red disk": {1, 2, 3, 6}, "red disk disk": {1, 2, 3, 6}, '"red disk"': {1, 3}, '"red disk': {1, 3}, "red -old": {3, 6}, 'disk -"red disk"': {2, 5, 6}, "new or bag": {3, 4},
        "old box or new": {1, 3}, "box or": {4}, "or": {4}, "nas-01": {5}, "in": {1}, "-disk": {4, 7, 8}, "%% red & (old)": {1, 2}, "%% or bag": {4}, '"" -': set(), "red absent": set(), words: {7}, "--bag": {4},
    }
    queries = spark.createDataFrame([Row(query_id=k, text=t) for k, t in enumerate(want)] + [Row(query_id=99, text=None)])
    live = chunks.union(full).union(cut)
    found = search.web_matches(search.postings(live), live, queries).collect()
    got = {t: {r.doc_id for r in found if r.query_id == k} for k, t in enumerate(want)}
    assert got == want and len(found) == sum(map(len, want.values()))
    assert {(r.doc_id, r.hits) for r in found if r.query_id == 0} == {(1, 2), (2, 2), (3, 2), (6, 2)}


def test_evidence_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([Row(query_id=1, rank=k + 1, doc_id=k, size=s) for k, s in enumerate([5000, 4000, 2000, 900])])
    assert [r["rank"] for r in search.evidence(hits).orderBy("n").collect()] == [1, 3, 4]
    crowd = spark.createDataFrame([Row(query_id=1, rank=k + 1, doc_id=0, size=1) for k in range(5)])
    assert search.evidence(crowd).count() == 2


@pytest.mark.parametrize(("missing", "live", "trips"), [(10, 40, False), (11, 40, True), (11, 100, False)])
def test_guard(spark, missing, live, trips):
    assert one(spark, ingest.guard_trips(F.lit(missing), F.lit(live))) is trips


def test_moves_reconcile_and_upsert(spark):
    gone = spark.createDataFrame([("h", "a/b/x.md"), ("h", "c/x.md"), ("g", "z.md")], "hash string, path string")
    new = spark.createDataFrame([("h", "a/b/y.md"), ("h", "d/x.md"), ("q", "n.md")], "hash string, path string")
    assert sorted(map(tuple, ingest.pair_moves(gone, new).collect())) == [("a/b/x.md", "a/b/y.md"), ("c/x.md", "d/x.md")]
    assert ingest.pair_moves(gone.limit(0), new).count() == 0
    cases = [(["Projects/NAS/x.md", "Archive/x.md", "Projects/Other/x.md"], ["Projects/NAS/y.md"], [("Projects/NAS/x.md", "Projects/NAS/y.md")]), (["b/x.md", "a/x.md"], ["c/x.md"], [("a/x.md", "c/x.md")]), (["Note.md"], ["note.md"], [("Note.md", "note.md")])]
    for old_paths, new_paths, want in cases:
        frames = [spark.createDataFrame([("h", p) for p in paths], "hash string, path string") for paths in (old_paths, new_paths)]
        assert [tuple(r) for r in ingest.pair_moves(*frames).collect()] == want
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size int, mtime int")
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size int, mtime int")
    assert {r.path: r.change for r in ingest.reconcile(old, now).collect()} == {"a": "same", "b": "changed", "c": "missing", "d": "new"}
    edges = spark.createDataFrame([(1, "user", "rejected"), (2, "auto", "proposed")], "id int, by string, status string")
    fresh = spark.createDataFrame([(1, "auto", "proposed"), (2, "auto", "accepted"), (3, "auto", "proposed")], "id int, by string, status string")
    assert {r.id: r.status for r in ingest.upsert(edges, fresh, ["id"], F.col("by") == "user").collect()} == {1: "rejected", 2: "accepted", 3: "proposed"}


def test_observation_ladder(spark):
    rows = [
        ("e", None, False, False, "failed", False), (None, None, False, False, "new", True), ("e", "failed", True, False, "unchanged", False),
        (None, "indexed", True, False, "unchanged", False), (None, "pending", False, False, "new", True), (None, "indexed", True, True, "restored", True), (None, "superseded", False, False, "requeued", True),
    ]
    frame = spark.createDataFrame([r[:4] for r in rows], "read_error string, known_state string, is_current boolean, was_deleted boolean")
    assert [(r.outcome) for r in ingest.classify(frame).collect()] == [r[4] for r in rows]


def test_evaluation(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 10)], "query_id int, rank int")
    assert tuple(evaluation.summary(ranks).first()) == (4, 0.75, round(1.6 / 4, 6), 0.25)
    hits = spark.createDataFrame([(1, k, p) for k, p in enumerate("aaab")], "query_id int, position int, path string")
    assert evaluation.first_rank(hits, spark.createDataFrame([(1, "b")], "query_id int, path string")).first()["rank"] == 2


def test_stream_replay_adds_nothing(spark, tmp_path):
    from quillspark.streaming.ingest import watch

    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_bytes("# T\r\nbody é".encode())
    (root / "sub" / "b.md").write_bytes(b"\xff\xfe")
    (root / "c.txt").write_text("no")
    for n in range(2):
        watch(spark, str(root), f"{tmp_path}/tables", f"{tmp_path}/checkpoint{n}").awaitTermination()
    revisions = {r.path: r.read_error for r in Tables(spark, f"{tmp_path}/tables").read("revisions").collect()}
    assert revisions == {"a.md": None, "sub/b.md": "encoding"} and Tables(spark, f"{tmp_path}/tables").read("revisions").count() == 2
    assert [(r.path, r.title, r.content) for r in Tables(spark, f"{tmp_path}/tables").read("chunks").collect()] == [("a.md", "T", "body é")]


def test_edited_notes_lose_their_old_chunks(spark, tmp_path):
    from quillspark.streaming.ingest import watch

    root = tmp_path / "vault"
    root.mkdir()
    (root / "a.md").write_text("# One\nfirst")
    (root / "big.md").write_text("x" * (1 << 21))
    (root / "b.md").write_text("stays")
    watch(spark, str(root), f"{tmp_path}/t", f"{tmp_path}/c", ["skip/**"]).awaitTermination()
    (root / "edit.md").write_text("second")
    (root / "a.md").unlink()
    (root / "edit.md").rename(root / "a.md")
    for n in range(2):
        watch(spark, str(root), f"{tmp_path}/t", f"{tmp_path}/c{n}", ["skip/**"]).awaitTermination()
    assert sorted((r.path, r.content) for r in Tables(spark, f"{tmp_path}/t").read("chunks").collect()) == [("a.md", "second"), ("b.md", "stays")]
    assert sorted((r.path, r.read_error or "") for r in Tables(spark, f"{tmp_path}/t").read("revisions").collect()) == [("a.md", ""), ("a.md", ""), ("b.md", ""), ("big.md", "too_large")]


def test_states_of_notes_in_a_stream(spark, tmp_path):
    import json

    from quillspark.streaming.ingest import observe

    steps = [("a", "h1", None), ("a", "h1", None), ("a", "h2", None), ("a", "h1", None), ("a", None, None), ("a", "h1", None), ("b", "x", "encoding"), ("b", "x", "encoding")]
    (tmp_path / "in").mkdir()
    schema = "path string, hash string, read_error string, seen_at long"
    found = []
    for part in (steps[:3], steps[3:]):
        at = len(list((tmp_path / "in").iterdir())) * 100
        (tmp_path / "in" / f"{at}.json").write_text("\n".join(json.dumps({"path": p, "hash": h, "read_error": e, "seen_at": at + k}) for k, (p, h, e) in enumerate(part)))
        stream = observe(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
        stream.writeStream.format("json").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("path string, hash string, outcome string, queued boolean").json(f"{tmp_path}/out").collect()
    assert sorted(r.outcome for r in found if r.path == "a") == sorted(["new", "unchanged", "new", "requeued", "deleted", "restored"])
    assert sorted(r.outcome for r in found if r.path == "b") == ["failed", "unchanged"] and not any(r.queued for r in found if r.path == "b")


def test_query_sets_report_every_error(spark, tmp_path):
    from quillspark.sources.queryset import load

    def write(text):
        (tmp_path / "q.yaml").write_text(text)
        return str(tmp_path / "q.yaml")

    good = load(spark, write("version: 1\nqueries:\n- {id: a-1, q: ' where ', lang: en, kind: topic, targets: [' n.md ']}\n")).first()
    assert (good.query_id, good.q, good.targets) == ("a-1", "where", ["n.md"])
    with pytest.raises(ValueError) as e:
        load(spark, write("version: 1\nqueries:\n- {id: A, q: '', lang: de, kind: no, targets: []}\n- 5\n- {id: b, q: x, lang: pl, kind: topic, targets: [t]}\n- {id: b, q: x, lang: pl, kind: topic, targets: [t]}\n"))
    assert len(str(e.value).split("\n")) == 7 and "b: another entry before it has this id" in str(e.value) and "#1: isn't a mapping of fields" in str(e.value)
    for text in ("version: 2\nqueries: []", "- 1", "a: ["):
        with pytest.raises(ValueError):
            load(spark, write(text))
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "none.yaml"))


def test_cursors_pages_and_filters(spark):
    from quillspark.operators import paging

    assert paging.decode_cursor(paging.encode_cursor(3, "ü/é"), (int, str)) == (3, "ü/é")
    for bad in ("!", "", "e30", "WzFd" * 900, "é", paging.encode_cursor("x")):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad, (int, str))
    df = spark.createDataFrame([(n, c) for n in (3, 2, 1) for c in "ab"], "n int, c string")
    order = [F.desc("n"), F.col("c")]
    assert [tuple(r) for r in paging.page(df, paging.keyset(["n", "c"], (3, "b"), {"n"}), order, 2).collect()] == [(2, "a"), (2, "b"), (1, "a")]
    assert paging.where_given(df, n=None, c="a").count() == 3 and df.where(paging.contains_text("c", "%")).count() == 0


def test_search_index_reads_only_its_terms(spark):
    chunks = spark.createDataFrame([(k, k, f"word{k} common", f"Head{k}") for k in range(50)], "doc_id long, chunk_id long, content string, heading string")
    index = search.PostingsIndex(spark, "postings_test", buckets=4)
    try:
        index.write(chunks)
        terms = spark.createDataFrame([(1, "word7"), (1, "head7")], "query_id int, term string")
        rows = index.of(terms)
        assert sorted((r.term, r.pos, r.weight) for r in rows.collect()) == [("head7", 0, 1.0), ("word7", 1, 0.1)]
        assert "In(term" in rows._jdf.queryExecution().executedPlan().toString()
        assert index.of(terms, most=1).count() == 2
    finally:
        index.drop()


def test_cover_density_and_headlines(spark):
    near = spark.createDataFrame([(1, 1, "red disk"), (2, 2, "red and a very old disk"), (3, 3, "red disk red disk"), (4, 4, "disk")], "doc_id long, chunk_id long, content string")
    asked = spark.createDataFrame([(1, "red disk")], "query_id int, text string")
    scores = {r.doc_id: r.score for r in search.web_matches(search.postings(near), near, asked).collect()}
    # covers: one of two words; one with four others in it; three of two words
    assert scores == {1: 0.1, 2: round(0.1 / 5, 9), 3: round(0.3, 9)}
    text = "lead " * 40 + "the <b>disk</b> & more " + "tail " * 40 + "disk again " + "end " * 30
    marked = spark.createDataFrame([(text, ["disk"]), ("nothing", ["disk"]), (None, ["disk"]), ("A disk.", ["disk"])], "t string, w array<string>").select(search.headline("t", "w").alias("h")).collect()
    assert [r.h is None for r in marked] == [False, True, True, False] and marked[3].h == "A <mark>disk</mark>."
    assert marked[0].h.count("<mark>") == 2 and " … " in marked[0].h and "&lt;b&gt;" in marked[0].h and all(12 <= len(p.split()) <= 30 for p in marked[0].h.split(" … "))
    assert one(spark, X.capture_title(F.lit("\n  ## a/b: c?  d \nnext"))) == "ab c d" and one(spark, X.capture_title(F.lit(" \n"))) == "Capture"
    assert one(spark, X.capture_title(F.lit("word " * 20))) == ("word " * 12).strip() and one(spark, X.capture_title(F.lit("x" * 80))) == "x" * 60


def test_knn_in_blocks_equals_one_batch(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(6)]) for k in range(60)] + [(60, None), (61, [1.0] * 6), (62, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 3 = 0 OR vec_id > 59").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    small = sorted(map(tuple, search.knn(vectors, queries, 5).collect()))
    monkeypatch.setattr(search, "SMALL_BATCH", 4)
    assert sorted(map(tuple, search.knn(vectors, queries, 5).collect())) == small
    assert len(small) == 5 * 22 and {(r[1], r[3]) for r in small if r[0] == 61} >= {(61, 1), (62, 2)}


def test_registry_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_the_optional_part(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[0]) > 50 and done.stdout.split()[1] == "False"


def test_chains_end_at_the_top_and_at_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 9), (9, 7)], "id int, parent int")
    found = {(r.id, r.ancestor, r.distance) for r in graph.ancestors(links).collect()}
    assert {f for f in found if f[0] < 7} == {(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 4, 2), (3, 4, 1)}
    assert {f[1:] for f in found if f[0] == 7} == {(8, 1), (9, 2), (7, 3)}
    proposed = spark.createDataFrame([(4, 1), (1, 4), (5, 5), (4, 6)], "child int, parent int")
    assert {(r.child, r.parent): r.cycle for r in graph.would_cycle(links, proposed).collect()} == {(4, 1): True, (1, 4): False, (5, 5): True, (4, 6): False}


def test_long_chains_are_whole(spark):
    ring = [(k, k % 113 + 1) for k in range(101, 113)] + [(113, 101)]
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 41)] + ring, "id int, parent int")
    found = {r.id: list(r.chain) for r in graph.chains(links).collect()}
    assert all(found[k] == list(range(k + 1, 42)) for k in range(1, 41))
    assert found[105] == [*range(106, 114), *range(101, 106)] and all(len(found[k]) == 13 for k, _ in ring)
    assert {r.id: r.chain for r in graph.chains(links, 3).collect()}[1] == [2, 3, 4]
    proposed = spark.createDataFrame([(41, 1), (20, 10), (1, 41), (104, 110)], "child int, parent int")
    assert {(r.child, r.parent): r.cycle for r in graph.would_cycle(links, proposed).collect()} == {(41, 1): True, (20, 10): True, (1, 41): False, (104, 110): True}


def test_cycles_of_random_links_are_told_by_jumps(spark):
    import random

    rng = random.Random(12)
    up = {k: rng.choice([k + 1, k + 1, rng.randint(0, 79)]) for k in range(60)} | {k: k + 1 for k in range(100, 160)} | {200: 201, 201: 202, 202: 200, 203: 200, 210: 210}
    nodes = [*range(62), *range(100, 161, 6), 200, 201, 202, 203, 204, 210]

    def meets(child, parent, depth=None):
        seen, at = [], parent
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        return child == parent or child in seen[:depth]

    asked = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(500)] + [(a, b) for a in (200, 201, 203, 210, 204) for b in (200, 202, 203, 210)]
    links = spark.createDataFrame([*up.items()], "id int, parent int")
    proposed = spark.createDataFrame(asked, "child int, parent int")
    for depth in (None, 3):
        got = {(r.child, r.parent): r.cycle for r in graph.would_cycle(links, proposed, depth).collect()}
        assert got == {(a, b): meets(a, b, depth) for a, b in asked}
    assert [r.cycle for r in graph.would_cycle(links.limit(0), proposed.limit(1)).collect()] == [asked[0][0] == asked[0][1]]


def windows_by_hand(chunks, limit):
    out, text, n = [], "", 0
    for content in chunks:
        rest = content
        while True:
            if text and len(text) + len(f"[c{n + 1}]\n") + len(rest) + 2 > limit:
                out, text, n = [*out, text[:-2]], "", 0
            room = max(limit - len(text) - len(f"[c{n + 1}]\n") - 2, 1)
            n += 1
            text += f"[c{n}]\n{rest[:room]}\n\n"
            rest = rest[room:]
            if not rest:
                break
            out, text, n = [*out, text[:-2]], "", 0
    return [*out, text[:-2]] if text else out


def test_windows_hold_their_size(spark):
    notes = {1: ["a" * 4, "b" * 6, "c", "d" * 90, "e", ""], 2: [""], 3: ["x" * 18] * 15 + ["y" * 500, "z" * 3], 4: ["w"] * 40}
    rows = [(d, k, c) for d, cs in notes.items() for k, c in enumerate(cs)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, content string")
    got = {}
    for r in graph.window_texts(chunks, 40).orderBy("doc_id", "window").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {d: windows_by_hand(cs, 40) for d, cs in notes.items()} and all(len(w) <= 40 for ws in got.values() for w in ws)
    headed = graph.window_texts(spark.createDataFrame([(1, 1, "body", "Head")], "doc_id long, chunk_id long, content string, heading string"), 40)
    assert headed.first().text == "[c1] Head\nbody"


def test_output_filter_drops_and_never_repairs(spark):
    good = (
        '{"entities":[{"name":" Disk ","type":"device","aliases":["disk","d1","D1"],"confidence":7},{"name":"DISK","type":"tool","confidence":1},{"name":"note","type":"tool"},'
        '{"name":"x","type":"planet"},{"name":"Box","type":"tool"}],"relations":[{"subject":"NOTE","relation":"about","object":"disk","chunk":"c1","confidence":-1},'
        '{"subject":"NOTE","relation":"about","object":"Disk","chunk":"c2"},{"subject":"Disk","relation":"uses","object":"disk"},{"subject":"Box","relation":"likes","object":"Disk"},'
        '{"subject":"Box","relation":"uses","object":"Disk","chunk":"c12345"}]}'
    )
    rows = graph.filter_output(spark.createDataFrame([(1, good), (2, None), (3, "[")], "id int, output string")).orderBy("id").collect()
    assert [(e.name, e.type, e.aliases, e.confidence) for e in rows[0].entities] == [("Disk", "device", ["d1"], 1.0), ("Box", "tool", [], 0.0)]
    assert [(r.subject, r.object, r.chunk, r.confidence) for r in rows[0].relations] == [("NOTE", "disk", "c1", 0.0), ("Box", "Disk", None, 0.0)]
    assert all(not rows[i].entities and not rows[i].relations for i in (1, 2)) and [r.summary for r in rows] == ["", None, None]
    folded = (
        '{"summary":" a  b ","entities":[{"name":"Straße","type":"topic","aliases":[" STRASSE ","X","ｘ",""],"confidence":"1"},{"name":"STRASSE","type":"tool"},{"name":"Box","type":"tool"}],'
        '"relations":[{"subject":"strasse","relation":"uses","object":"BOX","chunk":"c1 "}]}'
    )
    row = graph.filter_output(spark.createDataFrame([(1, folded)], "id int, output string")).first()
    assert row.summary == "a b" and [(e.name, e.aliases, e.confidence) for e in row.entities] == [("Straße", ["X"], 0.0), ("Box", [], 0.0)]
    assert [(r.subject, r.object, r.chunk) for r in row.relations] == [("strasse", "BOX", None)]


def test_flips_and_verdict(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (3, None), (4, 9)], "query_id int, rank int")
    b = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1)], "query_id int, rank int")
    assert {(r.query_id, r.flip) for r in evaluation.flips(a, b).collect()} == {(1, "lost"), (2, "gained")}
    systems = spark.createDataFrame([("old", 0.6, 0.5, 90.0), ("new", 0.65, 0.5, 299.0), ("slow", 0.9, 0.9, 300.0), ("weak", 0.64, 0.9, 1.0)], "name string, recall double, mrr double, p95 double")
    judged = evaluation.verdict(systems, systems.name == "old").collect()
    assert {r.name for r in judged if r.wins} == {"new"} == {r.name for r in judged if r.best}


def test_bootstrap_is_paired_and_interpolated(spark):
    import random

    a, b = [1, None, 3, None, 2, 7, None], [None, None, 1, 2, None, 1, None]
    rng, n = random.Random(20261002), len(a)
    drawn = []
    for _ in range(2000):
        at = [rng.randrange(n) for _ in range(n)]
        drawn.append(sum((a[k] is not None) - (b[k] is not None) for k in at) / n)
    frame = lambda v: spark.createDataFrame([("new", k, x) for k, x in enumerate(v)], "system string, query_id int, rank int")
    import numpy as np

    got = evaluation.bootstrap(frame(a), frame(b)).first()
    assert (got.low, got.high) == tuple(round(float(np.percentile(drawn, p)), 6) for p in (2.5, 97.5))
    assert spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "x double").agg(evaluation.percentile("x", 0.5)).first()[0] == 25.0


def test_bootstrap_by_counts_repeats_and_agrees_with_draws(spark):
    a, b = [1 if k % 3 else None for k in range(400)], [1 if k % 2 else None for k in range(400)]
    frame = lambda v, s="new": spark.createDataFrame([(s, k, x) for k, x in enumerate(v)], "system string, query_id int, rank int")
    both = frame(a).union(frame(b, "same"))
    got = [sorted(map(tuple, evaluation.bootstrap_counts(both.repartition(n), frame(b)).collect())) for n in (1, 5)]
    drawn = sorted(map(tuple, evaluation.bootstrap(both, frame(b)).collect()))
    assert got[0] == got[1] and got[0][1] == ("same", 0.0, 0.0)
    assert all(abs(x - y) < 0.02 for x, y in zip(got[0][0][1:], drawn[0][1:], strict=True))
    assert evaluation.bootstrap_counts(both.limit(0), frame(b)).count() == 0


def test_bake_off(spark):
    queries = spark.createDataFrame([(k, [f"p{k}"]) for k in range(20)], "query_id int, targets array<string>")
    found = lambda name, n: [(name, k, 1, f"p{k}" if k < n else "other") for k in range(20)]
    runs = spark.createDataFrame(found("old", 10) + found("new", 15) + found("slow", 20), "system string, query_id int, position int, path string")
    ms = spark.createDataFrame([(s, k, v) for s, v in (("old", 50.0), ("new", 60.0), ("slow", 300.0)) for k in range(20)], "system string, query_id int, ms double")
    scores, intervals = evaluation.bake_off(queries, runs, ms, "old")
    assert {r["name"]: (r.recall, r.p95, r.wins, r.best) for r in scores.collect()} == {"old": (0.5, 50.0, False, False), "new": (0.75, 60.0, True, True), "slow": (1.0, 300.0, False, False)}
    assert {r.system for r in intervals.where("low > 0").collect()} == {"new", "slow"}
    assert [tuple(r) for r in evaluation.missing_targets(queries.limit(2), spark.createDataFrame([("p0",)], "path string")).collect()] == [(1, "p1")]
