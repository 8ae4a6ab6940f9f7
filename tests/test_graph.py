"""Scenarios of the graph: decisions, resolution, review, runs and chat on small frames."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chat, decisions, ingest, nightly, resolution, review

ENTITY = "id long, type string, name string, norm_name string, status string, parent_id long, parent_status string, created_at timestamp, suggested array<string>"
ALIAS = "entity_id long, type string, alias string, norm_alias string"
EDGE = "id long, src_type string, src_id long, relation string, dst_id long, confidence double, status string, decided_by string, origin string, revision_id long"


def entities(spark, rows):
    return spark.createDataFrame([(i, t, n, n.lower(), s, p, "accepted" if p else None, None, []) for i, t, n, s, p in rows], ENTITY)


def aliases(spark, rows):
    return spark.createDataFrame([(i, t, a, a.lower()) for i, t, a in rows], ALIAS)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "llm:m", None) for r in rows], EDGE)


def test_accept_and_reject_reach_the_right_edges(spark):
    e = entities(spark, [(1, "tool", "A", "proposed", None), (2, "tool", "B", "rejected", None), (3, "tool", "C", "proposed", None), (4, "tool", "D", "accepted", None)])
    g = edges(spark, [
        (1, "source", 9, "mentions", 1, 0.9, "proposed", "auto"), (2, "source", 9, "about", 1, 0.4, "proposed", "auto"), (3, "source", 8, "mentions", 1, 0.5, "rejected", "auto"),
        (4, "source", 8, "about", 1, 0.9, "rejected", "user"), (5, "entity", 1, "uses", 2, 0.9, "rejected", "auto"), (6, "entity", 1, "uses", 4, 0.9, "rejected", "auto"), (7, "entity", 4, "uses", 1, 0.9, "proposed", "auto"),
        (8, "entity", 3, "uses", 4, 0.9, "accepted", "auto"), (9, "source", 7, "mentions", 3, 0.9, "accepted", "user"), (10, "source", 1, "mentions", 4, 0.9, "rejected", "auto"), (11, "entity", 1, "uses", 3, 0.9, "proposed", "auto"),
    ])
    asked = spark.createDataFrame([(1, "reject", 1), (1, "accept", 2), (3, "reject", 3), (77, "accept", 4)], "entity_id long, action string, seq int")
    after, links = decisions.decide_entities(e, g, asked)
    assert {r.id: r.status for r in after.collect()} == {1: "accepted", 2: "rejected", 3: "rejected", 4: "accepted"}
    assert {r.id: r.status for r in links.collect()} == {
        1: "accepted", 2: "proposed", 3: "accepted", 4: "rejected", 5: "rejected", 6: "proposed", 7: "proposed", 8: "rejected", 9: "accepted", 10: "rejected", 11: "rejected"
    }
    decided = decisions.decide_links(g, spark.createDataFrame([(1, "accept", 1), (1, "reject", 2), (2, "no", 3), (99, "accept", 4)], "edge_id long, action string, seq int"))
    assert {(r.id, r.status) for r in decided.where("decided_by = 'user'").collect()} == {(1, "rejected"), (4, "rejected"), (9, "accepted")} and links.columns == g.columns


def test_rename_and_retype_keep_names_unique(spark):
    e = entities(spark, [(1, "tool", "Disk", "accepted", None), (2, "tool", "Box", "accepted", 3), (3, "tool", "Rack", "accepted", None), (4, "device", "Straße", "accepted", None), (5, "device", "Disk", "accepted", None)])
    graph = decisions.Graph(e, aliases(spark, [(1, "tool", "Drive"), (4, "device", "Road"), (2, "tool", "Crate")]), edges(spark, []))
    asked = spark.createDataFrame([(1, "  Drive "), (2, "RACK"), (3, " "), (4, "STRASSE"), (9, "x"), (5, "a\x01b")], "entity_id long, name string").withColumn("seq", F.lit(1))
    after, outcomes = decisions.rename(graph, asked)
    assert {r.entity_id: r.outcome for r in outcomes.collect()} == {1: "renamed", 2: "name_taken", 3: "invalid_action", 4: "renamed", 9: "not_found", 5: "invalid_action"}
    assert {r.id: r.name for r in after.entities.collect()} == {1: "Drive", 2: "Box", 3: "Rack", 4: "STRASSE", 5: "Disk"}
    assert {(r.entity_id, r.alias) for r in after.aliases.collect()} == {(1, "Disk"), (4, "Road"), (4, "Straße"), (2, "Crate")}
    asked = spark.createDataFrame([(1, "device"), (2, "device"), (3, "planet"), (4, "device"), (9, "tool")], "entity_id long, type string").withColumn("seq", F.lit(1))
    after, outcomes = decisions.retype(graph, asked)
    assert {r.entity_id: r.outcome for r in outcomes.collect()} == {1: "name_taken", 2: "retyped", 3: "invalid_action", 4: "same", 9: "not_found"}
    assert {(r.id, r.type, r.parent_id) for r in after.entities.where("id = 2").collect()} == {(2, "device", None)}
    assert {(r.type, r.alias) for r in after.aliases.where("entity_id = 2").collect()} == {("tool", "Crate"), ("device", "Crate"), ("tool", "Box")}


def test_parents_close_no_loops(spark):
    e = entities(spark, [(1, "tool", "a", "accepted", None), (2, "tool", "b", "accepted", 1), (3, "tool", "c", "accepted", 2), (4, "device", "d", "accepted", None), (5, "tool", "e", "accepted", 4)])
    asked = spark.createDataFrame([(1, 3), (2, 2), (3, 4), (5, 1), (4, 99), (8, 1)], "entity_id long, parent_id long").union(spark.createDataFrame([(3, None)], "entity_id long, parent_id long").limit(0)).withColumn("seq", F.lit(1))
    after, outcomes = decisions.set_parents(e, asked)
    assert {r.entity_id: r.outcome for r in outcomes.collect()} == {1: "parent_cycle", 2: "parent_cycle", 3: "type_mismatch", 5: "set", 4: "not_found", 8: "not_found"}
    assert {r.id: r.parent_id for r in after.collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: 1}
    cleared, _ = decisions.set_parents(e, spark.createDataFrame([(3, None)], "entity_id long, parent_id long").withColumn("seq", F.lit(1)))
    assert {(r.parent_id, r.parent_status) for r in cleared.where("id = 3").collect()} == {(None, None)}
    proposed = resolution.propose_parents(e, spark.createDataFrame([(1, 2), (4, 4), (4, 5), (1, 99), (4, 1), (4, 3)], "child long, parent long"))
    assert {(r.id, r.parent_id, r.parent_status) for r in proposed.where("parent_status = 'proposed'").collect()} == {(4, 1, "proposed")}


def test_merge_moves_edges_aliases_and_children(spark):
    e = entities(spark, [
        (1, "tool", "Old", "accepted", 7), (2, "tool", "New", "accepted", None), (3, "tool", "Child", "accepted", 1), (4, "device", "X", "accepted", None), (5, "tool", "Loser", "accepted", None),
        (6, "tool", "Under", "accepted", 8), (7, "tool", "Top", "accepted", None), (8, "tool", "Middle", "accepted", 5),
    ])
    g = edges(spark, [
        (1, "source", 9, "mentions", 1, 0.9, "accepted", "auto"), (2, "source", 9, "mentions", 2, 0.9, "proposed", "auto"), (3, "source", 8, "mentions", 1, 0.2, "rejected", "user"), (4, "source", 8, "mentions", 2, 0.9, "proposed", "auto"),
        (5, "entity", 1, "uses", 2, 0.9, "proposed", "auto"), (6, "entity", 1, "uses", 4, 0.8, "proposed", "auto"), (7, "entity", 2, "uses", 4, 0.7, "proposed", "auto"), (8, "entity", 4, "uses", 4, 0.7, "proposed", "auto"),
    ])
    graph = decisions.Graph(e, aliases(spark, [(1, "tool", "new"), (1, "tool", "Elder"), (2, "tool", "Fresh")]), g)
    after, outcomes = decisions.merge(graph, spark.createDataFrame([(1, 2), (5, 6), (4, 4), (7, 99), (8, 4)], "loser_id long, into_id long").where("loser_id NOT IN (4, 7, 8)"))
    assert {r.loser_id: r.outcome for r in outcomes.collect()} == {1: "merged", 5: "merged"}
    assert {r.id for r in after.edges.collect()} == {2, 3, 6, 8} and {(r.src_id, r.dst_id) for r in after.edges.where("id = 6").collect()} == {(2, 4)}
    assert {(r.entity_id, r.alias) for r in after.aliases.collect()} == {(2, "Elder"), (2, "Fresh"), (2, "Old"), (6, "Loser")}
    # the child follows, the survivor takes the loser's parent; one above the survivor is let go
    assert {r.id: r.parent_id for r in after.entities.collect()} == {2: 7, 3: 2, 4: None, 6: 8, 7: None, 8: None}
    _, bad = decisions.merge(graph, spark.createDataFrame([(4, 4), (7, 99), (3, 4)], "loser_id long, into_id long"))
    assert {r.loser_id: r.outcome for r in bad.collect()} == {4: "invalid_action", 7: "not_found", 3: "type_mismatch"}
    below, _ = decisions.merge(graph, spark.createDataFrame([(1, 3)], "loser_id long, into_id long"))
    assert {r.id: r.parent_id for r in below.entities.where("id = 3").collect()} == {3: 7}


MENTION = "source_id long, type string, name string, aliases array<string>, confidence double, evidence string"
RELATION = "source_id long, subject string, relation string, object string, confidence double, evidence string"


def test_resolution(spark):
    e = entities(spark, [(1, "tool", "Disk", "accepted", None), (2, "tool", "Box", "rejected", None), (3, "device", "Nas", "accepted", None), (4, "project", "Backup", "proposed", None), (5, "tool", "Tar", "accepted", None), (6, "device", "Tar", "accepted", None)])
    a = aliases(spark, [(1, "tool", "Drive")])
    said = spark.createDataFrame([
        (9, "tool", "DISK", None, 0.5, None), (9, "tool", "HDD", ["drive"], 0.9, "c2"), (9, "tool", "box", None, 0.9, None), (9, "device", "Nas", None, 0.95, "c1"), (9, "project", "Backup", ["bk"], 0.99, None),
        (9, "topic", "New  thing", ["nt", "disk"], 0.7, None), (8, "topic", "new thing", None, 0.6, None), (8, "topic", "Nearby", None, 0.6, None), (8, "tool", "tar", None, 0.9, None), (8, "device", "TAR", None, 0.9, None), (8, "project", "backup", None, 0.3, None),
    ], MENTION)
    rel = spark.createDataFrame([
        (9, "NOTE", "about", "hdd", 0.9, None), (9, "bk", "uses", "Disk", 0.8, "e"), (9, "Backup", "uses", "HDD", 0.6, None), (9, "Backup", "uses", "box", 0.6, None), (9, "Disk", "uses", "hdd", 0.6, None), (9, "Disk", "runs_on", "Nas", 0.6, None),
        (9, "Nas", "part_of", "Backup", 0.5, None), (9, "Nas", "uses", "nobody", 0.5, None), (8, "backup", "uses", "tar", 0.4, None), (8, "tar", "works_with", "backup", 0.4, None),
    ], RELATION)
    near = spark.createDataFrame([("topic", "nearby", 4), ("tool", "disk", 5)], "type string, norm string, id long")
    prior = spark.createDataFrame([("entity", 1, "runs_on", 3), ("entity", 4, "uses", 1), ("source", 9, "about", 1)], "src_type string, src_id long, relation string, dst_id long")
    found = resolution.resolve(said, rel, e, a, near, prior)
    made = {(r.type, r.norm_name): r.id for r in found.created.collect()}
    assert set(made) == {("topic", "new thing")}
    assert {(r.entity_id, r.alias) for r in found.created_aliases.collect()} == {(made["topic", "new thing"], "nt"), (made["topic", "new thing"], "disk")}
    got = {(r.src_type, r.src_id, r.relation, r.dst_id): (r.confidence, r.status, r.evidence) for r in found.edges.collect()}
    new = made["topic", "new thing"]
    assert got == {
        ("source", 9, "about", 1): (0.9, "accepted", "c2"), ("source", 9, "mentions", 3): (0.95, "accepted", "c1"), ("source", 9, "mentions", 4): (0.99, "proposed", None), ("source", 9, "mentions", new): (0.7, "proposed", None),
        ("source", 8, "mentions", new): (0.6, "proposed", None), ("source", 8, "mentions", 4): (0.6, "proposed", None), ("source", 8, "mentions", 5): (0.9, "accepted", None), ("source", 8, "mentions", 6): (0.9, "accepted", None),
        ("entity", 4, "uses", 1): (0.8, "proposed", "e"), ("entity", 1, "runs_on", 3): (0.6, "accepted", None), ("entity", 3, "part_of", 4): (0.5, "proposed", None), ("entity", 4, "uses", 5): (0.4, "proposed", None),
    }
    assert [tuple(r) for r in found.suggested.collect()] == [(4, "Nearby")] and [tuple(r) for r in found.parents.collect()] == [(3, 4)] and [tuple(r) for r in found.dropped.collect()] == [(9, "box")]
    more = resolution.suggest_aliases(e, spark.createDataFrame([(4, "Nearby"), (4, "NEARBY"), (4, " ")] + [(5, f"s{k:02}") for k in range(12)], "entity_id long, alias string"))
    assert {r.id: len(r.suggested) for r in more.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 10, 6: 0}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (5, [0.9, 0.1])], "id long, embedding array<double>")
    names = spark.createDataFrame([("tool", "hd", [1.0, 0.02]), ("tool", "far", [0.0, 1.0])], "type string, norm string, vector array<double>")
    assert [tuple(r) for r in resolution.similar(names, vectors, e).collect()] == [("tool", "hd", 1)]


def test_outputs_of_windows_merge(spark):
    entity, relation = "array<struct<name:string,type:string,aliases:array<string>,confidence:double>>", "array<struct<subject:string,relation:string,object:string,chunk:string,confidence:double>>"
    rows = [
        (1, 0, [("Disk", "tool", ["a"], 0.2), ("Box", "tool", None, 0.3)], [("NOTE", "about", "Disk", None, 0.1)]),
        (1, 1, [("DISK", "tool", ["a", "b"], 0.9), ("disk", "device", None, 0.5)] + [(f"n{k}", "topic", None, 0.1) for k in range(40)], [("note", "about", "disk", "c3", 0.7)]),
    ]
    names, links = resolution.merge_outputs(spark.createDataFrame(rows, f"revision_id long, window int, entities {entity}, relations {relation}"))
    first = {r.ordinal: r for r in names.collect()}
    assert len(first) == 30 and (first[1].name, first[1].confidence, first[1].aliases) == ("Disk", 0.9, ["a", "b"]) and first[3].type == "device"
    assert [(r.subject, r.object, r.confidence, r.chunk) for r in links.collect()] == [("NOTE", "Disk", 0.7, "c3")]
    labels = spark.createDataFrame([(1, 0, "c1", 10), (1, 1, "c1", 20)], "revision_id long, window int, label string, chunk_id long")
    seen = spark.createDataFrame([(1, 0, "k", "c9", 0), (1, 1, "k", "c1", 0), (1, 0, "m", "c1", 1)], "revision_id long, window int, key string, label string, place int")
    assert {(r.key, r.chunk_id) for r in resolution.evidence(labels, seen).collect()} == {("k", 20), ("m", 10)}


def ts(text):
    return F.lit(text).cast("timestamp")


def test_windows_of_runs_are_half_open(spark):
    runs = spark.createDataFrame([
        (1, "2024-01-01", "schedule", "complete", "2024-01-01 02:00:00", "2024-01-01 03:00:00", 2, 0), (2, "2024-01-02", "schedule", "failed", "2024-01-02 02:00:00", "2024-01-02 02:10:00", 0, 0),
        (3, "2024-01-03", "manual", "running", "2024-01-03 02:00:00", None, 1, 0),
    ], "id int, run_date string, trigger string, status string, started_at string, finished_at string, queued_new int, queued_failed int")
    runs = runs.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")}).withColumn("run_date", F.to_date("run_date"))
    runs = nightly.window_starts(runs)
    assert [str(r.window_start)[:10] for r in runs.orderBy("id").collect()] == ["None", "2024-01-01", "2024-01-01"]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(["2024-01-01 01:59:59", "2024-01-01 02:00:00", "2024-01-01 02:59:59", "2024-01-01 03:00:00", "2024-01-03 05:00:00", "2024-01-03 06:00:00"])], "id int, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
    bounds = nightly.bounds(runs, ts("2024-01-03 06:00:00")).drop("window_start")
    assert {(r.id, r.run_id) for r in nightly.within(made, bounds, "created_at").collect()} == {(1, 1), (2, 1), (4, 3)}
    attempts = spark.createDataFrame([(7, "2024-01-01 02:30:00"), (7, "2024-01-01 02:31:00"), (8, "2024-01-01 02:32:00"), (9, "2024-01-01 02:33:00")], "revision_id int, t string").select("revision_id", F.col("t").cast("timestamp").alias("attempted_at"))
    assert {(r.id, r.done) for r in nightly.progress(runs, attempts, ts("2024-01-03 06:00:00")).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert [r.id for r in nightly.latest(runs).collect()] == [3]
    closed = {(now, waiting): nightly.close_open(runs, ts(now), F.lit(waiting), 8).where("id = 3").first() for now, waiting in (("2024-01-03 03:00:00", 1), ("2024-01-03 03:00:00", 0), ("2024-01-03 10:00:01", 1))}
    assert [(r.status, r.timed_out) for r in closed.values()] == [("running", False), ("complete", False), ("complete", True)]
    empty = nightly.queue_counts(runs, spark.createDataFrame([], "id long, class int"), 3)
    assert {r.id: r.status for r in empty.collect()}[3] == "complete"
    grace = runs.withColumn("queued_new", F.lit(0))
    assert [nightly.close_open(grace, ts(t), F.lit(0), 8).where("id = 3").first().status for t in ("2024-01-03 02:04:59", "2024-01-03 02:05:00")] == ["running", "failed"]


@pytest.mark.parametrize(("utc", "due"), [("2024-03-31 00:45:00", False), ("2024-03-31 01:00:00", True), ("2024-10-27 00:29:00", False), ("2024-10-27 00:30:00", True), ("2024-01-10 01:29:00", False), ("2024-01-10 01:30:00", True)])
def test_schedule_follows_the_wall_clock(spark, utc, due):
    frame = spark.range(1).select(nightly.due(ts(utc), "Europe/Warsaw", "02:30", F.lit(True), F.lit(False)).alias("x"), nightly.due(ts(utc), "Europe/Warsaw", "02:30", F.lit(True), F.lit(True)).alias("y"))
    assert tuple(frame.first()) == (due, False)


def test_tombstones_stop_at_the_guard(spark):
    notes = spark.createDataFrame([(k, f"p{k}", None) for k in range(40)], "id int, path string, deleted_at timestamp")
    states = spark.createDataFrame([(k, k, "pending") for k in range(40)], "id int, source_id int, state string")
    for n, deleted in ((10, 10), (11, 0)):
        out, left = ingest.tombstone(notes, states, notes.where(f"id < {n}").select("path"), ts("2024-01-01"))
        assert out.where("deleted_at IS NOT NULL").count() == deleted == left.where("state = 'superseded'").count()
    out, _ = ingest.tombstone(notes, states, notes.where("id < 11").select("path"), ts("2024-01-01"), guarded=False)
    assert out.where("deleted_at IS NOT NULL").count() == 11
    moved = ingest.apply_moves(notes, spark.createDataFrame([("p1", "p2"), ("p3", "q")], "old_path string, new_path string"))
    assert {r.id: r.path for r in moved.where("id IN (1, 3)").collect()} == {1: "p1", 3: "q"}


def test_retrieval_numbers_its_sources(spark):
    hits = spark.createDataFrame([(1, 5, 50, 1, 0.03, False, True, 0.9), (1, 6, 60, 2, 0.02, False, True, 0.3), (1, 7, 70, 3, 0.01, True, False, None)], "query_id long, doc_id long, chunk_id long, rank int, score double, by_text boolean, by_vector boolean, similarity double")
    contents = spark.createDataFrame([(50, "a b.md", "H › <i>", "x < y"), (60, "c.md", "", "z"), (70, "d.md", None, "w")], "chunk_id long, path string, heading string, content string")
    found = chat.retrieve(hits, contents, limit=2)
    assert [(r.n, r.doc_id, r.mode, r.link) for r in found.orderBy("n").collect()] == [(1, 5, "hybrid", "obsidian://open?vault=My%20vault&file=a%20b.md"), (2, 7, "hybrid", "obsidian://open?vault=My%20vault&file=d.md")]
    history = spark.createDataFrame([(3, k, f"q{k}", f"a{k}") for k in range(12)], "session_id long, turn int, question string, answer string")
    asked = spark.createDataFrame([(1, 3, "why?"), (2, 4, "and?")], "query_id long, session_id long, question string")
    rows = chat.messages(asked, found, history).orderBy("query_id", "place").collect()
    own = [(r.role, r.content) for r in rows if r.query_id == 1]
    assert len(own) == 21 and own[0] == ("user", "q2") and own[-2] == ("assistant", "a11")
    assert own[-1] == ("user", "<sources>\n[1] a b.md — H › &lt;i&gt;\nx &lt; y\n\n[2] d.md\nw\n</sources>\n\nQuestion: why?")
    assert [r.content for r in rows if r.query_id == 2] == ["<sources>\n(no matching sources)\n</sources>\n\nQuestion: and?"]


def test_status_matrix_has_every_cell(spark):
    e = entities(spark, [(1, "tool", "a", "accepted", None)])
    assert {(r.type, r.status): r.n for r in review.status_matrix(e, ["tool", "topic"], ["accepted", "rejected"]).collect()} == {("tool", "accepted"): 1, ("tool", "rejected"): 0, ("topic", "accepted"): 0, ("topic", "rejected"): 0}
