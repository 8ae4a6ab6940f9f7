"""Relational queries whose SQL is the same for Spark and DuckDB; {name} stands for a table."""

from __future__ import annotations

from quillspark.plans.corpus import ATTEMPTS_SQL, EDGES_SQL, ENTITIES_SQL, RUNS_SQL, SOURCES_SQL

W = "WITH "

SHARED = {
    # projections, filters, paging
    "live_sources_filter": W + SOURCES_SQL + " SELECT doc_id, path FROM s WHERE NOT deleted AND path LIKE 'src1/%' AND lang = 'en'",
    "folder_prefix_escaped": W + SOURCES_SQL + r" SELECT doc_id, path FROM s WHERE path LIKE 'src#_1/%' ESCAPE '#' OR path LIKE 'src2/%'",
    "substring_ilike": "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%#12' ",
    "sources_list_page": W + SOURCES_SQL + " SELECT doc_id, path, CASE WHEN deleted THEN 'deleted' WHEN quality IS NULL THEN 'pending' WHEN quality = 0 THEN 'failed' ELSE 'indexed' END AS state FROM s WHERE (path > 'src1/en/1.md' OR (path = 'src1/en/1.md' AND doc_id > 1)) ORDER BY path, doc_id LIMIT 51",
    "mixed_keyset_page": W + EDGES_SQL + ", c AS (SELECT dst_id, count(DISTINCT src_id) AS notes FROM edges GROUP BY dst_id) SELECT dst_id, notes FROM c WHERE notes < 35 OR (notes = 35 AND dst_id > 100) ORDER BY notes DESC, dst_id LIMIT 51",
    "half_open_window": "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL '2' DAY FROM {events}) AND ts < (SELECT date_trunc('day', min(ts)) + INTERVAL '9' DAY FROM {events}) GROUP BY event_type",
    # status
    "status_summary": W + SOURCES_SQL + " SELECT count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS tombstones, count(*) FILTER (WHERE quality IS NULL AND NOT deleted) AS pending, count(*) FILTER (WHERE quality = 0 AND NOT deleted) AS failed, count(DISTINCT folder) AS folders, CAST(sum(n_chars) AS BIGINT) AS chars FROM s",
    "error_mode": "SELECT event_type, n FROM (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM {events} GROUP BY event_type) x WHERE place = 1",
    "retry_routing": W + SOURCES_SQL + " SELECT s.doc_id, CASE WHEN deleted THEN 'missing' WHEN quality = 0 THEN 'index' WHEN e.vec_id IS NULL THEN 'embed' ELSE 'none' END AS route FROM s LEFT JOIN {embeddings} e ON e.vec_id = s.doc_id",
    "graph_status_matrix": W + ENTITIES_SQL + ", t AS (SELECT DISTINCT type FROM entities), u AS (SELECT DISTINCT status FROM entities), c AS (SELECT type, status, count(*) AS n FROM entities GROUP BY type, status) SELECT t.type, u.status, coalesce(c.n, 0) AS n FROM t CROSS JOIN u LEFT JOIN c ON c.type = t.type AND c.status = u.status",
    # work lists
    "pending_revisions": "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL",
    "failed_revisions": W + ATTEMPTS_SQL + " SELECT a.revision_id, max(a.attempted_at) AS last_failed FROM attempts a WHERE a.status = 'failed' AND NOT EXISTS (SELECT 1 FROM attempts b WHERE b.revision_id = a.revision_id AND b.event_type = 'purchase' AND b.attempted_at > a.attempted_at) GROUP BY a.revision_id",
    "queue_capped": W + SOURCES_SQL + ", q AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS class FROM s WHERE NOT deleted AND (quality IS NULL OR quality = 0)), r AS (SELECT doc_id, class, row_number() OVER (ORDER BY class, doc_id) AS place FROM q) SELECT doc_id, class, place FROM r WHERE place <= 400",
    "embed_backfill_antijoin": "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {embeddings} e WHERE e.vec_id = d.doc_id)",
    # ingestion shapes
    "claim_newest_pending": W + ATTEMPTS_SQL + ", p AS (SELECT event_id, revision_id, status, row_number() OVER (PARTITION BY revision_id, status ORDER BY attempted_at DESC, event_id DESC) AS place FROM attempts) SELECT event_id, revision_id, CASE WHEN status <> 'failed' THEN status WHEN place = 1 THEN 'claimed' ELSE 'superseded' END AS new_state FROM p",
    "upsert_user_wins": W + EDGES_SQL + ", k AS (SELECT src_id, dst_id, relation, status, decided_by, confidence, row_number() OVER (PARTITION BY dst_id, relation ORDER BY CASE decided_by WHEN 'user' THEN 0 ELSE 1 END, confidence DESC, src_id, n) AS place FROM edges) SELECT src_id, dst_id, relation, status, decided_by, confidence FROM k WHERE place = 1",
    "mass_delete_guard": W + SOURCES_SQL + ", c AS (SELECT folder, count(*) AS live, count(*) FILTER (WHERE deleted) AS missing FROM s GROUP BY folder) SELECT folder, live, missing, missing > 10 AND missing * 5 > live AS trips FROM c",
    # graph
    "review_entities_page": W + ENTITIES_SQL + ", " + EDGES_SQL + ", m AS (SELECT dst_id, count(DISTINCT src_id) AS notes, max(confidence) AS best FROM edges WHERE status <> 'rejected' GROUP BY dst_id) SELECT e.id, e.type, e.name, coalesce(m.notes, 0) AS notes, m.best FROM entities e LEFT JOIN m ON m.dst_id = e.id WHERE e.status = 'proposed' AND e.id > 40 ORDER BY e.id LIMIT 21",
    "review_samples_top3": W + EDGES_SQL + ", r AS (SELECT dst_id, src_id, n, created_at, row_number() OVER (PARTITION BY dst_id ORDER BY created_at DESC, src_id, n) AS place FROM edges) SELECT dst_id, src_id, n, created_at, place FROM r WHERE place <= 3",
    "review_links_visible": W + ENTITIES_SQL + ", " + EDGES_SQL + " SELECT g.src_id, g.n, g.dst_id, e.name FROM edges g JOIN entities e ON e.id = g.dst_id WHERE g.status = 'proposed' AND ((g.relation = 'about' AND e.status = 'accepted') OR (g.relation = 'mentions' AND e.status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = g.src_id AND o.o_orderstatus = 'F')))",
    "entities_by_note_count": W + ENTITIES_SQL + ", " + EDGES_SQL + " SELECT e.id, e.name, count(DISTINCT g.src_id) AS notes FROM entities e LEFT JOIN edges g ON g.dst_id = e.id AND g.status = 'accepted' WHERE e.status = 'accepted' GROUP BY e.id, e.name",
    "entity_page_notes": W + EDGES_SQL + ", r AS (SELECT dst_id, src_id, relation, confidence, row_number() OVER (PARTITION BY dst_id, src_id ORDER BY CASE relation WHEN 'about' THEN 0 ELSE 1 END, confidence DESC, n) AS place FROM edges WHERE status = 'accepted') SELECT dst_id, src_id, relation, confidence FROM r WHERE place = 1",
    "entity_parent_children": "SELECT n.n_nationkey, n.n_name, r.r_name AS parent, count(c.c_custkey) AS children FROM {nation} n LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey AND r.r_name <> 'ASIA' LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 0 GROUP BY n.n_nationkey, n.n_name, r.r_name",
    "entity_related": "WITH ce AS (SELECT DISTINCT o.o_custkey AS a, l.l_suppkey AS b FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey), ends AS (SELECT a AS id, b AS other, 'out' AS direction FROM ce UNION ALL SELECT b AS id, a AS other, 'in' AS direction FROM ce) SELECT id, direction, count(*) AS related, min(other) AS first_other FROM ends GROUP BY id, direction",
    "decide_links_batch": W + EDGES_SQL + ", a AS (SELECT user_id AS dst_id, CASE event_type WHEN 'error' THEN 'rejected' ELSE 'accepted' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM {events}) SELECT g.src_id, g.n, coalesce(a.status, g.status) AS status, CASE WHEN a.status IS NULL THEN g.decided_by ELSE 'user' END AS decided_by FROM edges g LEFT JOIN a ON a.dst_id = g.dst_id AND a.place = 1",
    "accept_cascade": W + ENTITIES_SQL + ", " + EDGES_SQL + " SELECT g.src_id, g.n, CASE WHEN g.decided_by = 'user' OR e.status <> 'proposed' THEN g.status WHEN g.confidence >= 0.5 AND g.status <> 'rejected' THEN 'accepted' WHEN g.status = 'rejected' THEN 'proposed' ELSE g.status END AS status FROM edges g JOIN entities e ON e.id = g.dst_id",
    "reject_cascade": W + ENTITIES_SQL + ", " + EDGES_SQL + " SELECT g.src_id, g.n, CASE WHEN g.decided_by = 'auto' AND e.status = 'rejected' THEN 'rejected' ELSE g.status END AS status FROM edges g JOIN entities e ON e.id = g.dst_id",
    "merge_edges": W + EDGES_SQL + ", m AS (SELECT src_id, dst_id - dst_id % 2 AS into_id, dst_id % 2 = 0 AS incumbent, relation, n, confidence, decided_by FROM edges), r AS (SELECT src_id, into_id, relation, n, confidence, decided_by, row_number() OVER (PARTITION BY src_id, into_id, relation ORDER BY CASE decided_by WHEN 'user' THEN 0 ELSE 1 END, confidence DESC, CASE WHEN incumbent THEN 0 ELSE 1 END, n) AS place FROM m WHERE src_id <> into_id) SELECT src_id, into_id, relation, n, confidence, decided_by FROM r WHERE place = 1",
    "edge_initial_status": W + ENTITIES_SQL + ", " + EDGES_SQL + " SELECT g.src_id, g.n, CASE WHEN e.status = 'accepted' AND g.confidence >= 0.8 THEN 'accepted' ELSE 'proposed' END AS initial FROM edges g JOIN entities e ON e.id = g.dst_id",
    "merge_outputs": W + EDGES_SQL + ", o AS (SELECT src_id, dst_id, relation, max(confidence) AS confidence, min(n) AS first_seen FROM edges GROUP BY src_id, dst_id, relation), c AS (SELECT src_id, dst_id, relation, confidence, first_seen, row_number() OVER (PARTITION BY src_id ORDER BY first_seen, dst_id, relation) AS place FROM o) SELECT src_id, dst_id, relation, confidence, first_seen FROM c WHERE place <= 50",
    # nightly
    "nightly_remaining": W + ATTEMPTS_SQL + ", " + RUNS_SQL + " SELECT r.started_at, count(DISTINCT a.revision_id) AS attempted, count(DISTINCT CASE WHEN a.status = 'failed' THEN a.revision_id END) AS failed, least(count(DISTINCT a.revision_id), 100) AS done FROM runs r LEFT JOIN attempts a ON a.attempted_at >= r.started_at AND a.attempted_at < r.finished_at GROUP BY r.started_at",
    "run_window_start": W + RUNS_SQL + " SELECT started_at, lag(started_at) OVER (ORDER BY started_at) AS window_start FROM runs",
    "digest_by_type": W + ENTITIES_SQL + ", " + EDGES_SQL + " SELECT e.type, count(DISTINCT e.id) AS n FROM entities e JOIN edges g ON g.dst_id = e.id WHERE e.status = 'proposed' AND g.created_at >= TIMESTAMP '1995-01-01 00:00:00' AND g.created_at < TIMESTAMP '1996-01-01 00:00:00' GROUP BY e.type",
    "digest_top_entities": W + ENTITIES_SQL + ", " + EDGES_SQL + ", b AS (SELECT dst_id, max(confidence) AS best FROM edges WHERE status <> 'rejected' GROUP BY dst_id) SELECT id, name, best FROM (SELECT e.id, e.name, b.best FROM entities e LEFT JOIN b ON b.dst_id = e.id WHERE e.status = 'proposed') x ORDER BY best DESC NULLS LAST, id LIMIT 5",
    "digest_failed": W + ATTEMPTS_SQL + ", f AS (SELECT event_id, revision_id, attempted_at, status, row_number() OVER (PARTITION BY revision_id ORDER BY attempted_at DESC, event_id DESC) AS place FROM attempts) SELECT revision_id, attempted_at, count(*) OVER () AS total FROM f WHERE place = 1 AND status = 'failed'",
    "digest_indexed": W + ATTEMPTS_SQL + ", b AS (SELECT revision_id, CAST(date_trunc('day', attempted_at) AS TIMESTAMP) AS day, min(attempted_at) AS first_in_day FROM attempts GROUP BY 1, 2), f AS (SELECT revision_id, min(day) AS born FROM b GROUP BY revision_id) SELECT b.day, count(*) FILTER (WHERE b.day = f.born) AS created, count(*) FILTER (WHERE b.day > f.born) AS changed FROM b JOIN f ON f.revision_id = b.revision_id GROUP BY b.day",
    # evaluation and chat
    "latency_percentiles": "SELECT event_type, round(median(value), 6) AS p50, count(*) AS n FROM {events} GROUP BY event_type",
    "turn_sequence": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM {conversations}",
    "session_last_turns": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {conversations}) x WHERE back <= 3",
    "sessions_list": "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, min_by(text, turn) AS title FROM {conversations} GROUP BY conv_id",
    "target_validation": "SELECT b.item_id, b.item_id * 37 AS target FROM {benchmark} b WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = b.item_id * 37)",
    "previous_run_as_of": "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders}",
    "run_progress": W + ATTEMPTS_SQL + ", " + RUNS_SQL + " SELECT r.started_at, count(a.event_id) AS attempts, count(CASE WHEN a.status = 'ok' THEN 1 END) AS ok, max(a.attempted_at) AS last_at FROM runs r LEFT JOIN attempts a ON a.attempted_at >= r.started_at AND a.attempted_at < r.finished_at GROUP BY r.started_at",
    "resolve_entities": W + ENTITIES_SQL + ", al AS (SELECT e.id, e.type, lower(p.p_brand || ' ' || CAST(p.p_partkey AS STRING)) AS norm FROM entities e JOIN {part} p ON p.p_partkey = e.id), nm AS (SELECT type, lower(name) AS norm, min(id) AS id FROM entities GROUP BY type, lower(name)), m AS (SELECT DISTINCT e.type, CASE e.id % 3 WHEN 0 THEN lower(e.name) WHEN 1 THEN al.norm ELSE 'new ' || lower(e.name) END AS norm FROM entities e JOIN al ON al.id = e.id), r AS (SELECT m.type, m.norm, coalesce(nm.id, al.id) AS id, CASE WHEN nm.id IS NOT NULL THEN 'exact' WHEN al.id IS NOT NULL THEN 'alias' ELSE 'created' END AS how FROM m LEFT JOIN nm ON nm.type = m.type AND nm.norm = m.norm LEFT JOIN al ON al.type = m.type AND al.norm = m.norm) SELECT r.type, r.norm, r.id, r.how, coalesce(e.status, 'proposed') AS status FROM r LEFT JOIN entities e ON e.id = r.id WHERE coalesce(e.status, 'proposed') <> 'rejected'",
}
