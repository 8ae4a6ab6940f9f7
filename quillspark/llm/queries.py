"""The queries of this subpackage and their SQL; the entry module adds them if the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM d)),
st AS (SELECT doc_id, s FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM st)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM runs GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffix_dedup import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"), window=200)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.html_extraction import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.sharding import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=16)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, closing=0)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillspark.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).drop("text_key")


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * n >= 80 * (len(p.sh) + len(q.sh) - n)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b)
SELECT s.doc_id, len(sh) AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(sh)
"""


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillspark.llm.piece_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
s AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.source_audit import source_audit

    return source_audit(table(spark, sf_dir, "documents"), least_documents=10, terms_shown=10)


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT c.lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY c.lang, source) + 2 * v)::HUGEINT AS p FROM c JOIN v ON v.lang = c.lang),
t AS (SELECT c.lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY c.lang, term),
q AS (SELECT t.lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY t.lang) + 2 * v)::HUGEINT AS q FROM t JOIN v ON v.lang = t.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.s = a.source AND z.o = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_audit": op13_source_audit,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_source_audit": OP13_SQL,
}
