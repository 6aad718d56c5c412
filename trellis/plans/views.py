"""The graph's tables, derived from the driver's tables.

Each view is one SQL text in a dialect that Spark and DuckDB share, but for @ms(x), the
epoch milliseconds of a timestamp, and @json(x, 'path'), a field of a JSON text. So a
view is the same on both sides of a comparison, and operators see ordinary DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Milliseconds at which the views' clock stands.
AS_OF = 1_000_000_000_000
DAY = 86_400_000

VIEWS: dict[str, str] = {
    "nodes": """
SELECT id, kind, title, content, created_at, updated_at, depth, is_item, is_universe, parent_id, child_count, ai_title, cluster_id, cluster_label,
  is_processed, agent_id, node_class, meta_type, content_type, source, author, is_private, privacy, is_pinned, last_accessed_at, human_edited, tags, needs_clustering, has_embedding
FROM (
  SELECT 'root' AS id, 'cluster' AS kind, 'All' AS title, CAST(NULL AS STRING) AS content, CAST(1500000000000 AS BIGINT) AS created_at, CAST(1500000000000 AS BIGINT) AS updated_at, 0 AS depth, false AS is_item, true AS is_universe, CAST(NULL AS STRING) AS parent_id, 5 AS child_count,
    CAST(NULL AS STRING) AS ai_title, CAST(NULL AS INT) AS cluster_id, CAST(NULL AS STRING) AS cluster_label, true AS is_processed, CAST(NULL AS STRING) AS agent_id, CAST(NULL AS STRING) AS node_class, CAST(NULL AS STRING) AS meta_type, CAST(NULL AS STRING) AS content_type, CAST(NULL AS STRING) AS source, CAST(NULL AS STRING) AS author,
    CAST(NULL AS BOOLEAN) AS is_private, CAST(NULL AS DOUBLE) AS privacy, false AS is_pinned, CAST(NULL AS BIGINT) AS last_accessed_at, CAST(NULL AS STRING) AS human_edited, CAST(NULL AS STRING) AS tags, false AS needs_clustering, false AS has_embedding
  UNION ALL
  SELECT 'r-' || CAST(r_regionkey AS STRING), 'cluster', r_name, NULL, 1500000000000, 1500000000000, 1, false, false, 'root', 4, NULL, NULL, r_name, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, false, true FROM region
  UNION ALL
  SELECT 'n-' || CAST(n_nationkey AS STRING), 'cluster', n_name, NULL, 1500000000000 + n_nationkey, 1500000000000, CASE WHEN n_nationkey % 9 = 0 THEN 3 ELSE 2 END, false, false, 'r-' || CAST(n_regionkey AS STRING), 10, NULL, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'Cluster ' || CAST(n_nationkey AS STRING) ELSE 'alpha, beta' END, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, CASE WHEN n_nationkey % 6 = 0 THEN '["title"]' END, NULL, false, true FROM nation
  UNION ALL
  SELECT 'c-' || CAST(c_custkey AS STRING), 'cluster', CASE WHEN c_custkey % 10 = 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) ELSE c_mktsegment || ' ' || CAST(c_custkey % 7 AS STRING) END, NULL, 1500000000000 + c_custkey, 1500000000000, 3, false, false, 'n-' || CAST(c_nationkey AS STRING), 1, CASE WHEN c_custkey % 3 = 0 THEN 'Topic ' || CAST(c_custkey % 40 AS STRING) END, CAST(c_custkey % 50 AS INT), NULL, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN c_custkey % 8 = 0 THEN 0.9 END, false, NULL, NULL, NULL, false, c_custkey % 2 = 0 FROM customer
  UNION ALL
  SELECT 'd-' || CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN 'thought' ELSE 'context' END, CASE WHEN doc_id % 40 = 0 THEN 'Untitled' ELSE 'Doc ' || CAST(doc_id % 300 AS STRING) || ' on ' || lang END, text, 800000000000 + (doc_id % 2000) * 86400000, 800000000000 + (doc_id % 2000) * 86400000 + (doc_id % 37) * 86400000, 4, true, false,
    CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'gone' ELSE 'c-' || CAST(doc_id % 97 AS STRING) END, CAST(doc_id % 3 AS INT),
    CASE WHEN doc_id % 4 = 0 THEN 'Topic ' || CAST(doc_id % 11 AS STRING) END, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN -1 ELSE CAST(doc_id % 13 AS INT) END, CASE WHEN doc_id % 7 <> 0 THEN 'Label ' || CAST(doc_id % 13 AS STRING) END,
    doc_id % 3 <> 0, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'human' WHEN 2 THEN 'coder' ELSE 'verifier' END,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'operational' WHEN 2 THEN 'meta' ELSE 'knowledge' END,
    CASE WHEN doc_id % 5 = 2 THEN CASE doc_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'contradiction' ELSE 'status' END END,
    CASE doc_id % 14 WHEN 0 THEN NULL WHEN 1 THEN 'insight' WHEN 2 THEN 'exploration' WHEN 3 THEN 'synthesis' WHEN 4 THEN 'question' WHEN 5 THEN 'planning' WHEN 6 THEN 'paper' WHEN 7 THEN 'code_function' WHEN 8 THEN 'investigation' WHEN 9 THEN 'discussion' WHEN 10 THEN 'debug' WHEN 11 THEN 'paste' WHEN 12 THEN 'idea' ELSE 'code' END,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'openaire' WHEN 2 THEN 'signal' WHEN 3 THEN 'markdown' ELSE 'chat' END, 'Author ' || CAST(doc_id % 9 AS STRING),
    CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END, CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END, doc_id % 41 = 0,
    CASE WHEN doc_id % 6 = 0 THEN 1650000000000 + (doc_id * 7919 % 100000) * 1000 END, CASE doc_id % 8 WHEN 0 THEN '["title"]' WHEN 1 THEN '["title","tags"]' END,
    CASE WHEN doc_id % 7 = 0 THEN '{"file_path":"src/m' || CAST(doc_id % 17 AS STRING) || '.py","line":' || CAST(doc_id % 100 AS STRING) || '}' ELSE '["t' || CAST(doc_id % 5 AS STRING) || '"]' END, doc_id % 2 = 0, doc_id % 3 = 0
  FROM documents) t
""",
    "edges": """
SELECT 'e-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id,
  'd-' || CAST(l_orderkey % n AS STRING) AS source_id, 'd-' || CAST((l_partkey * 7 + l_linenumber) % (n + 5) AS STRING) AS target_id,
  CASE (l_suppkey + l_linenumber) % 16 WHEN 0 THEN 'related' WHEN 1 THEN 'belongs_to' WHEN 2 THEN 'sibling' WHEN 3 THEN 'reference' WHEN 4 THEN 'because' WHEN 5 THEN 'contains' WHEN 6 THEN 'supports' WHEN 7 THEN 'contradicts' WHEN 8 THEN 'derives_from' WHEN 9 THEN 'summarizes' WHEN 10 THEN 'calls' WHEN 11 THEN 'documents' WHEN 12 THEN 'defined_in' WHEN 13 THEN 'clicked' WHEN 14 THEN 'session_item' ELSE 'supersedes' END AS kind,
  CASE WHEN l_linenumber <> 3 THEN 1 - l_discount END AS weight, CASE WHEN l_linenumber <> 5 THEN l_quantity / 50 END AS confidence,
  CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'human' WHEN 2 THEN 'coder' ELSE 'verifier' END AS agent_id,
  l_returnflag AS label, @ms(l_shipdate) AS created_at,
  CASE WHEN l_linenumber = 6 THEN 'e-' || CAST(l_orderkey AS STRING) || '-1' END AS superseded_by,
  CASE WHEN l_linenumber < 6 THEN '{"run_id":"run-' || CAST(l_orderkey % 40 AS STRING) || '","cost_usd":' || CAST(l_partkey % 9 AS STRING) || ',"num_turns":' || CAST(l_linenumber AS STRING) || ',"status":"' || CASE l_partkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'implemented' WHEN 2 THEN 'cancelled' ELSE 'escalated' END || '","experiment":"x' || CAST(l_orderkey % 2 AS STRING) || '"}' END AS metadata
FROM lineitem, (SELECT count(*) AS n FROM documents) c
""",
    "links": """
SELECT DISTINCT a, b FROM (
  SELECT 'c-' || CAST(o_custkey AS STRING) AS a, 's-' || CAST(l_suppkey AS STRING) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND l_discount >= 0.09) t
""",
    "item_tags": """
SELECT 'd-' || CAST(doc_id AS STRING) AS item_id, 'tag-' || CAST(k AS STRING) AS tag_id, 0.5 + k / 100.0 AS confidence
FROM documents, (SELECT n_nationkey AS k FROM nation) t WHERE (doc_id + k) % 11 = 0
""",
    "papers": """
SELECT 'd-' || CAST(doc_id AS STRING) AS node_id, 'Paper ' || CAST(doc_id % 400 AS STRING) AS title, CASE WHEN doc_id % 3 = 0 THEN '10.1/X' || CAST(doc_id % 200 AS STRING) END AS doi,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '12345' WHEN 2 THEN substr(text, 1, 40) ELSE substr(text, 1, 200) END AS abstract, text AS content, lang, doc_id % 2 = 0 AS has_pdf,
  CASE WHEN doc_id % 10 <> 0 THEN '20' || CAST(10 + doc_id % 14 AS STRING) || '-0' || CAST(1 + doc_id % 9 AS STRING) || '-15' END AS publication_date, 1300000000000 + doc_id * 86400000 AS created_at
FROM documents
""",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
    "visits": """
SELECT event_id, @ms(ts) AS seen_at, 'https://site' || CAST(user_id % 7 AS STRING) || '.org/p/' || CAST(CAST(@json(props, 'k') AS INT) AS STRING) AS url, user_id AS tab_id,
  event_type AS kind, CAST(floor(value * 100) AS BIGINT) AS dwell_ms, 's-' || CAST(user_id AS STRING) AS session_id FROM events
""",
    "messages": """
SELECT event_id AS id, user_id % 5 AS conversation_id, CAST(user_id AS STRING) AS author, @ms(ts) AS sent_at,
  CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'ok' WHEN 2 THEN 'LGTM' WHEN 3 THEN 'I think we should ship this thing soon' WHEN 4 THEN 'see https://site.org/a/' || CAST(event_id AS STRING) WHEN 5 THEN 'agreed, let us do that' WHEN 6 THEN 'no' ELSE 'a longer message about ' || event_type || ' and what follows from it' END AS body
FROM events
""",
}


def _macros(sql: str, spark: bool) -> str:
    if spark:
        sql = re.sub(r"@ms\((\w+)\)", r"(CAST(datediff(CAST(\1 AS DATE), DATE '1970-01-01') AS BIGINT) * 86400000 + hour(\1) * 3600000 + minute(\1) * 60000 + CAST(floor(extract(SECOND FROM \1) * 1000) AS BIGINT))", sql)
        return re.sub(r"@json\((\w+), '(\w+)'\)", r"get_json_object(\1, '$.\2')", sql)
    sql = re.sub(r"@ms\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)
    return re.sub(r"@json\((\w+), '(\w+)'\)", r"json_extract_string(\1, '$.\2')", sql)


class Tables:
    """The tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name in VIEWS:
            sql = _macros(VIEWS[name], True)
            used = {t: getattr(self, t) for t in [*BASE, *VIEWS] if t != name and re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
            sql = sql.replace("{", "{{").replace("}", "}}")
            for t in used:
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
            return self.spark.sql(sql, **used)
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """The statement with the views that it uses before it, for DuckDB."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = [f"{v} AS ({_macros(VIEWS[v], False).strip()})" for v in used]
    sql = sql.strip()
    if not views:
        return sql
    if m := re.match(r"WITH (RECURSIVE )?", sql):
        return f"WITH {m[1] or ''}{', '.join(views)}, {sql[m.end():]}"
    return f"WITH {', '.join(views)} {sql}"
