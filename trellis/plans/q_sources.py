"""Queries of exports and of stream operators run as batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import vectors as V
from ..sources import exports as X
from ..streaming import incremental as S
from .q_vectors import PAIRS, vectors
from .registry import query

c = F.col
NAME = "coalesce(ai_title, title)"
DOWN = "WITH RECURSIVE d(id, level) AS (SELECT id, 0 FROM nodes WHERE id = 'n-2' UNION ALL SELECT n.id, d.level + 1 FROM d JOIN nodes n ON n.parent_id = d.id)"

query("snk_01_bibtex", lambda t: X.bibtex(t.nodes), f"SELECT id, '@article{{paper_' || substr(id, 1, 8) || ',' || chr(10) || '  title = {{' || {NAME} || '}},' || chr(10) || '  year = {{' || year(make_timestamp(created_at * 1000)) || '}},' || chr(10) || coalesce('  keywords = {{' || tags || '}},' || chr(10), '') || '}}' || chr(10) AS value FROM nodes WHERE source = 'openaire'".replace("{{", "{").replace("}}", "}"))
query("snk_02_markdown", lambda t: X.markdown(t.nodes), f"SELECT id, repeat('#', least(depth + 1, 6)) || ' ' || {NAME} || chr(10) || chr(10) || coalesce('**Tags:** ' || tags || chr(10) || chr(10), '') || '---' || chr(10) AS value FROM nodes")
query("snk_04_dot_tree", lambda t: X.dot(t.nodes.where("depth <= 2")).where("part between 1 and 2").select("value"), f"WITH k AS (SELECT * FROM nodes WHERE depth <= 2) SELECT '  \"' || id || '\" [label=\"' || {NAME} || '\", fillcolor=' || CASE WHEN is_item THEN 'lightblue' ELSE 'lightyellow' END || ', style=filled];' AS value FROM k UNION ALL SELECT '  \"' || parent_id || '\" -> \"' || id || '\" [color=gray];' FROM k WHERE parent_id IN (SELECT id FROM k)")
query("snk_04_graphml_edges", lambda t: X.graphml(t.nodes.where("is_pinned"), t.edges).where("part = 3").select("value"), "SELECT '    <edge source=\"' || source_id || '\" target=\"' || target_id || '\"><data key=\"weight\">' || format('{:.3f}', weight) || '</data></edge>' AS value FROM edges WHERE weight > 0.7 AND source_id IN (SELECT id FROM nodes WHERE is_pinned) AND target_id IN (SELECT id FROM nodes WHERE is_pinned)")
query("snk_05_subtree", lambda t: X.selection(t.nodes, "n-2", True).select("id"), DOWN + " SELECT id FROM d")
query("str_08_high_water", lambda t: S.above_mark(t.messages, 1_704_500_000_000)[0].select("id", "sent_at"), "SELECT id, sent_at FROM messages WHERE sent_at > 1704500000000")
query("str_03_window_counts", lambda t: S.windowed_counts(t.events.select("ts", c("event_type").alias("kind"))).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "kind", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
query("str_02_session_windows", lambda t: S.sessions_by_gap(t.events.select("ts", c("user_id").alias("tab_id"))).select("tab_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "visits"), "WITH v AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM v) SELECT user_id AS tab_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS visits FROM k GROUP BY user_id, s")
query("str_05_session_detail", lambda t: R.upsert_last(t.visits.where("session_id = 's-3'").select("url", "seen_at", "dwell_ms"), ["url"], [F.desc("seen_at"), "dwell_ms"]), "SELECT url, max(seen_at) AS seen_at, first(dwell_ms ORDER BY seen_at DESC, dwell_ms) AS dwell_ms FROM visits WHERE session_id = 's-3' GROUP BY 1")
query("str_07_without_session", lambda t: t.visits.where("session_id != 's-3'").groupBy("session_id").agg(F.count("*").alias("n")), "SELECT session_id, count(*) AS n FROM visits WHERE session_id <> 's-3' GROUP BY 1")


def associations(t):
    """VEC-11: code items take the idea of the same parent that is nearest in meaning and time, 0.7 to 0.3."""
    n = vectors(t).select("id", "embedding", (c("vec_id") % 5).alias("parent"), (c("vec_id") % 3 == 0).alias("idea"), (c("vec_id") * 3_600_000).alias("created_at"))

    def rate(sims: np.ndarray, item: dict, idea: dict) -> np.ndarray:
        score = 0.7 * sims + 0.3 / (1 + np.abs(item["created_at"] - idea["created_at"]) / 3_600_000.0)
        return np.where(score > 0.3, score, -np.inf)

    best = V.best_matches(n.where("not idea"), n.where("idea"), 1, rate, extra=("created_at",), by="parent", last_id=True)
    return best.where("score > 0.3").select(c("query").alias("id"), c("id").alias("idea_id"), "score")


query("vec_11_associations", associations, f"WITH {PAIRS}, s AS (SELECT x.id, y.id AS idea_id, round(0.7 * round(list_cosine_similarity(x.e, y.e), 6) + 0.3 / (1 + abs(x.vec_id - y.vec_id)::DOUBLE), 6) AS score FROM v x JOIN v y ON x.vec_id % 5 = y.vec_id % 5 AND x.vec_id % 3 <> 0 AND y.vec_id % 3 = 0) SELECT id, first(idea_id ORDER BY score DESC, idea_id DESC) AS idea_id, max(score) AS score FROM s WHERE score > 0.3 GROUP BY 1")
