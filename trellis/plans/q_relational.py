"""Queries of scans, filters, joins, aggregations, windows and keyed changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import GRAPH_VISIBLE, SEMANTIC_EDGES, VISIBLE
from ..operators import relational as R
from .registry import query
from .views import AS_OF, DAY

c = F.col


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SHOWN = f"(content_type IS NULL OR content_type IN {_in(GRAPH_VISIBLE)} OR content_type ILIKE 'code_%')"
SEM = _in(SEMANTIC_EDGES)
TITLE = "coalesce(ai_title, title)"
SINCE = 850_000_000_000

# ---- scans
query("src_01_nodes", lambda t: t.nodes.select("id", "kind", "created_at", "depth"), "SELECT id, kind, created_at, depth FROM nodes")
query("src_01_edges", lambda t: t.edges.select("id", "source_id", "target_id", "kind"), "SELECT id, source_id, target_id, kind FROM edges")
query("src_02_node_by_id", lambda t: R.by_id(t.nodes, "d-7").select("id", "title"), "SELECT id, title FROM nodes WHERE id = 'd-7'")
query("src_03_edges_of_source", lambda t: R.edges_of_source(t.edges, t.nodes, "markdown").select("id", "source_id", "target_id"), "SELECT id, source_id, target_id FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.source = 'markdown' AND n.id IN (e.source_id, e.target_id))")
query("src_04_delta_scan", lambda t: R.changed_since(t.nodes, SINCE).select("id", "updated_at"), f"SELECT id, updated_at FROM nodes WHERE updated_at > {SINCE}")
query("src_15_code_files", lambda t: R.code_files(t.nodes), "SELECT json_extract_string(tags, '$.file_path') AS file_path, count(*) AS n FROM nodes WHERE tags LIKE '{%' GROUP BY 1 HAVING file_path IS NOT NULL")
query("src_15_items_at_path", lambda t: R.items_at_path(t.nodes, "src/m0.py"), "SELECT id FROM nodes WHERE tags LIKE '{\"file_path\":\"src/m0.py\"%'")

# ---- filters
VIS = f"is_item AND (content_type IN {_in(VISIBLE)} OR content_type ILIKE 'code_%') AND (source IS NULL OR source <> 'signal')"
query("flt_01_visible_items", lambda t: R.visible_items(t.nodes).select("id", "created_at"), f"SELECT id, created_at FROM nodes WHERE {VIS}")
query("flt_01_items_page", lambda t: R.page(t.nodes.where("is_item"), [F.desc("created_at"), "id"], 20, 40).select("id", "created_at"), "SELECT id, created_at FROM nodes WHERE is_item ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
query("flt_02_at_depth", lambda t: t.nodes.where("depth = 2").select("id", "title"), "SELECT id, title FROM nodes WHERE depth = 2")
query("flt_02_children_page", lambda t: R.page(R.children(t.nodes, "n-2"), [F.desc("child_count"), "title", "id"], 10).select("id", "child_count", "title"), "SELECT id, child_count, title FROM nodes WHERE parent_id = 'n-2' ORDER BY child_count DESC, title, id LIMIT 10")
query("flt_03_graph_children", lambda t: R.graph_children(t.nodes, "c-5").select("id", "content_type"), f"SELECT id, content_type FROM nodes WHERE parent_id = 'c-5' AND (NOT is_item OR {SHOWN})")
query("flt_04_supporting", lambda t: R.supporting_items(t.nodes, "c-8").select("id", "content_type"), "SELECT id, content_type FROM nodes WHERE parent_id = 'c-8' AND content_type IN ('investigation', 'discussion', 'reference', 'creative')")
query("flt_05_work_queues", lambda t: t.nodes.where("is_item").select("id", (~c("is_processed")).alias("to_process"), (~c("has_embedding")).alias("to_embed"), c("needs_clustering").alias("to_cluster"), c("privacy").isNull().alias("to_score")).where("to_process or to_embed or to_cluster or to_score"), "SELECT id, NOT is_processed AS to_process, NOT has_embedding AS to_embed, needs_clustering AS to_cluster, privacy IS NULL AS to_score FROM nodes WHERE is_item AND (NOT is_processed OR NOT has_embedding OR needs_clustering OR privacy IS NULL)")
query("flt_06_pinned", lambda t: t.nodes.where(c("is_pinned") & R.shown()).select("id"), f"SELECT id FROM nodes WHERE is_pinned AND {SHOWN}")
query("flt_06_recent", lambda t: R.page(t.nodes.where(c("last_accessed_at").isNotNull() & R.shown()), [F.desc("last_accessed_at"), "id"], 15).select("id", "last_accessed_at"), f"SELECT id, last_accessed_at FROM nodes WHERE last_accessed_at IS NOT NULL AND {SHOWN} ORDER BY last_accessed_at DESC, id LIMIT 15")
query("flt_07_id_prefix", lambda t: R.page(t.nodes.where(c("id").startswith("d-1")), ["id"], 10).select("id"), "SELECT id FROM nodes WHERE starts_with(id, 'd-1') ORDER BY id LIMIT 10")
query("flt_07_title_search", lambda t: R.search_titles(t.nodes, "ON FR").select("id", "title"), "SELECT id, title FROM nodes WHERE is_item AND (title ILIKE '%ON FR%' OR ai_title ILIKE '%ON FR%')")
query("flt_08_edges_of_node", lambda t: R.edges_of(t.edges, "d-7").select("id", "kind"), "SELECT id, kind FROM edges WHERE source_id = 'd-7' OR target_id = 'd-7'")
query("flt_08_edges_of_many", lambda t: R.edges_of_many(t.edges, t.nodes.where("is_pinned")).select("id", "weight"), "SELECT id, coalesce(weight, 1.0) AS weight FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE is_pinned) OR target_id IN (SELECT id FROM nodes WHERE is_pinned)")
query("flt_08_count_by_source_kind", lambda t: t.edges.groupBy("source_id", "kind").agg(F.count("*").alias("n")), "SELECT source_id, kind, count(*) AS n FROM edges GROUP BY 1, 2")
query("flt_09_semantic_edges", lambda t: R.semantic_edges_of_many(t.edges, t.nodes.where("is_pinned")).select("id", "kind"), f"SELECT id, kind FROM edges WHERE kind IN {SEM} AND (source_id IN (SELECT id FROM nodes WHERE is_pinned) OR target_id IN (SELECT id FROM nodes WHERE is_pinned))")
query("flt_11_belongs_to", lambda t: R.page(t.edges.where("kind = 'belongs_to' and agent_id = 'human'"), [F.desc_nulls_last("weight"), "id"], 25).select("id", "weight"), "SELECT id, weight FROM edges WHERE kind = 'belongs_to' AND agent_id = 'human' ORDER BY weight DESC NULLS LAST, id LIMIT 25")
query("flt_12_live_meta", lambda t: R.live_meta(t.nodes, t.edges, "summary").select("id", "meta_type"), "SELECT id, meta_type FROM nodes WHERE node_class = 'meta' AND meta_type = 'summary' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'supersedes' AND e.target_id = nodes.id)")
query("flt_13_operational_by_agent", lambda t: t.nodes.where((c("node_class") == "operational") & (c("agent_id") == "coder") & (c("created_at") >= SINCE)).select("id"), f"SELECT id FROM nodes WHERE node_class = 'operational' AND agent_id = 'coder' AND created_at >= {SINCE}")
query("flt_14_turns_in_order", lambda t: t.turns.where("conv_id = 3").select("turn", "role", F.md5("text").alias("h")), "SELECT turn, role, md5(text) AS h FROM turns WHERE conv_id = 3")
query("flt_15_universe", lambda t: t.nodes.where("is_universe").orderBy(F.when(c("id") == "root", 0).otherwise(1), "id").limit(1).select("id"), "SELECT id FROM nodes WHERE is_universe ORDER BY CASE WHEN id = 'root' THEN 0 ELSE 1 END, id LIMIT 1")
query("flt_16_search_filter", lambda t: R.search_filter(t.nodes, 860_000_000_000, "insight", "author 1", 30 * DAY).select("id"), f"SELECT id FROM nodes WHERE content_type = 'insight' AND lower(author) LIKE '%author 1%' AND created_at >= {860_000_000_000 - 30 * DAY}")
query("flt_17_shareable", lambda t: R.shareable(t.nodes, 0.6).select("id", "privacy"), "SELECT id, privacy FROM nodes WHERE is_item AND privacy >= 0.6")
query("flt_18_human_edited", lambda t: R.human_edited(t.nodes, "tags").select("id"), "SELECT id FROM nodes WHERE list_contains(json_extract_string(human_edited, '$[*]'), 'tags')")
query("flt_19_children_by_label", lambda t: R.children(t.nodes, "c-5").where(F.coalesce("cluster_label", "ai_title", "title").isin("Label 5", "Label 1")).select("id"), "SELECT id FROM nodes WHERE parent_id = 'c-5' AND coalesce(cluster_label, ai_title, title) IN ('Label 5', 'Label 1')")
query("flt_19_to_be_named", lambda t: t.nodes.where(c("cluster_label").like("%,%") | c("cluster_label").ilike("Cluster %")).select("cluster_id", "cluster_label").distinct(), "SELECT DISTINCT cluster_id, cluster_label FROM nodes WHERE cluster_label LIKE '%,%' OR cluster_label ILIKE 'Cluster %'")
query("flt_20_leaf_content", lambda t: t.nodes.select("id", F.length(F.coalesce("content", F.lit(""))).alias("n")), "SELECT id, length(coalesce(content, ''))::INT AS n FROM nodes")

# ---- joins
query("jn_01_edge_query", lambda t: R.edge_query(t.edges, t.nodes, kind="supports", agent="coder", target_agent="human", confidence_min=0.5, since=800_000_000_000, not_superseded=True, limit=30).select("id", "source_title", "target_title", "created_at"), "SELECT e.id, coalesce(s.ai_title, s.title) AS source_title, coalesce(g.ai_title, g.title) AS target_title, e.created_at FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes g ON g.id = e.target_id WHERE e.kind = 'supports' AND e.agent_id = 'coder' AND g.agent_id = 'human' AND e.confidence >= 0.5 AND e.created_at >= 800000000000 AND e.superseded_by IS NULL ORDER BY e.created_at DESC, e.id LIMIT 30")
query("jn_02_item_edges", lambda t: R.item_edges(t.edges, t.nodes).select("id", "source_id", "target_id", "weight"), "SELECT id, source_id, target_id, weight FROM edges e WHERE weight IS NOT NULL AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.source_id AND n.is_item AND coalesce(n.source, '') <> 'signal') AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.target_id AND n.is_item AND coalesce(n.source, '') <> 'signal')")
query("jn_03_cluster_items", lambda t: R.cluster_items(t.edges, t.nodes, "d-3", "cluster-3", 0.95).select("id"), "SELECT id FROM nodes WHERE is_item AND id IN (SELECT source_id FROM edges WHERE kind = 'belongs_to' AND target_id IN ('d-3', 'cluster-3') AND (weight IS NULL OR weight >= 0.95))")
query("jn_04_related_items", lambda t: R.related_items(t.edges, t.nodes, "d-7", 0.95).select("id", "title"), "WITH b AS (SELECT source_id, target_id FROM edges WHERE kind = 'belongs_to' AND weight >= 0.95) SELECT id, title FROM nodes WHERE id IN (SELECT x.source_id FROM b x JOIN b y USING (target_id) WHERE y.source_id = 'd-7' AND x.source_id <> 'd-7')")
query("jn_05_shared_tags", lambda t: R.shared_tags(t.item_tags, "d-1", "d-12"), "SELECT DISTINCT a.tag_id FROM item_tags a JOIN item_tags b USING (tag_id) WHERE a.item_id = 'd-1' AND b.item_id = 'd-12'")
query("jn_05_items_with_tags", lambda t: R.items_with_any_tag(t.item_tags, ["TAG-3", "tag-4"]), "SELECT DISTINCT item_id FROM item_tags WHERE lower(tag_id) IN ('tag-3', 'tag-4')")
CROSS = f"""WITH x AS (SELECT ca.parent_id AS parent, least(s.parent_id, g.parent_id) AS a, greatest(s.parent_id, g.parent_id) AS b FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes g ON g.id = e.target_id JOIN nodes ca ON ca.id = s.parent_id JOIN nodes cb ON cb.id = g.parent_id
  WHERE e.kind IN {SEM} AND s.parent_id <> g.parent_id AND ca.parent_id = cb.parent_id AND NOT ca.is_item AND NOT cb.is_item)"""
query("jn_06_cross_edges", lambda t: R.cross_edge_counts(t.edges, t.nodes, "n-2"), CROSS + " SELECT parent, a, b, count(*) AS n FROM x WHERE parent = 'n-2' GROUP BY ALL")
query("jn_07_sibling_cross_counts", lambda t: R.sibling_cross_counts(t.edges, t.nodes), CROSS + ", z AS (SELECT parent_id, count(*) AS size FROM nodes WHERE is_item GROUP BY 1) SELECT x.parent, a, b, count(*) AS n, coalesce(any_value(za.size), 0) AS size_a, coalesce(any_value(zb.size), 0) AS size_b FROM x LEFT JOIN z za ON za.parent_id = a LEFT JOIN z zb ON zb.parent_id = b GROUP BY x.parent, a, b")
query("jn_08_sibling_pairs", lambda t: R.sibling_pairs(t.nodes, "n-2"), "WITH z AS (SELECT id, (SELECT count(*) FROM nodes i WHERE i.parent_id = k.id AND i.is_item) AS size FROM nodes k WHERE parent_id = 'n-2' AND NOT is_item) SELECT x.id AS a, y.id AS b, x.size AS size_a, y.size AS size_b FROM z x JOIN z y ON x.id < y.id")
query("jn_10_duplicate_titles", lambda t: R.duplicate_titles(t.papers).select("node_id", "title", "doi"), "SELECT node_id, title, doi FROM papers WHERE title IN (SELECT title FROM papers GROUP BY 1 HAVING count(*) > 1)")
query("jn_11_dead_edges", lambda t: R.dead_edges(t.edges, t.nodes).select("id"), "SELECT id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.source_id) OR NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.target_id)")
query("jn_12_orphan_items", lambda t: R.orphan_items(t.nodes).select("id", "parent_id"), "SELECT id, parent_id FROM nodes n WHERE is_item AND (parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id))")
query("jn_13_operational_gc", lambda t: R.stale_operational(t.nodes, t.edges.where("kind = 'related' and superseded_by is not null"), AS_OF, 30, ("untitled",)).select("id"), f"SELECT id FROM nodes n WHERE node_class = 'operational' AND created_at < {AS_OF - 30 * DAY} AND title NOT ILIKE 'untitled%' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'related' AND e.superseded_by IS NOT NULL AND (e.source_id = n.id OR e.target_id = n.id))")
query("jn_14_contradictions", lambda t: R.open_contradictions(t.edges, t.nodes, 40), "WITH x AS (SELECT * FROM edges WHERE kind = 'contradicts' AND superseded_by IS NULL ORDER BY created_at DESC, id LIMIT 40) SELECT x.id, coalesce(s.ai_title, s.title, substr(x.source_id, 1, 8)) AS source_title, coalesce(g.ai_title, g.title, substr(x.target_id, 1, 8)) AS target_title FROM x LEFT JOIN nodes s ON s.id = x.source_id LEFT JOIN nodes g ON g.id = x.target_id")
query("jn_15_verification_chains", lambda t: R.verification_chains(t.edges), "SELECT target_id AS task, CASE WHEN bool_or(source_id IN (SELECT target_id FROM edges WHERE kind = 'supports')) THEN 'verified' ELSE 'implemented' END AS state FROM edges WHERE kind = 'derives_from' GROUP BY 1")
query("jn_17_similar_with_calls", lambda t: R.similar_with_calls(t.edges, t.nodes.where("is_pinned").select("id", F.lit(0.5).alias("similarity")), "d-7", 12), "WITH near AS (SELECT id, min(why) AS why, 1.0::DOUBLE AS similarity, 0 AS first FROM (SELECT target_id AS id, kind || ':out' AS why FROM edges WHERE kind IN ('calls', 'documents') AND source_id = 'd-7' UNION ALL SELECT source_id, kind || ':in' FROM edges WHERE kind IN ('calls', 'documents') AND target_id = 'd-7') GROUP BY 1) SELECT id, why, similarity FROM (SELECT * FROM near UNION ALL SELECT id, 'similar', 0.5, 1 FROM nodes WHERE is_pinned AND id NOT IN (SELECT id FROM near)) WHERE id <> 'd-7' ORDER BY first, similarity DESC, id LIMIT 12")
query("jn_18_callers_callees", lambda t: R.code_neighbours(t.edges, t.nodes.where(R.is_code())), "WITH k AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'calls') SELECT id, (SELECT array_to_string(list(x ORDER BY x), ',') FROM (SELECT source_id AS x FROM k WHERE target_id = n.id ORDER BY x LIMIT 5)) AS callers, (SELECT array_to_string(list(x ORDER BY x), ',') FROM (SELECT target_id AS x FROM k WHERE source_id = n.id ORDER BY x LIMIT 5)) AS callees FROM nodes n WHERE content_type ILIKE 'code_%'")
query("jn_19_folder_view", lambda t: R.folder_view(t.nodes, "src/m1"), "SELECT json_extract_string(tags, '$.file_path') AS file_path, array_to_string(list(id ORDER BY id), ',') AS ids, count(*) AS n FROM nodes WHERE tags LIKE '{\"file_path\":\"src/m1%' GROUP BY 1")
query("jn_20_node_edges", lambda t: R.node_edges(t.edges, t.nodes, "d-7").select("id", "direction", "other", "title"), f"SELECT e.id, CASE WHEN source_id = 'd-7' THEN 'out' ELSE 'in' END AS direction, CASE WHEN source_id = 'd-7' THEN target_id ELSE source_id END AS other, {TITLE} AS title FROM edges e LEFT JOIN nodes n ON n.id = CASE WHEN source_id = 'd-7' THEN target_id ELSE source_id END WHERE 'd-7' IN (source_id, target_id)")
query("jn_21_pinned_state", lambda t: t.nodes.where("is_pinned").alias("n").join(t.nodes.select(c("id").alias("pid")), c("parent_id") == c("pid"), "left").select("id", F.when(c("pid").isNull(), "orphan").otherwise("ok").alias("state")), "SELECT n.id, CASE WHEN p.id IS NULL THEN 'orphan' ELSE 'ok' END AS state FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id WHERE n.is_pinned")

# ---- aggregations
query("agg_01_stats", lambda t: R.stats(t.nodes), "SELECT count(*) AS total, count_if(is_item) AS items, count_if(NOT is_item) AS categories, count_if(is_processed) AS processed, count_if(is_item AND NOT is_processed) AS unprocessed, count_if(has_embedding) AS embedded, count_if(is_item AND cluster_id IS NOT NULL) AS clustered, count_if(is_pinned) AS pinned FROM nodes")
query("agg_02_edges_by_agent", lambda t: R.counts_by(t.edges, "agent_id", "human"), "SELECT coalesce(agent_id, 'human') AS agent_id, count(*) AS n FROM edges GROUP BY 1")
query("agg_02_nodes_by_class", lambda t: R.counts_by(t.nodes, "node_class", "knowledge"), "SELECT coalesce(node_class, 'knowledge') AS node_class, count(*) AS n FROM nodes GROUP BY 1")
query("agg_03_cluster_sizes", lambda t: t.nodes.where("is_item and cluster_id is not null and not needs_clustering").groupBy("cluster_id", "cluster_label").agg(F.count("*").alias("n")), "SELECT cluster_id, cluster_label, count(*) AS n FROM nodes WHERE is_item AND cluster_id IS NOT NULL AND NOT needs_clustering GROUP BY ALL")
query("agg_04_child_counts", lambda t: R.child_counts(t.nodes), "SELECT id, (SELECT count(*) FROM nodes k WHERE k.parent_id = n.id) AS child_count FROM nodes n WHERE NOT is_item")
LISTED = SHOWN.replace(", 'reference'", "")
query("agg_04_wrong_child_counts", lambda t: R.wrong_child_counts(t.nodes), f"SELECT * FROM (SELECT id, child_count AS stored, (SELECT count(*) FROM nodes k WHERE k.parent_id = n.id AND {LISTED.replace('content_type', 'k.content_type')}) AS actual FROM nodes n) WHERE stored <> actual")
query("agg_05_depths", lambda t: t.nodes.groupBy("depth").agg(F.count("*").alias("n"), F.count_if("is_item").alias("items")), "SELECT depth, count(*) AS n, count_if(is_item) AS items FROM nodes GROUP BY 1")
query("agg_06_privacy", lambda t: R.privacy_stats(t.nodes), "SELECT count_if(is_item) AS items, count_if(is_item AND privacy IS NOT NULL) AS scored, count_if(is_item AND privacy IS NULL) AS unscored, count_if(is_item AND privacy < 0.3) AS private, count_if(is_item AND privacy >= 0.3 AND privacy < 0.7) AS semi_private, count_if(is_item AND privacy >= 0.7) AS public, count_if(is_item AND is_private) AS flagged, round(avg(privacy) FILTER (is_item), 6) AS mean FROM nodes")
query("agg_07_runs", lambda t: R.runs(t.edges), "SELECT json_extract_string(metadata, '$.run_id') AS run_id, min(created_at) AS started, max(created_at) AS ended, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT agent_id) FILTER (agent_id IS NOT NULL)), ','), '') AS agents FROM edges WHERE metadata IS NOT NULL GROUP BY 1")
query("agg_08_run_edges", lambda t: R.run_edges(t.edges, "run-3").select("id"), "SELECT id FROM edges WHERE json_extract_string(metadata, '$.run_id') = 'run-3'")
query("agg_08_rollback_preview", lambda t: R.rollback_preview(t.edges, t.nodes, "run-3"), "WITH s AS (SELECT min(created_at) AS t0, max(created_at) AS t1 FROM edges WHERE json_extract_string(metadata, '$.run_id') = 'run-3') SELECT id, agent_id, created_at FROM nodes, s WHERE node_class = 'operational' AND created_at BETWEEN t0 AND t1 AND agent_id IN (SELECT agent_id FROM edges WHERE json_extract_string(metadata, '$.run_id') = 'run-3' AND agent_id IS NOT NULL)")
METRICS = "WITH m AS (SELECT id, created_at, agent_id, json_extract_string(metadata, '$.run_id') AS run_id, json_extract_string(metadata, '$.cost_usd')::DOUBLE AS cost, json_extract_string(metadata, '$.num_turns')::BIGINT AS turns, json_extract_string(metadata, '$.status') AS status, json_extract_string(metadata, '$.experiment') AS experiment FROM edges WHERE metadata IS NOT NULL)"
query("agg_09_run_list", lambda t: R.run_list(t.edges), METRICS + " SELECT run_id, coalesce(CASE min(CASE status WHEN 'planned' THEN 1 WHEN 'verified' THEN 2 WHEN 'implemented' THEN 3 WHEN 'cancelled' THEN 4 WHEN 'escalated' THEN 5 END) WHEN 1 THEN 'planned' WHEN 2 THEN 'verified' WHEN 3 THEN 'implemented' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'escalated' END, 'pending') AS status, sum(cost) AS cost, sum(turns)::BIGINT AS turns, count(DISTINCT agent_id) AS agents, max(created_at) AS ended FROM m GROUP BY 1")
query("agg_10_run_costs", lambda t: R.run_costs(t.edges, 900_000_000_000), METRICS + " SELECT status, count(*) AS n, sum(cost) AS total, round(avg(cost), 6) AS mean FROM m WHERE created_at >= 900000000000 GROUP BY 1")
query("agg_11_top_runs", lambda t: R.run_list(t.edges).orderBy(F.desc("cost"), "run_id").limit(5).select("run_id", "cost"), METRICS + " SELECT run_id, sum(cost) AS cost FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
query("agg_12_run_statistics", lambda t: R.run_statistics(t.edges, "x1"), METRICS + " SELECT count(*) AS n, median(cost) AS median_cost, round(avg(turns), 6) AS mean_turns, round(avg((status = 'verified')::INT), 6) AS success FROM m WHERE experiment = 'x1'")
query("agg_13_compare", lambda t: R.compare_experiments(t.edges, "x0", "x1"), METRICS + " SELECT experiment, sum(cost) AS cost, sum(turns)::BIGINT AS turns, count(DISTINCT agent_id) AS agents, max(created_at) - min(created_at) AS wall_ms FROM m WHERE experiment IN ('x0', 'x1') GROUP BY 1")
query("agg_14_run_timeline", lambda t: R.run_timeline(t.edges, "run-3"), METRICS + " SELECT id, row_number() OVER w AS step, sum(cost) OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS spent FROM m WHERE run_id = 'run-3' WINDOW w AS (ORDER BY created_at, id)")
query("agg_15_dashboard", lambda t: R.run_list(t.edges).agg(F.count("*").alias("runs"), F.sum("cost").alias("cost"), F.round(F.avg((c("status") == "verified").cast("int")), 6).alias("success")), METRICS + ", r AS (SELECT run_id, sum(cost) AS cost, bool_or(status = 'verified') AND NOT bool_or(status = 'planned') AS ok FROM m GROUP BY 1) SELECT count(*) AS runs, sum(cost) AS cost, round(avg(ok::INT), 6) AS success FROM r")
query("agg_16_graph_status", lambda t: R.graph_status(t.edges, t.nodes, 1_000_000_000_000), f"SELECT count_if(created_at >= {10**12 - DAY}) AS edges_24h, count_if(created_at >= {10**12 - 7 * DAY}) AS edges_7d, count_if(kind = 'contradicts' AND superseded_by IS NULL) AS contradictions, round(count(DISTINCT CASE WHEN kind = 'summarizes' AND superseded_by IS NULL THEN target_id END) / (SELECT count(*) FROM nodes WHERE is_item AND coalesce(node_class, 'knowledge') = 'knowledge'), 6) AS coverage, round(1 - count_if(kind = 'contradicts' AND superseded_by IS NULL) / count_if(superseded_by IS NULL), 6) AS coherence FROM edges")
query("agg_17_most_connected", lambda t: R.most_connected(t.edges), "SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
query("agg_17_edge_types", lambda t: t.edges.groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM edges GROUP BY 1")
PICK = ", ".join(f"list_sort(list(weight))[floor(count(*) * {p} / 100)::BIGINT + 1] AS p{p}" for p in (10, 25, 50, 75, 90))
query("agg_18_weight_statistics", lambda t: R.weight_statistics(t.edges), f"SELECT *, round(p75 - p25, 6) AS iqr FROM (SELECT count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS std, min(weight) AS low, max(weight) AS high, {PICK} FROM edges WHERE weight IS NOT NULL)")
query("agg_20_tag_counts", lambda t: t.item_tags.groupBy("tag_id").agg(F.countDistinct("item_id").alias("n")), "SELECT tag_id, count(DISTINCT item_id) AS n FROM item_tags GROUP BY 1")
query("agg_20_item_tags", lambda t: t.item_tags.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("tag_id")), ",").alias("tags")), "SELECT item_id, array_to_string(list(tag_id ORDER BY tag_id), ',') AS tags FROM item_tags GROUP BY 1")
query("agg_21_sessions", lambda t: R.sessions(t.visits), "SELECT session_id, count(*) AS n, max(seen_at) - min(seen_at) AS duration_ms, first(url ORDER BY seen_at, url) AS entry FROM visits GROUP BY 1")
query("agg_22_category_names", lambda t: t.nodes.where("not is_item").select(F.coalesce("cluster_label", "title").alias("name")).distinct(), "SELECT DISTINCT coalesce(cluster_label, title) AS name FROM nodes WHERE NOT is_item")
query("agg_24_next_cluster_id", lambda t: t.nodes.agg((F.coalesce(F.max("cluster_id"), F.lit(-1)) + 1).alias("next_id"), F.count_if(c("cluster_id").isNotNull()).alias("clustered")), "SELECT coalesce(max(cluster_id), -1) + 1 AS next_id, count(cluster_id) AS clustered FROM nodes")

# ---- windows, sorts, sets
query("win_03_recency", lambda t: R.recency(t.edges), "WITH x AS (SELECT source_id AS node, id, created_at FROM edges UNION ALL SELECT target_id, id, created_at FROM edges WHERE source_id <> target_id) SELECT node, id, round(CASE WHEN max(created_at) OVER w > min(created_at) OVER w THEN (created_at - min(created_at) OVER w) / (max(created_at) OVER w - min(created_at) OVER w) ELSE 1.0 END, 6) AS recency FROM x WINDOW w AS (PARTITION BY node)")
query("win_04_weight_gaps", lambda t: R.weight_gaps(t.edges, 3), "WITH w AS (SELECT DISTINCT weight FROM edges WHERE weight IS NOT NULL), g AS (SELECT weight, round(lag(weight) OVER (ORDER BY weight DESC) - weight, 6) AS gap FROM w) SELECT gap, round(weight + gap / 2, 6) AS threshold FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, weight DESC LIMIT 3")
query("srt_01_top_titles", lambda t: R.page(t.nodes, ["title", F.desc("created_at"), "id"], 20, 5).select("id", "title"), "SELECT id, title FROM nodes ORDER BY title, created_at DESC, id LIMIT 20 OFFSET 5")
query("set_01_edge_ends", lambda t: t.edges.select(c("source_id").alias("id")).unionAll(t.edges.select("target_id")).groupBy("id").agg(F.count("*").alias("n")), "SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1")
query("set_02_childless", lambda t: t.nodes.where("not is_item").select("id").exceptAll(t.nodes.where("parent_id is not null").select(c("parent_id").alias("id")).distinct()), "SELECT id FROM nodes WHERE NOT is_item EXCEPT SELECT parent_id FROM nodes")
query("set_03_anchors", lambda t: R.prioritised_anchors(t.nodes.where("is_pinned").select("id", c("created_at").alias("rank")), t.nodes.where("content_type = 'insight'").select("id", c("created_at").alias("rank")), 40), "SELECT id, min(first) AS first FROM (SELECT id, 0 AS first, created_at AS r FROM nodes WHERE is_pinned UNION ALL SELECT id, 1, created_at FROM nodes WHERE content_type = 'insight') GROUP BY id ORDER BY min(first), min(r), id LIMIT 40")
query("set_04_distinct_sources", lambda t: t.nodes.select("source", "kind").distinct(), "SELECT DISTINCT source, kind FROM nodes")

# ---- exports and keyed changes
query("snk_03_json", lambda t: t.nodes.where("depth <= 2").select("id", F.to_json(F.struct("id", "title", "depth")).alias("json")), """SELECT id, '{"id":"' || id || '","title":"' || title || '","depth":' || depth || '}' AS json FROM nodes WHERE depth <= 2""")
SHARE = "NOT (coalesce(privacy < 0.5, false) OR (privacy IS NULL AND coalesce(is_private, false)))"
query("snk_06_share_nodes", lambda t: R.share_export(t.nodes, 0.5).select("id"), f"SELECT id FROM nodes WHERE {SHARE}")
query("snk_06_share_edges", lambda t: R.live_edges(t.edges, R.share_export(t.nodes, 0.5)).select("id"), f"WITH k AS (SELECT id FROM nodes WHERE {SHARE}) SELECT e.id FROM edges e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)")
query("snk_08_insert_ignore", lambda t: R.insert_ignore(t.nodes.where("depth < 3").select("id", "title"), t.nodes.where("depth between 2 and 3").select("id", F.upper("title").alias("title"))), "SELECT id, title FROM nodes WHERE depth < 3 UNION ALL SELECT id, upper(title) FROM nodes n WHERE depth BETWEEN 2 AND 3 AND NOT EXISTS (SELECT 1 FROM nodes o WHERE o.depth < 3 AND o.id = n.id)")
query("snk_09_delete", lambda t: R.delete(t.nodes, t.nodes.where("is_pinned")).select("id"), "SELECT id FROM nodes WHERE NOT is_pinned")
query("key_01_supersede", lambda t: R.supersede(t.edges, "e-1-1-1", "x").groupBy(c("superseded_by").isNull().alias("live")).agg(F.count("*").alias("n")), "SELECT (CASE WHEN id = 'e-1-1-1' THEN 'x' ELSE superseded_by END) IS NULL AS live, count(*) AS n FROM edges GROUP BY 1")
query("key_02_new_meta_version", lambda t: R.new_meta_version(t.edges, "d-7", "v2"), "SELECT 'v2-' || id AS id, 'v2' AS source_id, target_id, kind FROM edges WHERE source_id = 'd-7' AND superseded_by IS NULL AND kind <> 'supersedes'")
query("key_03_with_run_id", lambda t: R.with_run_id(t.edges, "run-z").select("id", F.get_json_object("metadata", "$.run_id").alias("run_id"), F.get_json_object("metadata", "$.status").alias("status")), "SELECT id, 'run-z' AS run_id, json_extract_string(metadata, '$.status') AS status FROM edges")
query("key_04_summarizer_view", lambda t: R.role_view(t.nodes, "summarizer").select("id"), "SELECT id FROM nodes WHERE coalesce(node_class, 'knowledge') <> 'meta' OR meta_type = 'contradiction'")
query("key_04_synthesizer_view", lambda t: R.role_view(t.nodes, "synthesizer").select("id"), "SELECT id FROM nodes WHERE is_item AND coalesce(node_class, 'knowledge') IN ('knowledge', 'operational')")
query("key_05_protected_update", lambda t: R.protected_update(t.nodes, t.nodes.where("is_item").select("id", F.lit("new").alias("title"), F.lit("[]").alias("tags"))).select("id", "title", "tags"), "SELECT id, CASE WHEN NOT is_item OR coalesce(human_edited, '') LIKE '%\"title\"%' THEN title ELSE 'new' END AS title, CASE WHEN NOT is_item OR coalesce(human_edited, '') LIKE '%\"tags\"%' THEN tags ELSE '[]' END AS tags FROM nodes")
query("key_06_partial_update", lambda t: R.update(t.edges, t.edges.where("kind = 'related'").select("id", F.lit(0.5).alias("weight"), F.lit(None).cast("string").alias("label")).dropDuplicates(["id"])).select("id", "weight", "label"), "SELECT id, CASE WHEN id IN (SELECT id FROM edges WHERE kind = 'related') THEN 0.5 ELSE weight END AS weight, label FROM edges")
query("key_07_delete_ai_edges", lambda t: t.edges.where(~((c("kind") == "belongs_to") & (F.coalesce("agent_id", F.lit("ai")) != "human"))).select("id"), "SELECT id FROM edges WHERE NOT (kind = 'belongs_to' AND coalesce(agent_id, 'ai') <> 'human')")
query("key_08_best_tag", lambda t: R.upsert_last(t.item_tags, ["item_id"], [F.desc("confidence"), "tag_id"]).select("item_id", "tag_id"), "SELECT item_id, first(tag_id ORDER BY confidence DESC, tag_id) AS tag_id FROM item_tags GROUP BY 1")
query("key_09_paper_sets", lambda t: t.papers.where("doi is not null").select(F.lower("doi").alias("doi")).distinct(), "SELECT DISTINCT lower(doi) AS doi FROM papers WHERE doi IS NOT NULL")
query("key_10_cluster_samples", lambda t: R.upsert_last(t.nodes.where("is_item and cluster_id is not null"), ["cluster_id"], [F.desc("created_at"), "id"]).select("cluster_id", "id"), "SELECT cluster_id, first(id ORDER BY created_at DESC, id) AS id FROM nodes WHERE is_item AND cluster_id IS NOT NULL GROUP BY 1")
query("key_14_disambiguate", lambda t: t.nodes.where("depth = 3").select("id", F.concat("title", F.when(F.row_number().over(Window.partitionBy("parent_id", "title").orderBy("id")) > 1, F.format_string(" (%d)", F.row_number().over(Window.partitionBy("parent_id", "title").orderBy("id")))).otherwise("")).alias("name")), "SELECT id, title || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS name FROM nodes WHERE depth = 3 WINDOW w AS (PARTITION BY parent_id, title ORDER BY id)")
query("mnt_05_child_named_as_parent", lambda t: t.nodes.where("not is_item").select("id", c("parent_id").alias("p"), F.lower(F.coalesce("cluster_label", "ai_title", "title")).alias("name")).join(t.nodes.select(c("id").alias("p"), F.lower(F.coalesce("cluster_label", "ai_title", "title")).alias("pname")), "p").where("name = pname").select("id", c("p").alias("into_id")), "SELECT k.id, p.id AS into_id FROM nodes k JOIN nodes p ON p.id = k.parent_id WHERE NOT k.is_item AND lower(coalesce(k.cluster_label, k.ai_title, k.title)) = lower(coalesce(p.cluster_label, p.ai_title, p.title))")
query("mnt_07_empty_categories", lambda t: R.delete(t.nodes.where("not is_item and not is_universe"), t.nodes.where("parent_id is not null").select(c("parent_id").alias("id")).distinct()).select("id"), "SELECT id FROM nodes n WHERE NOT is_item AND NOT is_universe AND NOT EXISTS (SELECT 1 FROM nodes k WHERE k.parent_id = n.id)")
query("mnt_07_empty_items", lambda t: t.nodes.where(c("is_item") & (F.length(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s", "")) < 10)).select("id"), r"SELECT id FROM nodes WHERE is_item AND length(regexp_replace(coalesce(content, ''), '\s', '', 'g')) < 10")
query("mnt_08_reparent_orphans", lambda t: R.orphan_items(t.nodes).select("id", F.lit("root").alias("parent_id"), F.lit(1).alias("depth")), "SELECT id, 'root' AS parent_id, 1 AS depth FROM nodes n WHERE is_item AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id)")
query("mnt_09_oldest_edges", lambda t: R.oldest_edges(t.edges).select("id", "source_id", "target_id", "kind"), "SELECT first(id ORDER BY created_at, id) AS id, source_id, target_id, kind FROM edges GROUP BY source_id, target_id, kind")
query("mnt_10_scaffolding", lambda t: t.nodes.where(~c("is_item") & ~c("is_universe") & (c("depth") > 1) & c("human_edited").isNull()).select("id"), "SELECT id FROM nodes WHERE NOT is_item AND NOT is_universe AND depth > 1 AND human_edited IS NULL")
query("mnt_14_garbage_duplicates", lambda t: R.garbage_duplicates(t.papers), "WITH p AS (SELECT node_id, title, doi IS NULL AND (length(trim(coalesce(abstract, ''))) < 50 OR regexp_matches(coalesce(abstract, ''), '^[0-9]*$')) AS bad, count(*) OVER (PARTITION BY title) AS n, count(DISTINCT lower(doi)) OVER (PARTITION BY title) AS dois FROM papers), q AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY bad, node_id) AS rn FROM p WHERE n > 1 AND dois <= 1) SELECT node_id, title FROM q WHERE bad AND rn > 1")
query("mnt_15_date_sync", lambda t: t.papers.select("node_id", (F.datediff(F.to_date("publication_date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY).alias("ms"), "created_at").where(F.abs(F.coalesce("ms", F.lit(0)) - c("created_at")) > DAY).select("node_id", F.coalesce("ms", F.lit(0)).alias("ms")), f"SELECT node_id, coalesce(epoch_ms(publication_date::TIMESTAMP), 0) AS ms FROM papers WHERE abs(coalesce(epoch_ms(publication_date::TIMESTAMP), 0) - created_at) > {DAY}")
query("mnt_16_reset", lambda t: t.nodes.where("is_item").select("id", F.lit(None).cast("string").alias("ai_title"), F.lit(False).alias("is_processed")), "SELECT id, NULL::VARCHAR AS ai_title, false AS is_processed FROM nodes WHERE is_item")
