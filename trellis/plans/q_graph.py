"""Queries of trees and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import EDGE_PRIORITY, SEMANTIC_EDGES
from ..operators import graph as G
from ..operators import relational as R
from ..operators import trees as T
from .registry import query

c = F.col
DOWN = "WITH RECURSIVE d(id, root, level) AS (SELECT id, id, 0 FROM nodes WHERE {roots} UNION ALL SELECT n.id, d.root, d.level + 1 FROM d JOIN nodes n ON n.parent_id = d.id)"
UP = "WITH RECURSIVE u(id, ancestor, level) AS (SELECT id, id, 0 FROM nodes WHERE {start} UNION ALL SELECT u.id, p.id, u.level + 1 FROM u JOIN nodes n ON n.id = u.ancestor JOIN nodes p ON p.id = n.parent_id)"

query("rec_01_descendants", lambda t: T.subtree_nodes(t.nodes, "r-1", items_only=True).select("id", "level"), DOWN.format(roots="id = 'r-1'") + " SELECT id, level FROM d JOIN nodes USING (id) WHERE level > 0 AND is_item")
query("rec_02_item_counts", lambda t: T.item_counts(t.nodes), UP.format(start="is_item") + " SELECT n.id, count(u.id) AS n FROM nodes n LEFT JOIN u ON u.ancestor = n.id GROUP BY 1")
query("rec_03_wrong_depths", lambda t: T.wrong_depths(t.nodes), DOWN.format(roots="is_universe") + " SELECT id, n.depth AS stored, level AS depth FROM d JOIN nodes n USING (id) WHERE n.depth <> level")
query("rec_04_shift_depths", lambda t: T.shift_depths(t.nodes, t.nodes.where("id in ('n-2', 'n-3')"), 2), DOWN.format(roots="id IN ('n-2', 'n-3')") + " SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN depth + 2 ELSE depth END AS depth FROM nodes")
query("rec_05_protected", lambda t: T.protected(t.nodes, ["n-1", "c-5"]), DOWN.format(roots="id IN ('n-1', 'c-5')") + " SELECT DISTINCT id FROM d")
query("rec_06_is_ancestor", lambda t: T.is_ancestor(t.nodes, "root", "d-7"), UP.format(start="id = 'd-7'") + " SELECT bool_or(ancestor = 'root' AND level > 0) AS found FROM u")
query("rec_07_paths", lambda t: T.path_names(t.nodes, t.nodes.where("is_item")), UP.format(start="is_item") + " SELECT u.id, string_agg(coalesce(n.cluster_label, n.ai_title, n.title), ' > ' ORDER BY level DESC) AS path FROM u JOIN nodes n ON n.id = u.ancestor GROUP BY 1")
REGION = UP.format(start="true") + ", reg AS (SELECT n.id, coalesce((SELECT first(u.ancestor ORDER BY u.level) FROM u JOIN nodes a ON a.id = u.ancestor WHERE u.id = n.id AND a.depth <= 1), 'unassigned') AS region FROM nodes n)"
query("rec_09_regions", lambda t: T.regions(t.nodes), REGION + " SELECT id, region FROM reg")
query("rec_10_region_edges", lambda t: T.induced(t.edges, T.subtree_nodes(t.nodes, "r-1")).select("id"), DOWN.format(roots="id = 'r-1'") + " SELECT e.id FROM edges e WHERE source_id IN (SELECT id FROM d WHERE level > 0) AND target_id IN (SELECT id FROM d WHERE level > 0)")
query("rec_11_latest_dates", lambda t: T.latest_dates(t.nodes), UP.format(start="id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)") + " SELECT ancestor AS id, max(n.created_at) AS latest FROM u JOIN nodes n USING (id) GROUP BY 1")
query("rec_12_lowest_privacy", lambda t: T.lowest_privacy(t.nodes), UP.format(start="is_item AND privacy IS NOT NULL") + " SELECT ancestor AS id, min(n.privacy) AS privacy FROM u JOIN nodes n USING (id) WHERE level > 0 GROUP BY 1")
query("rec_13_spread_privacy", lambda t: T.spread_privacy(t.nodes, "r-2", 0.4), DOWN.format(roots="id = 'r-2'") + " SELECT id, CASE WHEN privacy IS NULL AND id IN (SELECT id FROM d) THEN 0.4 ELSE privacy END AS privacy FROM nodes")
query("rec_13_force_privacy", lambda t: T.spread_privacy(t.nodes, "r-2", 0.4, force=True), DOWN.format(roots="id = 'r-2'") + " SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN 0.4 ELSE privacy END AS privacy FROM nodes")


def supersession(t):
    """REC-14 on the related edges of each source as versions, from the first edge of all."""
    versions = t.edges.where("kind = 'related'").select("id", F.lead("id", 1).over(Window.partitionBy("source_id").orderBy("id")).alias("superseded_by"))
    return T.supersession(versions, versions.agg(F.min("id")).first()[0])


query("rec_14_supersession", supersession)
query("rec_16_tree_lines", lambda t: T.tree_lines(t.nodes, "root", 2).select("id", "line"), DOWN.format(roots="id = 'root'") + " SELECT id, repeat('  ', level) || title AS line FROM d JOIN nodes USING (id) WHERE level <= 2")

ENDS = "live AS (SELECT * FROM edges e WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)), deg AS (SELECT n.id, (SELECT count(*) FROM live WHERE target_id = n.id) AS incoming, (SELECT count(*) FROM live WHERE source_id = n.id) AS outgoing FROM nodes n)"
#: Labels go along edges while they fall; a row is kept for each node.
COMPONENTS = "l AS (SELECT source_id AS a, target_id AS b FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT s.b, min(cc.comp) FROM cc JOIN s ON s.a = cc.id JOIN recurring.cc AS old ON old.id = s.b WHERE cc.comp < old.comp GROUP BY s.b)"
query("gra_01_components", lambda t: G.components(t.nodes, R.live_edges(t.edges, t.nodes)), f"WITH RECURSIVE {COMPONENTS} SELECT id, comp AS component FROM cc")
query("gra_02_degrees", lambda t: G.degrees(t.nodes, t.edges), f"WITH {ENDS} SELECT id, incoming + outgoing AS degree, incoming, outgoing FROM deg")
query("gra_03_orphans", lambda t: G.degrees(t.nodes, t.edges).where("degree = 0").select("id"), f"WITH {ENDS} SELECT id FROM deg WHERE incoming + outgoing = 0")
query("gra_04_histogram", lambda t: G.degree_histogram(t.nodes, t.edges), f"WITH {ENDS}, k AS (SELECT incoming + outgoing AS d FROM deg) SELECT count_if(d = 0) AS from_0, count_if(d = 1) AS from_1, count_if(d BETWEEN 2 AND 3) AS from_2, count_if(d BETWEEN 4 AND 7) AS from_4, count_if(d BETWEEN 8 AND 15) AS from_8, count_if(d BETWEEN 16 AND 31) AS from_16, count_if(d >= 32) AS from_32 FROM k")
query("gra_05_hubs", lambda t: R.page(G.degrees(t.nodes, t.edges).where("degree > 50"), [F.desc("degree"), "id"], 20), f"WITH {ENDS} SELECT id, incoming + outgoing AS degree, incoming, outgoing FROM deg WHERE incoming + outgoing > 50 ORDER BY degree DESC, id LIMIT 20")
query("gra_06_topology", lambda t: G.topology(t.nodes, t.edges), f"WITH RECURSIVE {COMPONENTS}, z AS (SELECT comp, count(*) AS n FROM cc GROUP BY 1) SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT a FROM s)) AS orphans, (SELECT count(*) FROM l) AS edges, count(*) AS components, max(n) AS largest, min(n) AS smallest FROM z")
AS_OF = 960_000_000_000
query("gra_07_stale_nodes", lambda t: G.stale_nodes(t.nodes, t.edges, AS_OF, 60), f"SELECT n.id, floor(({AS_OF} - n.updated_at) / 86400000)::BIGINT AS age_days, count(*) AS recent FROM nodes n JOIN edges e ON e.target_id = n.id WHERE n.updated_at < {AS_OF - 60 * 86400000} AND e.created_at > {AS_OF - 7 * 86400000} AND e.created_at <= {AS_OF} AND e.source_id <> e.target_id GROUP BY 1, 2")
query("gra_08_stale_summaries", lambda t: G.stale_summaries(t.nodes, t.edges), "SELECT e.id AS edge, floor((g.updated_at - s.updated_at) / 86400000)::BIGINT AS drift_days FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes g ON g.id = e.target_id WHERE e.kind = 'summarizes' AND g.updated_at > s.updated_at")
query("gra_09_freshness", lambda t: G.freshness(t.nodes, t.edges, "d-7"), "SELECT e.id AS edge, CASE WHEN e.source_id = 'd-7' THEN 'summary' ELSE 'target' END AS side, s.updated_at >= g.updated_at AS fresh FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes g ON g.id = e.target_id WHERE e.kind = 'summarizes' AND 'd-7' IN (e.source_id, e.target_id)")
query("gra_10_bridges", lambda t: G.cut_points(t.nodes, t.edges)[1])
query("gra_10_articulation_points", lambda t: G.cut_points(t.nodes, t.edges)[0])
query("gra_11_fragile_regions", lambda t: G.fragile_regions(t.nodes, t.edges.where("kind = 'supersedes'"), 100_000), REGION + " SELECT least(a.region, b.region) AS a, greatest(a.region, b.region) AS b, count(*) AS n FROM edges e JOIN reg a ON a.id = e.source_id JOIN reg b ON b.id = e.target_id WHERE e.kind = 'supersedes' AND a.region <> b.region AND a.region <> 'unassigned' AND b.region <> 'unassigned' GROUP BY 1, 2 HAVING count(*) <= 100000")
PRIO = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in EDGE_PRIORITY.items()) + " ELSE 0.3 END"
COST = f"CASE WHEN kind IN ('defined_in', 'belongs_to', 'sibling') THEN greatest((1 - coalesce(confidence, 0.5)) * (1 - 0.5 * {PRIO}), 0.4) ELSE greatest((1 - coalesce(confidence, 0.5)) * (1 - 0.5 * {PRIO}), 0.001) END"
query("gra_13_context", lambda t: G.expand_context(t.nodes, t.edges, ["d-7"], budget=15, max_hops=2, max_cost=0.5, deny=["clicked", "session_item"]).select("rank", "id", "distance", "relevance"), f"WITH st AS (SELECT a, b, min(cost) AS cost FROM (SELECT source_id AS a, target_id AS b, {COST} AS cost FROM edges WHERE kind NOT IN ('clicked', 'session_item') UNION ALL SELECT target_id, source_id, {COST} FROM edges WHERE kind NOT IN ('clicked', 'session_item')) WHERE a <> b GROUP BY 1, 2), two AS (SELECT b AS id, cost AS d FROM st WHERE a = 'd-7' UNION ALL SELECT y.b, x.cost + y.cost FROM st x JOIN st y ON y.a = x.b WHERE x.a = 'd-7' AND x.cost <= 0.5), f AS (SELECT id, min(d) AS d FROM two WHERE d <= 0.5 AND id <> 'd-7' AND id IN (SELECT id FROM nodes) GROUP BY 1) SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS relevance FROM f ORDER BY d, id LIMIT 15")
query("gra_14_relevant_edges", lambda t: G.relevant_edges(t.edges, "d-7", 12), f"WITH x AS (SELECT *, min(created_at) OVER () AS t0, max(created_at) OVER () AS t1 FROM edges WHERE 'd-7' IN (source_id, target_id)) SELECT id, round(0.3 * CASE WHEN t1 > t0 THEN (created_at - t0) / (t1 - t0) ELSE 1.0 END + 0.3 * coalesce(confidence, 0.5) + 0.4 * {PRIO}, 6) AS score FROM x ORDER BY score DESC, id LIMIT 12")
query("gra_15_simple_paths", lambda t: G.simple_paths(t.edges, "d-7", "d-9", 2), "WITH s AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges) SELECT 1 AS hops, a || '>' || b AS path FROM s WHERE a = 'd-7' AND b = 'd-9' UNION ALL SELECT 2, x.a || '>' || x.b || '>' || y.b FROM s x JOIN s y ON y.a = x.b WHERE x.a = 'd-7' AND y.b = 'd-9' AND x.b NOT IN ('d-7', 'd-9') ORDER BY hops, path LIMIT 20")
query("gra_16_reach", lambda t: G.reach(t.edges, "d-7", 2), "WITH s AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), r AS (SELECT 'd-7' AS id, 0 AS hops UNION ALL SELECT b, 1 FROM s WHERE a = 'd-7' UNION ALL SELECT y.b, 2 FROM s x JOIN s y ON y.a = x.b WHERE x.a = 'd-7') SELECT id, min(hops) AS hops FROM r GROUP BY 1")


def sibling_communities(t):
    """GRA-17 on all edges between items of one category, weighed by the best of parallel ones."""
    inside = G.edge_parents(t.edges, t.nodes).where("source_parent_id = target_parent_id and source_id != target_id and weight is not null")
    best = inside.groupBy(c("source_parent_id").alias("g"), F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.max("weight").cast("double").alias("weight"))
    return G.communities(best, "g")


query("gra_17_communities", sibling_communities)
query("gra_18_multi_anchor", lambda t: G.best_context(G.expand_context(t.nodes, t.edges, ["d-7", "d-9"], budget=7, max_hops=2, max_cost=0.5)).select("id", "relevance"))
CROSS = f"""WITH x AS (SELECT least(s.parent_id, g.parent_id) AS a, greatest(s.parent_id, g.parent_id) AS b FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes g ON g.id = e.target_id JOIN nodes ca ON ca.id = s.parent_id JOIN nodes cb ON cb.id = g.parent_id
  WHERE e.kind IN {SEMANTIC_EDGES} AND s.parent_id <> g.parent_id AND ca.parent_id = cb.parent_id AND NOT ca.is_item AND NOT cb.is_item), z AS (SELECT parent_id, count(*) AS size FROM nodes WHERE is_item GROUP BY 1)"""
query("gra_20_sibling_weights", lambda t: G.sibling_weights(R.sibling_cross_counts(t.edges, t.nodes)).select("a", "b", "weight"), CROSS + " SELECT a, b, round(least(1.0, count(*) / greatest(1, least(coalesce(any_value(za.size), 0), coalesce(any_value(zb.size), 0)))), 6) AS weight FROM x LEFT JOIN z za ON za.parent_id = a LEFT JOIN z zb ON zb.parent_id = b GROUP BY a, b")
query("gra_21_edge_parents", lambda t: G.edge_parents(t.edges, t.nodes).select("id", "source_parent_id", "target_parent_id"), "SELECT e.id, s.parent_id AS source_parent_id, g.parent_id AS target_parent_id FROM edges e LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes g ON g.id = e.target_id")
query("flt_10_view_edges", lambda t: G.edge_parents(t.edges, t.nodes).where("source_parent_id = 'c-5' and target_parent_id = 'c-8'").select("id"), "SELECT e.id FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes g ON g.id = e.target_id WHERE s.parent_id = 'c-5' AND g.parent_id = 'c-8'")
query("gra_23_induced", lambda t: T.induced(t.edges, t.nodes.where("is_pinned")).select("id", "source_id", "target_id"), "SELECT id, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE is_pinned) AND target_id IN (SELECT id FROM nodes WHERE is_pinned)")
