"""Queries of naming, tidying, tree helpers and the remaining keyed operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import abstracts as A
from ..functions import classify as K
from ..functions import text as X
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import maintenance as M
from ..operators import naming as N
from ..operators import relational as R
from ..operators import trees as T
from ..operators import vectors as V
from .q_relational import CROSS
from .q_vectors import E, SEM, semantic, vectors, weighted, weighted_and_config
from .registry import query
from .views import AS_OF

c = F.col
LABEL = "coalesce(cluster_label, ai_title, title)"

query("jn_09_topic_cross_edges", lambda t: R.cross_edge_counts(t.edges, t.nodes).where("a in ('c-5', 'c-8', 'c-13') or b in ('c-5', 'c-8', 'c-13')"), CROSS + " SELECT parent, a, b, count(*) AS n FROM x WHERE a IN ('c-5', 'c-8', 'c-13') OR b IN ('c-5', 'c-8', 'c-13') GROUP BY ALL")


def explain(t):
    """JN-16: an edge's neighbourhood, at most ten edges on either side."""
    e = t.edges
    first = e.where("kind = 'supports'").orderBy("id").limit(1).select("id", "source_id", "target_id")
    ends = first.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), c("source_id").alias("node")), F.struct(F.lit("target").alias("side"), c("target_id").alias("node")))).alias("x"), c("id").alias("edge")).select("x.*", "edge")
    near = e.select("id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"), "created_at").join(F.broadcast(ends), "node").where("id != edge")
    rn = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("created_at"), "id"))
    return near.withColumn("rn", rn).where("rn <= 10").select("edge", "side", "id")


query("jn_16_explain_edge", explain, "WITH f AS (SELECT id AS edge, source_id, target_id FROM edges WHERE kind = 'supports' ORDER BY id LIMIT 1), x AS (SELECT edge, 'source' AS side, e.id, e.created_at FROM f JOIN edges e ON source_id_f(e, f) UNION ALL SELECT edge, 'target', e.id, e.created_at FROM f JOIN edges e ON f.target_id IN (e.source_id, e.target_id) AND e.id <> edge) SELECT edge, side, id FROM x QUALIFY row_number() OVER (PARTITION BY side ORDER BY created_at DESC, id) <= 10".replace("source_id_f(e, f)", "f.source_id IN (e.source_id, e.target_id) AND e.id <> edge"))


def coherence(t):
    """AGG-19: mean similarity of vectors to their group's centroid."""
    v = vectors(t).select("id", "embedding", "label")
    near = v.join(F.broadcast(V.centroids(v, "label")), "label").select("label", V.cosine(c("embedding"), c("centroid")).alias("s"))
    return near.groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.min("s"), 6).alias("low"), F.count("*").alias("n"))


query("agg_19_coherence", coherence, f"WITH {E}, m AS (SELECT label, list(x ORDER BY k) AS cen FROM (SELECT label, k, avg(e[k + 1]) AS x FROM v, range(64) r(k) GROUP BY 1, 2) GROUP BY 1) SELECT label, round(avg(list_cosine_similarity(e, cen)), 6) AS mean, round(min(list_cosine_similarity(e, cen)), 6) AS low, count(*) AS n FROM v JOIN m USING (label) GROUP BY 1")
query("win_01_rank", lambda t: semantic(t).select("id", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")).alias("rank")), f"WITH {SEM.format(t=0.3, k=10)} SELECT 'semantic-' || a || '-' || b AS id, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM sem")
query("win_02_top_per_node", lambda t: R.item_edges(t.edges, t.nodes).withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "id"))).where("rn <= 3").select("source_id", "id"), "SELECT source_id, id FROM (SELECT e.*, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, id) AS rn FROM edges e WHERE weight IS NOT NULL AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.source_id AND n.is_item AND coalesce(n.source, '') <> 'signal') AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.target_id AND n.is_item AND coalesce(n.source, '') <> 'signal')) WHERE rn <= 3")
query("win_06_ordinals", lambda t: t.visits.select("session_id", "url", (F.row_number().over(Window.partitionBy("session_id").orderBy("seen_at", "url")) - 1).alias("ordinal")), "SELECT session_id, url, row_number() OVER (PARTITION BY session_id ORDER BY seen_at, url) - 1 AS ordinal FROM visits")


def ordered_topics(t):
    """SRT-02 on the centroids of the labels, a bounded set."""
    rows = V.centroids(vectors(t), "label").orderBy("label").collect()
    order = N.greedy_order([str(r.label) for r in rows], {str(r.label): np.array(r.centroid) for r in rows})
    return t.spark.createDataFrame(list(enumerate(order)), "position int, label string")


query("srt_02_greedy_order", ordered_topics)


def clusters(t):
    """VEC-09 on the centroids of the labels."""
    rows = V.centroids(vectors(t), "label").orderBy("label").collect()
    found = N.tight_clusters([str(r.label) for r in rows], np.array([r.centroid for r in rows]), 2, 0.05)
    return t.spark.createDataFrame([(k, x) for k, g in enumerate(found) for x in g], "cluster int, label string")


query("vec_09_tight_clusters", clusters)
query("rec_15_descendant_counts", lambda t: T.ancestors(t.nodes).where("level > 0").groupBy(c("ancestor").alias("id")).agg(F.count("*").alias("n")), "WITH RECURSIVE u(id, ancestor, level) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT u.id, p.id, u.level + 1 FROM u JOIN nodes n ON n.id = u.ancestor JOIN nodes p ON p.id = n.parent_id) SELECT ancestor AS id, count(*) AS n FROM u WHERE level > 0 GROUP BY 1")
query("rec_08_skip_chains", lambda t: H.flatten_single_chains(t.nodes.where("depth <= 3")).where("parent_id = 'root'").select("id"))


def health(t):
    """GRA-12 from the counts of the parts."""
    n = t.nodes.count()
    top = G.topology(t.nodes, t.edges).first()
    stale = G.stale_nodes(t.nodes, t.edges, AS_OF, 60).count()
    fragile = G.fragile_regions(t.nodes, t.edges).count()
    return t.spark.createDataFrame([(n, top.orphans, top.components, stale, fragile, round(G.health(n, top.orphans, top.components, stale, fragile), 6))], "nodes long, orphans long, components long, stale long, fragile long, health double")


query("gra_12_health", health)
query("gra_19_trail", lambda t: G.reach(R.live_edges(t.edges, t.nodes.where("node_class in ('operational', 'meta')")), "d-7", 2), "WITH k AS (SELECT id FROM nodes WHERE node_class IN ('operational', 'meta')), s AS (SELECT source_id AS a, target_id AS b FROM edges WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)), s2 AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT 'd-7' AS id, 0 AS hops UNION ALL SELECT b, 1 FROM s2 WHERE a = 'd-7' UNION ALL SELECT y.b, 2 FROM s2 x JOIN s2 y ON y.a = x.b WHERE x.a = 'd-7') SELECT id, min(hops) AS hops FROM r GROUP BY 1")
query("gra_22_connect", lambda t: X.resolve(t.nodes, "d-7").select(F.lit("new").alias("source_id"), c("id").alias("target_id"), F.lit("related").alias("kind")), "SELECT 'new' AS source_id, id AS target_id, 'related' AS kind FROM nodes WHERE id = 'd-7'")
query("vec_15_lessons", lambda t: R.page(t.nodes.where("node_class = 'meta'"), [F.desc("created_at"), "id"], 20).select("id", "created_at"), "SELECT id, created_at FROM nodes WHERE node_class = 'meta' ORDER BY created_at DESC, id LIMIT 20")

# ---- thresholds and splits
query("tre_02_natural_thresholds", lambda t: R.weight_gaps(semantic(t), 2), f"WITH {SEM.format(t=0.3, k=10)}, w AS (SELECT DISTINCT similarity AS weight FROM sem), g AS (SELECT weight, round(lag(weight) OVER (ORDER BY weight DESC) - weight, 6) AS gap FROM w) SELECT gap, round(weight + gap / 2, 6) AS threshold FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, weight DESC LIMIT 2")
query("tre_03_percentile_thresholds", lambda t: t.spark.createDataFrame([(x,) for x in H.percentile_thresholds(semantic(t), [25, 50, 75])], "threshold double"), f"WITH {SEM.format(t=0.3, k=10)}, z AS (SELECT list_sort(list(similarity)) AS w FROM sem) SELECT DISTINCT w[len(w) * p // 100 + 1] AS threshold FROM z, (VALUES (25), (50), (75)) x(p)")
query("tre_04_fixed_thresholds", lambda t: H.fixed_thresholds(t.edges, [0.5, 0.92, 0.96, 0.92]), "SELECT x.t::DOUBLE AS threshold, (SELECT count(*) FROM edges WHERE weight >= x.t) AS kept FROM (VALUES (0.96), (0.92), (0.5)) x(t)")
query("tre_09_config", lambda t: t.spark.createDataFrame([H.config_of(vectors(t), semantic(t))]).select("min_size", "max_depth", F.round("iqr", 6).alias("iqr")), f"WITH {SEM.format(t=0.3, k=10)}, z AS (SELECT list_sort(list(similarity)) AS w FROM sem) SELECT least(greatest(ceil(sqrt((SELECT count(*) FROM v)) / 15), 3), 7)::BIGINT AS min_size, 7::BIGINT AS max_depth, round(w[len(w) * 75 // 100 + 1] - w[len(w) * 25 // 100 + 1], 6) AS iqr FROM z")
query("tre_10_inner_weights", lambda t: weighted(t).join(vectors(t).select(c("id").alias("a"), c("label").alias("la")), "a").join(vectors(t).select(c("id").alias("b"), c("label").alias("lb")), "b").groupBy((c("la") == c("lb")).alias("inside")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean")), f"WITH {SEM.format(t=0.3, k=10)} SELECT x.label = y.label AS inside, count(*) AS n, round(avg(similarity), 6) AS mean FROM sem JOIN v x ON x.id = a JOIN v y ON y.id = b GROUP BY 1")
query("tre_11_ratios", lambda t: t.nation.select("n_nationkey", H.ratio_of(c("n_nationkey") * 30).alias("ratio")), "SELECT n_nationkey, CASE WHEN n_nationkey * 30 > 500 THEN 0.01 WHEN n_nationkey * 30 > 200 THEN 0.03 WHEN n_nationkey * 30 > 50 THEN 0.08 ELSE 0.15 END::DOUBLE AS ratio FROM nation")


def rebuilt(t):
    """TRE-15: similarity edges, configuration, adaptive tree, one parent each, orphans rescued; sizes of the categories."""
    e, config = weighted_and_config(t)
    v = vectors(t).select("id")
    tree = cut(H.adaptive_tree(v, e, config))
    home = H.parents_from_tree(tree.where("depth > 0"))
    orphans = v.join(home.select("id"), "id", "left_anti")
    rescued = H.rescue_orphans(orphans, home.select("id", c("parent_id").alias("category")), e)
    all_ = home.unionByName(rescued.select("id", c("category").alias("parent_id")))
    return all_.groupBy("parent_id").agg(F.count("*").alias("n"))


query("tre_15_rebuild", rebuilt)
query("tre_17_levels", lambda t: H.cut_at(vectors(t).select("id"), H.merges(weighted(t)), 0.4).groupBy("component").agg(F.count("*").alias("n")).where("n > 1"))

# ---- tidying
PAIR = f"WITH k AS (SELECT id, parent_id, {LABEL} AS name FROM nodes WHERE NOT is_item AND parent_id IS NOT NULL), two AS (SELECT parent_id, min(id) AS a, max(id) AS b FROM k GROUP BY 1 HAVING count(*) = 2)"
query("mnt_02_similar_sibling_names", lambda t: M.similar_sibling_names(t.nodes, 0.3), PAIR + ", w AS (SELECT a, b, list_distinct(regexp_split_to_array(lower(x.name), '\\s+')) AS wa, list_distinct(regexp_split_to_array(lower(y.name), '\\s+')) AS wb FROM two JOIN k x ON x.id = a JOIN k y ON y.id = b) SELECT a, b FROM w WHERE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) >= 0.3")
query("mnt_03_collapse_binary", lambda t: M.collapse_binary(t.nodes.where("depth < 4")).groupBy("parent_id").agg(F.count("*").alias("n")))
query("mnt_04_flatten_uncategorised", lambda t: M.flatten_uncategorised(t.nodes.withColumn("title", F.when(c("id") == "n-3", "Uncategorized").otherwise(c("title"))).withColumn("cluster_label", F.when(c("id") == "n-3", F.lit(None)).otherwise(c("cluster_label")))), "SELECT id, CASE WHEN parent_id = 'n-3' THEN (SELECT parent_id FROM nodes WHERE id = 'n-3') ELSE parent_id END AS parent_id FROM nodes WHERE id <> 'n-3'")
query("mnt_13_tidy_nodes", lambda t: M.tidy(t.nodes, t.edges)[0].select("id", "parent_id", "depth", "child_count"))
query("mnt_13_tidy_edges", lambda t: M.tidy(t.nodes, t.edges)[1].select("id"))
query("mnt_17_move", lambda t: R.update(t.nodes.select("id", "parent_id", "is_pinned"), t.nodes.where("id = 'd-7'").select("id", F.lit("c-9").alias("parent_id"), F.lit(True).alias("is_pinned"))), "SELECT id, CASE WHEN id = 'd-7' THEN 'c-9' ELSE parent_id END AS parent_id, CASE WHEN id = 'd-7' THEN true ELSE is_pinned END AS is_pinned FROM nodes")
query("mnt_12_merge_small", lambda t: M.merge_similar_siblings(t.nodes.where("depth < 4"), 0.3).groupBy("parent_id").agg(F.count("*").alias("n")))

# ---- texts
query("txt_03_fenced_bytes", lambda t: t.documents.select("doc_id", K.fenced_bytes(F.concat(F.lit("a\n```\n"), "text", F.lit("\n```\nb"))).alias("n")), "SELECT doc_id, strlen(text) + 1 AS n FROM documents")
query("txt_04_occurrences", lambda t: t.documents.select("doc_id", K.times(c("text"), ".").cast("long").alias("dots"), K.times(F.lower("text"), "the").cast("long").alias("the")), "SELECT doc_id, ((strlen(text) - strlen(replace(text, '.', ''))))::BIGINT AS dots, ((strlen(lower(text)) - strlen(replace(lower(text), 'the', ''))) // 3)::BIGINT AS the FROM documents")
query("txt_15_abstracts", lambda t: A.format_abstracts(t.papers, "node_id", "concat('Background: ', abstract, ' Methods: ', title, ' Results: none')").select("id", F.array_join("sections", ",").alias("sections")), "SELECT node_id AS id, 'Background,Methods,Results' AS sections FROM papers")
query("txt_23_doc_references", lambda t: t.nodes.where("is_item").select("id", F.concat(F.lit("see `run_it` and parse_all() and "), "title", F.lit(" in TokenStream")).alias("text")).select("id", F.array_join(F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][A-Za-z0-9_]*)`"), 1), F.regexp_extract_all("text", F.lit(r"\b([a-z]+(?:_[a-z0-9]+)+)\(\)"), 1), F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), 1)))), ",").alias("names")), "SELECT id, 'TokenStream,parse_all,run_it' AS names FROM nodes WHERE is_item")
EMOJI = {"doc": "D", "nation": "N", "topic": "T"}
query("txt_25_emoji", lambda t: t.nodes.select("id", F.element_at(F.create_map(*(F.lit(x) for kv in EMOJI.items() for x in kv)), F.regexp_extract(F.lower("title"), r"^([a-z]+)", 1)).alias("emoji")), "SELECT id, CASE regexp_extract(lower(title), '^([a-z]+)', 1) WHEN 'doc' THEN 'D' WHEN 'nation' THEN 'N' WHEN 'topic' THEN 'T' END AS emoji FROM nodes")
query("txt_28_stable_ids", lambda t: t.nodes.where("is_item").select("id", F.substring(F.sha2(F.concat_ws("|", "title", "kind", "content_type"), 256), 1, 16).alias("code_id")), "SELECT id, substr(sha256(concat_ws('|', title, kind, content_type)), 1, 16) AS code_id FROM nodes WHERE is_item")
query("ing_05_paper_nodes", lambda t: t.papers.select(c("node_id").alias("id"), "title", X.content_hash(c("title"), c("abstract")).alias("hash"), F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), F.lit("[Abstract not available]")).alias("abstract")).select("id", "title", "hash", F.md5("abstract").alias("a")), "SELECT node_id AS id, title, substr(sha256(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) || '|' || coalesce(trim(regexp_replace(lower(abstract), '\\s+', ' ', 'g')), '')), 1, 32) AS hash, md5(coalesce(nullif(trim(abstract), ''), '[Abstract not available]')) AS a FROM papers")
query("ing_09_authors", lambda t: t.messages.select("id", F.coalesce(F.element_at(F.str_to_map(F.lit("1=Ann,2=Bob"), F.lit(","), F.lit("=")), c("author")), c("author")).alias("author")), "SELECT id, CASE author WHEN '1' THEN 'Ann' WHEN '2' THEN 'Bob' ELSE author END AS author FROM messages")

# ---- keyed operations
query("key_11_learned_emoji", lambda t: R.upsert_last(t.nodes.where("is_item").select(F.lower(F.regexp_extract("title", r"^(\w+)", 1)).alias("keyword"), c("id").alias("emoji"), "created_at"), ["keyword"], [F.desc("created_at"), "emoji"]).select("keyword", "emoji"), "SELECT lower(regexp_extract(title, '^(\\w+)', 1)) AS keyword, first(id ORDER BY created_at DESC, id) AS emoji FROM nodes WHERE is_item GROUP BY 1")
query("key_12_level_marks", lambda t: t.nodes.where("not is_item").select("id", F.when(c("depth") == 0, "universe").when(c("depth") == 1, "galaxy").otherwise("topic").alias("mark")), "SELECT id, CASE depth WHEN 0 THEN 'universe' WHEN 1 THEN 'galaxy' ELSE 'topic' END AS mark FROM nodes WHERE NOT is_item")
CH = f"WITH k AS (SELECT parent_id, {LABEL} AS name FROM nodes WHERE depth = 3), w AS (SELECT parent_id, unnest(regexp_split_to_array(trim(lower(name)), '\\s+')) AS word FROM k), n AS (SELECT parent_id, word, count(*) AS n FROM w WHERE strlen(word) > 3 AND word NOT IN {N.THEME_STOP} GROUP BY 1, 2), z AS (SELECT parent_id, count(*) AS total, min(name) AS first FROM k GROUP BY 1), b AS (SELECT parent_id, first(word ORDER BY n DESC, word) AS w FROM n JOIN z USING (parent_id) WHERE n >= ceil(total * 0.4) AND total >= 2 GROUP BY 1)"
query("key_13_fallback_names", lambda t: N.fallback_names(t.nodes.where("depth = 3").select("parent_id", F.coalesce("cluster_label", "ai_title", "title").alias("name"))), CH + " SELECT z.parent_id, coalesce(upper(w[1]) || w[2:] || ' Discussions', CASE WHEN strlen(first) > 25 THEN substr(first, 1, 22) || '...' ELSE first END || ' and Related') AS name FROM z LEFT JOIN b USING (parent_id)")
query("key_15_grouping_reply", lambda t: t.spark.createDataFrame([(g, x) for g, xs in N.parse_groups({"Other": ["a", "b"], "Music": ["c"], "music theory": ["d", "zz"]}, list("abcde")).items() for x in xs], "name string, topic string"), "SELECT * FROM (VALUES ('a and Related', 'a'), ('a and Related', 'b'), ('Music', 'c'), ('Music', 'd'), ('e and Related', 'e')) x(name, topic)")
query("key_16_hidden_titles", lambda t: t.nodes.where("content_type in ('debug', 'code', 'paste')").select("id", N.hidden_title(c("content_type"), c("content")).alias("title")), "WITH l AS (SELECT id, content_type, coalesce(list_filter(string_split(content, chr(10)), lambda x: strlen(trim(x)) > 3 AND NOT regexp_matches(trim(x), '^(```|#|//)'))[1], 'Untitled') AS line FROM nodes WHERE content_type IN ('debug', 'code', 'paste')) SELECT id, CASE content_type WHEN 'debug' THEN 'Debug:' WHEN 'code' THEN 'Code:' ELSE 'Paste:' END || ' ' || CASE WHEN strlen(line) > 60 THEN substr(line, 1, 57) || '...' ELSE line END AS title FROM l")
query("key_17_files_touched", lambda t: R.folder_view(t.nodes, "src/").orderBy(F.desc("n"), "file_path").limit(8).select("file_path", "n"), "SELECT json_extract_string(tags, '$.file_path') AS file_path, count(*) AS n FROM nodes WHERE tags LIKE '{\"file_path\":\"src/%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
query("key_18_file_nodes", lambda t: R.code_files(t.nodes).select(F.concat(F.lit("file-"), F.substring(F.sha2("file_path", 256), 1, 12)).alias("id"), c("file_path").alias("title"), c("n").alias("child_count")), "SELECT 'file-' || substr(sha256(p), 1, 12) AS id, p AS title, count(*) AS child_count FROM (SELECT json_extract_string(tags, '$.file_path') AS p FROM nodes WHERE tags LIKE '{%') GROUP BY p")
query("key_19_missing_sessions", lambda t: t.visits.select(c("session_id").alias("id")).distinct().join(t.nodes.select("id"), "id", "left_anti"), "SELECT DISTINCT session_id AS id FROM visits WHERE session_id NOT IN (SELECT id FROM nodes)")
query("key_21_embedded_nodes", lambda t: t.nodes.where("has_embedding").select("id"), "SELECT id FROM nodes WHERE has_embedding")
query("key_23_unknown_words", lambda t: X.title_words(t.nodes).join(t.nation.select(F.lower(F.regexp_extract("n_name", r"^([A-Z]+)", 1)).alias("word")).distinct(), "word", "left_anti"), None)
