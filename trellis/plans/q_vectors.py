"""Queries of vectors and of the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators import hierarchy as H
from ..operators import relational as R
from ..operators import vectors as V
from .registry import query

c = F.col
E = "v AS (SELECT 'v-' || vec_id AS id, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
PAIRS = f"{E}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id < b.id)"
SEM = PAIRS + ", s AS (SELECT * FROM p WHERE similarity >= {t}), n AS (SELECT a AS node, b AS other, a, b, similarity FROM s UNION ALL SELECT b, a, a, b, similarity FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(similarity + CASE WHEN pa = pb THEN 0.2 ELSE 0 END, 6) DESC, other) AS rn FROM (SELECT n.*, x.vec_id % 7 AS pa, y.vec_id % 7 AS pb FROM n JOIN v x ON x.id = n.a JOIN v y ON y.id = n.b)), sem AS (SELECT DISTINCT a, b, similarity FROM r WHERE rn <= {k})"


def vectors(t):
    return t.embeddings.select(F.concat(F.lit("v-"), c("vec_id").cast("string")).alias("id"), "embedding", "label", "vec_id")


def vector_nodes(t):
    return vectors(t).select("id", "embedding", F.lit(True).alias("is_item"), F.concat(F.lit("p-"), (c("vec_id") % 7).cast("string")).alias("parent_id"))


def semantic(t, threshold=0.3, k=10):
    return V.semantic_edges(vector_nodes(t), threshold, k)


def weighted(t):
    return semantic(t).select(c("source_id").alias("a"), c("target_id").alias("b"), "weight")


def weighted_and_config(t):
    """The similarity edges, searched once, and their tree's configuration."""
    e = cut(weighted(t))
    return e, H.config_of(vectors(t), e)


FIRST = "(SELECT e FROM v WHERE id = 'v-0')"


def nearest_to_first(t):
    """The query vector is one row, sent back as a literal."""
    q = t.embeddings.where("vec_id = 0").select("embedding").first().embedding
    return V.nearest(vectors(t), [float(x) for x in q], 10, exclude="v-0", least=0.1)


def recall(t):
    """Recall of the approximate index: every 50th row asks, all rows are filed."""
    v = vectors(t).select("id", "embedding", "vec_id")
    q = v.where("vec_id % 50 = 0").select("id", "embedding")
    exact = V.nearest_of_many(v.select("id", "embedding"), q, 10)
    found = V.CellIndex(v.select("id", "embedding"), 16).search(q, 10, 14)
    hit = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))


query("vec_01_cosine", lambda t: vectors(t).crossJoin(F.broadcast(t.embeddings.where("vec_id = 0").select(c("embedding").alias("q")))).select("id", F.round(V.cosine(c("embedding"), c("q")), 6).alias("similarity")), f"WITH {E} SELECT id, round(list_cosine_similarity(e, {FIRST}), 6) AS similarity FROM v")
query("vec_02_centroids", lambda t: V.centroids(vectors(t), "label").select("label", F.posexplode("centroid").alias("k", "x")).select("label", "k", F.round("x", 6).alias("x")), f"WITH {E}, m AS (SELECT label, k, avg(e[k + 1]) AS x FROM v, range(64) r(k) GROUP BY 1, 2) SELECT label, k::INT AS k, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
query("vec_03_nearest", nearest_to_first, f"WITH {E} SELECT id, round(list_cosine_similarity(e, {FIRST}), 6) AS similarity FROM v WHERE id <> 'v-0' AND round(list_cosine_similarity(e, {FIRST}), 6) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 10")
query("vec_03_nearest_of_many", lambda t: V.nearest_of_many(vectors(t), vectors(t).where("vec_id % 50 = 0"), 5), f"WITH {E}, p AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON v.id <> q.id WHERE q.vec_id % 50 = 0) SELECT query, id, similarity, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY query ORDER BY similarity DESC, id) QUALIFY rank <= 5")
query("vec_04_recall", recall)
query("vec_05_similar_pairs", lambda t: V.similar_pairs(vectors(t), 0.3), f"WITH {PAIRS} SELECT a, b, similarity FROM p WHERE similarity >= 0.3")
query("vec_05_semantic_edges", lambda t: semantic(t).select("id", "weight"), f"WITH {SEM.format(t=0.3, k=10)} SELECT 'semantic-' || a || '-' || b AS id, similarity AS weight FROM sem")
query("vec_05_semantic_edges_top3", lambda t: semantic(t, 0.3, 3).select("id", "weight"), f"WITH {SEM.format(t=0.3, k=3)} SELECT 'semantic-' || a || '-' || b AS id, similarity AS weight FROM sem")
query("vec_06_count_semantic", lambda t: semantic(t).where(c("id").startswith("semantic-")).agg(F.count("*").alias("n")), f"WITH {SEM.format(t=0.3, k=10)} SELECT count(*) AS n FROM sem")
query("vec_07_mergeable_siblings", lambda t: V.mergeable_siblings(vector_nodes(t), 0.3), f"WITH {PAIRS} SELECT 'p-' || (x.vec_id % 7) AS parent_id, a, b, similarity FROM p JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE similarity >= 0.3 AND x.vec_id % 7 = y.vec_id % 7")
query("vec_08_single_linkage", lambda t: V.single_linkage(vectors(t).select("id", "embedding"), 0.35), f"WITH RECURSIVE {PAIRS}, s AS (SELECT a, b FROM p WHERE similarity >= 0.35 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.35), r(id, seen) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.seen) SELECT id, min(seen) AS cluster FROM r GROUP BY 1")
query("vec_10_adopt", lambda t: V.adopt(vector_nodes(t).where("parent_id = 'p-0'"), vector_nodes(t).where("parent_id != 'p-0'")), f"WITH {E}, x AS (SELECT o.id, h.id AS home, h.vec_id % 7 AS k, round(list_cosine_similarity(o.e, h.e), 6) AS similarity FROM v o JOIN v h ON o.vec_id % 7 = 0 AND h.vec_id % 7 <> 0) SELECT id, 'p-' || first(k ORDER BY similarity DESC, home DESC) AS parent_id, max(similarity) AS similarity FROM x WHERE similarity > 0.3 GROUP BY id")
query("vec_12_embedding_sizes", lambda t: t.embeddings.select("vec_id", F.size("embedding").alias("n")), "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
query("agg_18_semantic_weights", lambda t: R.weight_statistics(semantic(t)).select("n", "low", "high", "p50"), f"WITH {SEM.format(t=0.3, k=10)} SELECT count(*) AS n, min(similarity) AS low, max(similarity) AS high, list_sort(list(similarity))[floor(count(*) / 2)::BIGINT + 1] AS p50 FROM sem")
query("tre_01_merges", lambda t: H.merges(weighted(t)).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total")))
query("tre_05_dynamic_thresholds", lambda t: H.dynamic_thresholds(t.embeddings.count(), H.merges(weighted(t)).withColumn("weight", c("weight") * 2)))
query("tre_07_cut", lambda t: H.cut_at(vectors(t).select("id"), H.merges(weighted(t)), 0.35), f"WITH RECURSIVE {PAIRS}, s AS (SELECT a, b FROM p WHERE similarity >= 0.35 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.35), r(id, seen) AS (SELECT id, id FROM v UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY 1")
query("tre_14_adaptive_tree", lambda t: H.adaptive_tree(vectors(t).select("id"), *weighted_and_config(t)).groupBy("category", "parent", "depth").agg(F.count("*").alias("n")))
query("tre_16_classic", lambda t: H.classic_hierarchy(t.nodes), "SELECT CASE WHEN privacy < 0.3 THEN 'personal' WHEN cluster_id IS NULL OR cluster_id < 0 THEN 'uncategorized' ELSE 'topic-' || cluster_id END AS topic, 'root' AS parent, count(*) AS n FROM nodes WHERE is_item GROUP BY 1")
query("mnt_06_flatten_chains", lambda t: H.flatten_single_chains(t.nodes.where("depth < 4 or id = 'd-30'")))
query("mnt_18_dissolve", lambda t: H.dissolve(t.nodes, "n-2"), "SELECT id, CASE WHEN parent_id = 'n-2' THEN (SELECT parent_id FROM nodes WHERE id = 'n-2') ELSE parent_id END AS parent_id FROM nodes WHERE id <> 'n-2'")
query("mnt_11_merge_siblings", lambda t: H.merge_map(t.nodes, t.nodes.where("depth = 3").alias("x").join(t.nodes.where("depth = 3").alias("y"), (c("x.parent_id") == c("y.parent_id")) & (c("x.title") == c("y.title")) & (c("x.id") < c("y.id"))).select(c("x.id").alias("a"), c("y.id").alias("b"))).groupBy("parent_id").agg(F.count("*").alias("n")))
