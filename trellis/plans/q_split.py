"""Queries of subdivision, bridges and the readers' parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import subdivision as S
from ..sources import readers as P
from .q_vectors import SEM, vectors, weighted, weighted_and_config
from .registry import query

c = F.col


def by_label(t):
    return vectors(t).select("id", F.concat(F.lit("l-"), (c("label") % 2).cast("string")).alias("component"))


def children(t):
    return vectors(t).select("id", F.concat(F.lit("p-"), (c("label") % 2).cast("string")).alias("parent"), F.concat(F.lit("c-"), c("label").cast("string")).alias("child"))


def bridges(t, edges):
    return S.bridges(children(t).select("id", "parent", F.lit(0.5).alias("threshold")), edges, 0.1)


def bridged(t):
    e = weighted(t)
    return S.bridge_children(bridges(t, e), children(t), e)


def siblings(t):
    e = weighted(t)
    return S.sibling_edges(children(t), bridges(t, e), e).select("parent", "a", "b", F.round("weight", 6).alias("weight"), F.array_join("bridges", ",").alias("bridges"))


def gaps(t):
    groups = by_label(t)
    inside = S._inside(groups, weighted(t))
    return S.subdivide_by_gaps(groups, H.merges(inside.select("a", "b", "weight")), 20, 3, 4)


query("tre_06_subdivided", lambda t: S.subdivide(by_label(t), weighted(t), 20))
query("tre_08_subdivided_by_gaps", gaps)
query("tre_12_valid_splits", lambda t: H.splits_of_groups(by_label(t), *weighted_and_config(t)))

TIES = SEM.format(t=0.3, k=10) + ", m AS (SELECT id, 'p-' || label % 2 AS parent, 'c-' || label AS child FROM v), e AS (SELECT a, b, similarity AS w FROM sem UNION ALL SELECT b, a, similarity FROM sem), br AS (SELECT parent, id FROM m JOIN (SELECT a AS id, max(w) AS most FROM e GROUP BY 1) USING (id) WHERE abs(most - 0.5::DOUBLE) < 0.1::DOUBLE), bc AS (SELECT DISTINCT br.parent, m.child, br.id FROM br JOIN e ON e.a = br.id JOIN m ON m.id = e.b AND m.parent = br.parent)"
query("tre_13_bridges", lambda t: bridges(t, weighted(t)), f"WITH {TIES} SELECT parent, id FROM br")
query("tre_13_bridge_children", bridged, f"WITH {TIES} SELECT parent, child, id FROM bc")
query("tre_13_sibling_edges", siblings, f"WITH {TIES}, w AS (SELECT x.parent, x.child AS a, y.child AS b, round(avg(e.w), 6) AS weight FROM e JOIN m x ON x.id = e.a JOIN m y ON y.id = e.b AND y.parent = x.parent WHERE x.child < y.child GROUP BY 1, 2, 3), h AS (SELECT x.parent, x.child AS a, y.child AS b, string_agg(x.id, ',' ORDER BY x.id) AS bridges FROM bc x JOIN bc y ON x.parent = y.parent AND x.id = y.id AND x.child < y.child GROUP BY 1, 2, 3) SELECT parent, a, b, coalesce(weight, 0) AS weight, coalesce(bridges, '') AS bridges FROM w FULL JOIN h USING (parent, a, b)")


def conversations(t) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    turn = F.struct("turn", "role", "text")
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def lists(t):
    """SRC-05: conversations written as an export of lists, read by its parser."""
    sent = F.transform("turns", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("sender"), x["text"].alias("text")))
    record = F.to_json(F.struct(c("conv_id").cast("string").alias("uuid"), F.lit("n").alias("name"), sent.alias("chat_messages")))
    return P.turns_of_lists(conversations(t).select(F.from_json(record, P.EXPORT_A).alias("r")).select("r.*")).select("conv_id", "turn", "role", "text")


def trees(t):
    """ING-03: conversations written as trees, each message with a branch that is not taken, linearised by the parser."""
    said = lambda role, text: F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content"))
    name = lambda kind, k: F.concat(F.lit(kind), k.cast("string"))
    node = lambda up, down, role, text: F.struct(up.alias("parent"), down.alias("children"), said(role, text).alias("message"))
    kept = F.transform("turns", lambda x, k: F.struct(name("m", k), node(F.when(k > 0, name("m", k - 1)), F.when(k < F.size("turns") - 1, F.array(name("x", k), name("m", k + 1))).otherwise(F.array().cast("array<string>")), x["role"], x["text"])))
    left = F.transform("turns", lambda x, k: F.struct(name("x", k), node(name("m", k), F.array().cast("array<string>"), x["role"], F.lit("not taken"))))
    mapping = F.map_from_entries(F.concat(kept, left))
    record = F.to_json(F.struct(c("conv_id").cast("string").alias("id"), mapping.alias("mapping"), name("m", F.size("turns") - 1).alias("current_node")))
    last = conversations(t).select(record.alias("record"))
    return P.turns_of_trees(last).select("conv_id", "turn", "role", "text")


def paper_pages(t):
    """SRC-09: papers written as an API page each, read by its parser."""
    p = lambda scheme, value: F.struct(F.lit(scheme).alias("scheme"), value.alias("value"))
    link = F.concat(F.lit("https://a.org/"), "node_id")
    open_ = F.struct(F.struct(F.lit("OPEN").alias("label")).alias("accessRight"), F.array(link, F.concat(link, F.lit(".pdf"))).alias("urls"))
    shut = F.struct(F.struct(F.lit("CLOSED").alias("label")).alias("accessRight"), F.array(F.lit("https://b.org/x.pdf")).alias("urls"))
    r = F.struct(c("node_id").alias("id"), c("title").alias("mainTitle"), F.array("abstract", F.lit("second")).alias("descriptions"), F.array(p("pmid", F.lit("1")), p("doi", F.concat(F.lit("10.1/"), "node_id"))).alias("pids"), F.array(open_, shut).alias("instances"))
    found = P.papers(t.papers.select(F.to_json(F.struct(F.array(r).alias("results"))).alias("json")))
    return found.select("id", "title", "description", "doi", F.array_join("pdf_urls", " ").alias("urls"), "access_right")


query("src_05_list_export", lists, "SELECT conv_id::VARCHAR AS conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, text FROM conversations")
query("ing_03_tree_export", trees, "SELECT conv_id::VARCHAR AS conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
query("src_09_paper_pages", paper_pages, "SELECT node_id AS id, title, abstract AS description, '10.1/' || node_id AS doi, 'https://a.org/' || node_id || '.pdf' AS urls, 'UNKNOWN' AS access_right FROM papers")
