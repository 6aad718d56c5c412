"""Scans, filters, joins, aggregations and keyed changes over nodes and edges.

Every operator takes DataFrames and returns one; nothing is collected. Ties end at the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..model import GRAPH_VISIBLE, SEMANTIC_EDGES, SUPPORTING, VISIBLE
from .ranges import running

c = F.col


def is_code(kind: str = "content_type") -> Column:
    """The stored pattern is 'code_%', in which the underscore stands for any character."""
    return c(kind).rlike("(?i)^code.")


def shown(name: str = "content_type") -> Column:
    return c(name).isNull() | c(name).isin(*GRAPH_VISIBLE) | is_code(name)


# ---- scans and lookups


def by_id(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(c("id") == value)


def edges_of_source(edges: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """Edges with an end among the nodes of a source."""
    ids = nodes.where(c("source") == source).select(c("id").alias("__id"))
    one = edges.join(ids, c("source_id") == c("__id"), "left_semi")
    other = edges.join(ids, c("target_id") == c("__id"), "left_semi")
    return one.unionByName(other.join(ids, c("source_id") == c("__id"), "left_anti"))


def changed_since(rows: DataFrame, since: int, column: str = "updated_at") -> DataFrame:
    return rows.where(c(column) > since)


def code_files(nodes: DataFrame) -> DataFrame:
    """Code items for each file path in their metadata."""
    path = F.get_json_object("tags", "$.file_path")
    return nodes.where(path.isNotNull()).groupBy(path.alias("file_path")).agg(F.count("*").alias("n"))


def items_at_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.get_json_object("tags", "$.file_path") == path).select("id")


# ---- filters


def visible_items(nodes: DataFrame) -> DataFrame:
    """Items of the visible tier, without messages."""
    return nodes.where(c("is_item") & (c("content_type").isin(*VISIBLE) | is_code()) & (c("source").isNull() | (c("source") != "signal")))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit) if offset else rows.orderBy(*order).limit(limit)


def children(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(c("parent_id") == parent)


def graph_children(nodes: DataFrame, parent: str, include_hidden: bool = False) -> DataFrame:
    found = children(nodes, parent)
    return found if include_hidden else found.where(~c("is_item") | shown())


def supporting_items(nodes: DataFrame, parent: str) -> DataFrame:
    return children(nodes, parent).where(c("content_type").isin(*SUPPORTING))


def search_titles(nodes: DataFrame, text: str) -> DataFrame:
    like = f"%{text}%"
    return nodes.where(c("is_item") & (c("title").ilike(like) | c("ai_title").ilike(like)))


def edges_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((c("source_id") == node) | (c("target_id") == node))


def edges_of_many(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids (column id), with the default weight."""
    i = ids.select(c("id").alias("__id")).distinct()
    one = edges.join(i, c("source_id") == c("__id"), "left_semi")
    two = edges.join(i, c("target_id") == c("__id"), "left_semi").join(i, c("source_id") == c("__id"), "left_anti")
    return one.unionByName(two).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def semantic_edges_of_many(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges_of_many(edges.where(c("kind").isin(*SEMANTIC_EDGES)), ids)


def live_meta(nodes: DataFrame, edges: DataFrame, meta_type: str | None = None) -> DataFrame:
    """Meta nodes that nothing supersedes."""
    found = nodes.where(c("node_class") == "meta")
    found = found.where(c("meta_type") == meta_type) if meta_type else found
    gone = edges.where("kind = 'supersedes'").select(c("target_id").alias("__id"))
    return found.join(gone, c("id") == c("__id"), "left_anti")


def search_filter(nodes: DataFrame, as_of: int, kind: str | None = None, author: str | None = None, recent_ms: int | None = None) -> DataFrame:
    if kind:
        nodes = nodes.where(c("content_type") == kind)
    if author:
        nodes = nodes.where(F.contains(F.lower("author"), F.lit(author.lower())))
    return nodes.where(c("created_at") >= as_of - recent_ms) if recent_ms is not None else nodes


def shareable(nodes: DataFrame, threshold: float) -> DataFrame:
    return nodes.where(c("is_item") & (c("privacy") >= threshold))


def human_edited(nodes: DataFrame, field: str) -> DataFrame:
    return nodes.where(F.array_contains(F.from_json("human_edited", "array<string>"), field))


# ---- joins


def edge_query(edges: DataFrame, nodes: DataFrame, kind=None, agent=None, target_agent=None, confidence_min=None, since=None, not_superseded=False, limit=50) -> DataFrame:
    """Edges by any of the filters with the titles of both ends, newest first."""
    tests = [(kind, c("kind") == kind), (agent, c("agent_id") == agent), (confidence_min, c("confidence") >= confidence_min), (since, c("created_at") >= since)]
    for given, test in tests:
        if given is not None:
            edges = edges.where(test)
    if not_superseded:
        edges = edges.where("superseded_by is null")
    s = nodes.select(c("id").alias("source_id"), F.coalesce("ai_title", "title").alias("source_title"))
    t = nodes.select(c("id").alias("target_id"), F.coalesce("ai_title", "title").alias("target_title"), c("agent_id").alias("target_agent"))
    out = edges.join(s, "source_id").join(t, "target_id")
    if target_agent is not None:
        out = out.where(c("target_agent") == target_agent)
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def item_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted edges between items, without messages."""
    ok = nodes.where(c("is_item") & (c("source").isNull() | (c("source") != "signal"))).select(c("id").alias("__id"))
    return edges.where("weight is not null").join(ok, c("source_id") == c("__id"), "left_semi").join(ok, c("target_id") == c("__id"), "left_semi")


def cluster_items(edges: DataFrame, nodes: DataFrame, cluster: str, other_spelling: str, at_least: float) -> DataFrame:
    member = edges.where((c("kind") == "belongs_to") & c("target_id").isin(cluster, other_spelling) & (c("weight").isNull() | (c("weight") >= at_least))).select(c("source_id").alias("__id"))
    return nodes.where("is_item").join(member, c("id") == c("__id"), "left_semi")


def related_items(edges: DataFrame, nodes: DataFrame, item: str, at_least: float = 0.3) -> DataFrame:
    """Items that share a category with an item."""
    b = edges.where((c("kind") == "belongs_to") & (c("weight") >= at_least)).select("source_id", "target_id")
    mine = b.where(c("source_id") == item).select("target_id").distinct()
    other = b.join(mine, "target_id", "left_semi").where(c("source_id") != item).select(c("source_id").alias("__id"))
    return nodes.join(other, c("id") == c("__id"), "left_semi")


def shared_tags(item_tags: DataFrame, a: str, b: str) -> DataFrame:
    one, two = (item_tags.where(c("item_id") == x).select("tag_id") for x in (a, b))
    return one.join(two, "tag_id", "left_semi").distinct()


def items_with_any_tag(item_tags: DataFrame, tags: list[str]) -> DataFrame:
    return item_tags.where(F.lower("tag_id").isin(*(t.lower() for t in tags))).select("item_id").distinct()


def _oriented(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Semantic edges with the parents of both ends."""
    p = nodes.select(c("id").alias("__n"), c("parent_id").alias("__p"))
    e = edges.where(c("kind").isin(*SEMANTIC_EDGES)).select("id", "source_id", "target_id")
    e = e.join(p, c("source_id") == c("__n")).select("id", "target_id", c("__p").alias("pa"))
    return e.join(p, c("target_id") == c("__n")).select("id", "pa", c("__p").alias("pb"))


def cross_edge_counts(edges: DataFrame, nodes: DataFrame, parent: str | None = None) -> DataFrame:
    """Semantic edges between the items of sibling categories, (parent, a, b, n), of one parent or of all."""
    cats = nodes.where("not is_item and parent_id is not null").select(c("id").alias("__c"), c("parent_id").alias("__g"))
    if parent is not None:
        cats = cats.where(c("__g") == parent)
    e = _oriented(edges, nodes).where("pa != pb")
    e = e.join(cats, c("pa") == c("__c")).select("pa", "pb", c("__g").alias("parent"))
    e = e.join(cats, (c("pb") == c("__c")) & (c("parent") == c("__g"))).select("parent", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
    return e.groupBy("parent", "a", "b").agg(F.count("*").alias("n"))


def category_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_item and parent_id is not null").groupBy(c("parent_id").alias("category")).agg(F.count("*").alias("size"))


def sibling_cross_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cross counts with the number of items on either side."""
    sizes, out = category_sizes(nodes), cross_edge_counts(edges, nodes)
    for side in ("a", "b"):
        out = out.join(sizes.select(c("category").alias(side), c("size").alias(f"size_{side}")), side, "left").fillna(0, [f"size_{side}"])
    return out


def sibling_pairs(nodes: DataFrame, parent: str) -> DataFrame:
    """All pairs of categories under one parent, which has a handful, with their sizes."""
    cats = nodes.where((c("parent_id") == parent) & ~c("is_item")).select("id")
    sizes = category_sizes(nodes)
    cats = cats.join(sizes, c("id") == c("category"), "left").select("id", F.coalesce("size", F.lit(0)).alias("size"))
    a, b = cats.select(c("id").alias("a"), c("size").alias("size_a")), cats.select(c("id").alias("b"), c("size").alias("size_b"))
    return a.join(b, c("a") < c("b"))


def duplicate_titles(papers: DataFrame) -> DataFrame:
    n = papers.groupBy("title").count().where("count > 1").select("title")
    return papers.join(n, "title", "left_semi")


def dead_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is missing."""
    have = nodes.select(c("id").alias("__id"))
    no_source = edges.join(have, c("source_id") == c("__id"), "left_anti")
    no_target = edges.join(have, c("source_id") == c("__id"), "left_semi").join(have, c("target_id") == c("__id"), "left_anti")
    return no_source.unionByName(no_target)


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    have = nodes.select(c("id").alias("__id"))
    return edges.join(have, c("source_id") == c("__id"), "left_semi").join(have, c("target_id") == c("__id"), "left_semi")


def orphan_items(nodes: DataFrame) -> DataFrame:
    """Items without a parent, or whose parent is missing."""
    have = nodes.select(c("id").alias("__id"))
    return nodes.where("is_item").join(have, c("parent_id") == c("__id"), "left_anti")


def stale_operational(nodes: DataFrame, edges: DataFrame, as_of: int, days: int, keep_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Old operational nodes that no edge touches."""
    old = nodes.where((c("node_class") == "operational") & (c("created_at") < as_of - days * 86_400_000))
    for p in keep_prefixes:
        old = old.where(~c("title").ilike(p + "%"))
    ends = edges.select(c("source_id").alias("__id")).union(edges.select("target_id"))
    return old.join(ends, c("id") == c("__id"), "left_anti")


def open_contradictions(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    t = nodes.select(c("id").alias("__id"), F.coalesce("ai_title", "title").alias("__t"))
    e = edges.where("kind = 'contradicts' and superseded_by is null").orderBy(F.desc("created_at"), "id").limit(limit)
    e = e.join(t, c("source_id") == c("__id"), "left").select("id", "source_id", "target_id", F.coalesce("__t", F.substring("source_id", 1, 8)).alias("source_title"))
    return e.join(t, c("target_id") == c("__id"), "left").select("id", "source_title", F.coalesce("__t", F.substring("target_id", 1, 8)).alias("target_title"))


def verification_chains(edges: DataFrame) -> DataFrame:
    """(task, state): tasks with an implementation that derives from them, verified if something supports one."""
    impl = edges.where("kind = 'derives_from'").select(c("target_id").alias("task"), c("source_id").alias("impl")).distinct()
    supported = edges.where("kind = 'supports'").select(c("target_id").alias("impl")).distinct().withColumn("ok", F.lit(1))
    return impl.join(supported, "impl", "left").groupBy("task").agg(F.when(F.max("ok") == 1, "verified").otherwise("implemented").alias("state"))


def code_neighbours(edges: DataFrame, ids: DataFrame, limit: int = 5) -> DataFrame:
    """(id, callers, callees) with at most `limit` of either, by id."""
    calls = edges.where("kind = 'calls'").select("source_id", "target_id").distinct()
    out = ids.select("id")
    for name, mine, other in (("callers", "target_id", "source_id"), ("callees", "source_id", "target_id")):
        near = calls.select(c(mine).alias("id"), c(other).alias("o")).join(ids.select("id"), "id", "left_semi")
        near = near.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("o"))).where(c("rn") <= limit)
        out = out.join(near.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("o")), ",").alias(name)), "id", "left")
    return out


def node_edges(edges: DataFrame, nodes: DataFrame, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Edges of a node with the far end's title."""
    e = edges if kind is None else edges.where(c("kind") == kind)
    t = nodes.select(c("id").alias("other"), F.coalesce("ai_title", "title").alias("title"))
    out = e.where(c("source_id") == node).select("id", "kind", F.lit("out").alias("direction"), c("target_id").alias("other"))
    into = e.where((c("target_id") == node) & (c("source_id") != node)).select("id", "kind", F.lit("in").alias("direction"), c("source_id").alias("other"))
    both = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return both.join(t, "other", "left")


def folder_view(nodes: DataFrame, prefix: str) -> DataFrame:
    """Items under a path prefix, grouped by file."""
    path = F.get_json_object("tags", "$.file_path")
    return nodes.where(path.startswith(prefix)).groupBy(path.alias("file_path")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n"))


def similar_with_calls(edges: DataFrame, hits: DataFrame, node: str, k: int) -> DataFrame:
    """Called and documenting neighbours first, with similarity 1, then vector hits (id, similarity)."""
    e = edges.where(c("kind").isin("calls", "documents"))
    near = e.where(c("source_id") == node).select(c("target_id").alias("id"), F.concat("kind", F.lit(":out")).alias("why")).union(e.where(c("target_id") == node).select("source_id", F.concat("kind", F.lit(":in"))))
    near = near.groupBy("id").agg(F.min("why").alias("why")).withColumn("similarity", F.lit(1.0)).withColumn("first", F.lit(0))
    more = hits.select("id", F.lit("similar").alias("why"), "similarity", F.lit(1).alias("first"))
    both = near.unionByName(more).where(c("id") != node)
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("first"))).where("rn = 1")
    return best.orderBy("first", F.desc("similarity"), "id").limit(k).select("id", "why", "similarity")


# ---- aggregations


def stats(nodes: DataFrame) -> DataFrame:
    """Eight counts in one pass."""
    tests = {
        "total": F.lit(True), "items": c("is_item"), "categories": ~c("is_item"), "processed": c("is_processed"), "unprocessed": c("is_item") & ~c("is_processed"),
        "embedded": c("has_embedding"), "clustered": c("cluster_id").isNotNull() & c("is_item"), "pinned": c("is_pinned"),
    }
    return nodes.agg(*(F.count_if(test).alias(name) for name, test in tests.items()))


def counts_by(rows: DataFrame, column: str, default: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """Categories with their true numbers of children."""
    n = nodes.where("parent_id is not null").groupBy(c("parent_id").alias("__p")).agg(F.count("*").alias("n"))
    return nodes.where("not is_item").join(n, c("id") == c("__p"), "left").select("id", F.coalesce("n", F.lit(0)).alias("child_count"))


def wrong_child_counts(nodes: DataFrame) -> DataFrame:
    """Nodes whose stored count differs from that of their visible children."""
    listed = [t for t in GRAPH_VISIBLE if t != "reference"]
    seen = nodes.where(c("content_type").isNull() | c("content_type").isin(*listed) | is_code()).where("parent_id is not null")
    n = seen.groupBy(c("parent_id").alias("__p")).agg(F.count("*").alias("n"))
    return nodes.join(n, c("id") == c("__p"), "left").select("id", c("child_count").alias("stored"), F.coalesce("n", F.lit(0)).alias("actual")).where("stored != actual")


def privacy_stats(nodes: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    p, item = c("privacy"), c("is_item")
    return nodes.agg(
        F.count_if(item).alias("items"), F.count_if(item & p.isNotNull()).alias("scored"), F.count_if(item & p.isNull()).alias("unscored"),
        F.count_if(item & (p < low)).alias("private"), F.count_if(item & (p >= low) & (p < high)).alias("semi_private"), F.count_if(item & (p >= high)).alias("public"),
        F.count_if(item & c("is_private")).alias("flagged"), F.round(F.avg(F.when(item, p)), 6).alias("mean"),
    )


def runs(edges: DataFrame) -> DataFrame:
    """Runs by the id in the metadata: first and last time, edges, agents."""
    run = F.get_json_object("metadata", "$.run_id")
    return edges.withColumn("run_id", run).where("run_id is not null").groupBy("run_id").agg(F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("agent_id")), ",").alias("agents"))


def run_edges(edges: DataFrame, run_id: str) -> DataFrame:
    return edges.where(F.get_json_object("metadata", "$.run_id") == run_id)


def rollback_preview(edges: DataFrame, nodes: DataFrame, run_id: str) -> DataFrame:
    """Operational nodes by the run's agents within its time span."""
    span = run_edges(edges, run_id).agg(F.min("created_at").alias("t0"), F.max("created_at").alias("t1"), F.collect_set("agent_id").alias("agents"))
    return nodes.where("node_class = 'operational'").join(F.broadcast(span), c("created_at").between(c("t0"), c("t1")) & F.array_contains("agents", c("agent_id"))).select("id", "agent_id", "created_at")


def run_metrics(edges: DataFrame) -> DataFrame:
    """Edges with the metrics of their metadata, typed."""
    m = edges.where("metadata is not null").withColumn("m", F.from_json("metadata", "run_id string, cost_usd double, num_turns long, status string, experiment string"))
    return m.select("id", "created_at", "agent_id", "m.run_id", c("m.cost_usd").alias("cost"), c("m.num_turns").alias("turns"), "m.status", "m.experiment")


#: Run states, the strongest first.
STATES = ("planned", "verified", "implemented", "cancelled", "escalated")


def run_list(edges: DataFrame) -> DataFrame:
    """Runs with their strongest state, cost, turns and agents."""
    m = run_metrics(edges)
    rank = F.array_position(F.array(*map(F.lit, STATES)), c("status"))
    out = m.withColumn("rank", F.when(rank > 0, rank)).groupBy("run_id").agg(F.min("rank").alias("rank"), F.sum("cost").alias("cost"), F.sum("turns").alias("turns"), F.countDistinct("agent_id").alias("agents"), F.max("created_at").alias("ended"))
    return out.select("run_id", F.coalesce(F.element_at(F.array(*map(F.lit, STATES)), c("rank").cast("int")), F.lit("pending")).alias("status"), "cost", "turns", "agents", "ended")


def run_costs(edges: DataFrame, since: int) -> DataFrame:
    return run_metrics(edges).where(c("created_at") >= since).groupBy("status").agg(F.count("*").alias("n"), F.sum("cost").alias("total"), F.round(F.avg("cost"), 6).alias("mean"))


def run_statistics(edges: DataFrame, experiment: str | None = None) -> DataFrame:
    m = run_metrics(edges)
    m = m.where(c("experiment") == experiment) if experiment else m
    return m.agg(F.count("*").alias("n"), F.median("cost").alias("median_cost"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.round(F.avg((c("status") == "verified").cast("int")), 6).alias("success"))


def compare_experiments(edges: DataFrame, a: str, b: str) -> DataFrame:
    m = run_metrics(edges).where(c("experiment").isin(a, b))
    return m.groupBy("experiment").agg(F.sum("cost").alias("cost"), F.sum("turns").alias("turns"), F.countDistinct("agent_id").alias("agents"), (F.max("created_at") - F.min("created_at")).alias("wall_ms"))


def run_timeline(edges: DataFrame, run_id: str) -> DataFrame:
    """A run's steps in time with the running cost."""
    w = Window.partitionBy("run_id").orderBy("created_at", "id")
    m = run_metrics(edges).where(c("run_id") == run_id)
    return m.select("id", F.row_number().over(w).alias("step"), F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"))


def graph_status(edges: DataFrame, nodes: DataFrame, as_of: int) -> DataFrame:
    """Recent edges, contradictions, coverage (summarised share of knowledge items) and coherence."""
    day, open_ = 86_400_000, c("superseded_by").isNull()
    e = edges.agg(
        F.count_if(c("created_at") >= as_of - day).alias("edges_24h"), F.count_if(c("created_at") >= as_of - 7 * day).alias("edges_7d"), F.count_if(open_).alias("active"),
        F.count_if((c("kind") == "contradicts") & open_).alias("contradictions"), F.countDistinct(F.when((c("kind") == "summarizes") & open_, c("target_id"))).alias("summarised"),
    )
    k = nodes.agg(F.count_if(c("is_item") & (F.coalesce("node_class", F.lit("knowledge")) == "knowledge")).alias("knowledge"))
    return e.join(k, F.lit(True)).select("edges_24h", "edges_7d", "contradictions", F.round(F.try_divide(c("summarised"), c("knowledge")), 6).alias("coverage"), F.round(1 - F.try_divide(c("contradictions"), c("active")), 6).alias("coherence"))


def most_connected(edges: DataFrame, n: int = 5) -> DataFrame:
    ends = edges.select(c("source_id").alias("id")).unionAll(edges.select("target_id"))
    return ends.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(n)


def weight_statistics(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Count, mean, sample deviation, extremes and the percentiles sorted[n*p/100].

    Percentiles come from counts of distinct weights: one row for each weight is ordered, in ranges, not each edge."""
    w = cut(edges.where(c(weight).isNotNull()).groupBy(c(weight).alias("w")).agg(F.count("*").alias("m")))
    w = running(w, [c("w")], {"before": c("m")}).join(F.broadcast(w.agg(F.sum("m").alias("n"))), how="cross")  # one row
    pick = lambda p: F.min(F.when(c("before") + c("m") > F.floor(c("n") * p / 100), c("w")))
    mean = F.sum(c("w") * c("m")) / F.max("n")
    out = w.agg(F.max("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(c("w") * c("w") * c("m")) / F.max("n") - mean * mean, F.lit(0.0)) * F.max("n") / F.greatest(F.max("n") - 1, F.lit(1))).alias("std"), F.min("w").alias("low"), F.max("w").alias("high"), *(pick(p).alias(f"p{p}") for p in (10, 25, 50, 75, 90)))
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high", "p10", "p25", "p50", "p75", "p90", F.round(c("p75") - c("p25"), 6).alias("iqr"))


def sessions(visits: DataFrame) -> DataFrame:
    """Visits of each session: number, duration and where it began."""
    return visits.groupBy("session_id").agg(F.count("*").alias("n"), (F.max("seen_at") - F.min("seen_at")).alias("duration_ms"), F.min_by("url", F.struct("seen_at", "url")).alias("entry"))


# ---- windows and sets


def recency(edges: DataFrame) -> DataFrame:
    """Each end's edges with their age on a scale from 0, oldest, to 1."""
    ends = edges.select(c("source_id").alias("node"), "id", "created_at").unionByName(edges.where("source_id != target_id").select(c("target_id").alias("node"), "id", "created_at"))
    span = ends.groupBy("node").agg(F.min("created_at").alias("t0"), F.max("created_at").alias("t1"))
    return ends.join(span, "node").select("node", "id", F.round(F.when(c("t1") > c("t0"), (c("created_at") - c("t0")) / (c("t1") - c("t0"))).otherwise(1.0), 6).alias("recency"))


def weight_gaps(edges: DataFrame, top: int) -> DataFrame:
    """The largest gaps between neighbouring distinct weights, with their midpoints."""
    w = cut(edges.where("weight is not null").select("weight").distinct())
    w = running(w, [c("weight")], maxima={"below": c("weight")}).select(c("below").alias("weight"), (c("weight") - c("below")).alias("gap"))
    out = w.withColumn("gap", F.round("gap", 6)).where("gap is not null").orderBy(F.desc("gap"), F.desc("weight")).limit(top)
    return out.select("gap", F.round(c("weight") + c("gap") / 2, 6).alias("threshold"))


def prioritised_anchors(semantic: DataFrame, text: DataFrame, cap: int) -> DataFrame:
    """Semantic anchors (id, rank) before text ones, each id once."""
    both = semantic.select("id", F.lit(0).alias("first"), "rank").unionByName(text.select("id", F.lit(1).alias("first"), "rank"))
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("first", "rank"))).where("rn = 1")
    return best.orderBy("first", "rank", "id").limit(cap).select("id", "first")


# ---- exports and keyed changes


def share_export(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes that may leave: neither scored under the threshold nor flagged private without a score."""
    return nodes.where(~(F.coalesce(c("privacy") < threshold, F.lit(False)) | (c("privacy").isNull() & F.coalesce("is_private", F.lit(False)))))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with those of rows whose key is new, each once."""
    have = table.select(c(key).alias("__k"))
    return table.unionByName(rows.dropDuplicates([key]).join(have, c(key) == c("__k"), "left_anti"))


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(c(key).alias("__k")), c(key) == c("__k"), "left_anti")


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the non-null values of changes (one row for each key)."""
    new = changes.select(c(key).alias("__k"), *(c(x).alias(f"__{x}") for x in changes.columns if x != key))
    out = table.join(new, c(key) == c("__k"), "left")
    return out.select(*(F.coalesce(f"__{x}", x).alias(x) if x in changes.columns and x != key else c(x) for x in table.columns))


def upsert_last(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def protected_update(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """An update that leaves the fields which a person has edited."""
    new = changes.select(c("id").alias("__k"), *(c(x).alias(f"__{x}") for x in changes.columns if x != "id"))
    edited = F.coalesce(F.from_json("human_edited", "array<string>"), F.array().cast("array<string>"))
    out = nodes.join(new, c("id") == c("__k"), "left")
    return out.select(*(F.when(F.array_contains(edited, x), c(x)).otherwise(F.coalesce(f"__{x}", x)).alias(x) if x in changes.columns and x != "id" else c(x) for x in nodes.columns))


def supersede(edges: DataFrame, old: str, new: str) -> DataFrame:
    return edges.withColumn("superseded_by", F.when(c("id") == old, F.lit(new)).otherwise(c("superseded_by")))


def new_meta_version(edges: DataFrame, old: str, new: str) -> DataFrame:
    """The outgoing edges that a new version of a meta node takes over."""
    return edges.where((c("source_id") == old) & c("superseded_by").isNull() & (c("kind") != "supersedes")).select(F.concat(F.lit(f"{new}-"), c("id")).alias("id"), F.lit(new).alias("source_id"), "target_id", "kind")


def with_run_id(edges: DataFrame, run_id: str) -> DataFrame:
    """Edges with the run's id in their metadata."""
    old = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: k != "run_id")
    return edges.withColumn("metadata", F.to_json(F.map_concat(kept, F.create_map(F.lit("run_id"), F.lit(run_id)))))


def role_view(nodes: DataFrame, role: str) -> DataFrame:
    """What an agent's role may read: summarisers no meta but contradictions, synthesisers no meta."""
    kind = F.coalesce("node_class", F.lit("knowledge"))
    if role == "summarizer":
        return nodes.where((kind != "meta") | (c("meta_type") == "contradiction"))
    return nodes.where(kind.isin("knowledge", "operational") & c("is_item")) if role == "synthesizer" else nodes


def oldest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, type), the oldest."""
    return upsert_last(edges, ["source_id", "target_id", "kind"], ["created_at", "id"])


def garbage_duplicates(papers: DataFrame) -> DataFrame:
    """Papers to drop: of a title that repeats with at most one DOI, those without a DOI whose
    abstract and content are bad, but for the first where nothing else would stay."""
    bad = c("doi").isNull() & ((F.length(F.trim(F.coalesce("abstract", F.lit("")))) < 50) | c("abstract").rlike("^[0-9]*$"))
    w = Window.partitionBy("title")
    p = papers.select("node_id", "title", bad.alias("bad"), F.count("*").over(w).alias("n"), F.size(F.collect_set(F.lower("doi")).over(w)).alias("dois"))
    p = p.where("n > 1 and dois <= 1").withColumn("rn", F.row_number().over(w.orderBy("bad", "node_id")))
    return p.where("bad and rn > 1").select("node_id", "title")
