"""Exports as rows of text, ready for write.text()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.trees import descendants, induced

c = F.col


def _name() -> Column:
    return F.coalesce("ai_title", "title")


def selection(nodes: DataFrame, node: str | None = None, subtree: bool = False) -> DataFrame:
    """All items, one node, or a node with everything under it."""
    if node is None:
        return nodes.where("is_item")
    if not subtree:
        return nodes.where(c("id") == node)
    return nodes.join(descendants(nodes, nodes.where(c("id") == node), 100).select("id").distinct(), "id")


def bibtex(nodes: DataFrame) -> DataFrame:
    """(id, value): an entry for each paper, with the year of its date."""
    year = F.year(F.timestamp_millis(c("created_at")))
    entry = F.concat(F.lit("@article{paper_"), F.substring("id", 1, 8), F.lit(",\n  title = {"), _name(), F.lit("},\n  year = {"), year.cast("string"), F.lit("},\n"), F.when(c("tags").isNotNull(), F.concat(F.lit("  keywords = {"), c("tags"), F.lit("},\n"))).otherwise(""), F.lit("}\n"))
    return nodes.where("source = 'openaire'").select("id", entry.alias("value"))


def markdown(nodes: DataFrame, full: bool = False) -> DataFrame:
    """(id, value): a section for each node, its heading as deep as the node, to six."""
    head = F.concat(F.repeat(F.lit("#"), F.least(c("depth") + 1, F.lit(6))), F.lit(" "), _name(), F.lit("\n\n"))
    body = F.when(c("content").isNotNull(), F.concat(F.lit("---\n\n"), c("content"), F.lit("\n\n"))).otherwise("") if full else F.lit("")
    return nodes.select("id", F.concat(head, F.when(c("tags").isNotNull(), F.concat(F.lit("**Tags:** "), c("tags"), F.lit("\n\n"))).otherwise(""), body, F.lit("---\n")).alias("value"))


def _strong(nodes: DataFrame, edges: DataFrame, least: float = 0.7) -> DataFrame:
    return induced(edges, nodes).where(c("weight") > least)


def _tree(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "parent_id").join(nodes.select(c("id").alias("parent_id")), "parent_id", "left_semi")


def dot(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(part, value): the lines of a directed graph, parts in order."""
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    spark = nodes.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("digraph G {\n  rankdir=TB;\n  node [shape=box, style=rounded];").alias("value"))
    colour = F.when(c("is_item"), "lightblue").otherwise("lightyellow")
    items = nodes.select(F.lit(1), F.concat(F.lit("  "), q(c("id")), F.lit(" [label="), q(F.replace(_name(), F.lit('"'), F.lit('\\"'))), F.lit(", fillcolor="), colour, F.lit(", style=filled];")))
    tree = _tree(nodes).select(F.lit(2), F.concat(F.lit("  "), q(c("parent_id")), F.lit(" -> "), q(c("id")), F.lit(" [color=gray];")))
    out = head.union(items).union(tree)
    if edges is not None:
        share = F.concat(F.round(c("weight") * 100).cast("int").cast("string"), F.lit("%"))
        out = out.union(_strong(nodes, edges).select(F.lit(3), F.concat(F.lit("  "), q(c("source_id")), F.lit(" -> "), q(c("target_id")), F.lit(" [color=red, style=dashed, label="), q(share), F.lit("];"))))
    return out.union(spark.range(1).select(F.lit(9), F.lit("}")))


def graphml(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(part, value): the elements of a GraphML document, parts in order."""
    spark = nodes.sparkSession

    def xml(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="label" for="node" attr.name="label" attr.type="string"/>\n'
        '  <key id="type" for="node" attr.name="type" attr.type="string"/>\n  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n  <graph id="G" edgedefault="directed">'
    )
    first = spark.range(1).select(F.lit(0).alias("part"), F.lit(head).alias("value"))
    kind = F.when(c("is_item"), "item").otherwise("category")
    items = nodes.select(F.lit(1), F.concat(F.lit('    <node id="'), xml(c("id")), F.lit('"><data key="label">'), xml(_name()), F.lit('</data><data key="type">'), kind, F.lit("</data></node>")))
    tree = _tree(nodes).select(F.lit(2), F.concat(F.lit('    <edge source="'), xml(c("parent_id")), F.lit('" target="'), xml(c("id")), F.lit('"/>')))
    out = first.union(items).union(tree)
    if edges is not None:
        out = out.union(_strong(nodes, edges).select(F.lit(3), F.concat(F.lit('    <edge source="'), xml(c("source_id")), F.lit('" target="'), xml(c("target_id")), F.lit('"><data key="weight">'), F.format_number("weight", 3), F.lit("</data></edge>"))))
    return out.union(spark.range(1).select(F.lit(9), F.lit("  </graph>\n</graphml>")))
