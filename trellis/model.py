"""Fixed values of the data model: enumerations, tiers and priorities, as stored texts."""

# Content types by visibility tier.
VISIBLE = ("insight", "exploration", "synthesis", "question", "planning", "concept", "decision", "paper", "bookmark")
SUPPORTING = ("investigation", "discussion", "reference", "creative")
HIDDEN = ("debug", "code", "paste", "trivial")

# What the graph view shows besides code; items without a type too.
GRAPH_VISIBLE = ("insight", "idea", "exploration", "synthesis", "question", "planning", "concept", "decision", "paper", "bookmark", "reference")

# Edge types that count as semantic.
SEMANTIC_EDGES = ("related", "belongs_to", "sibling", "reference", "because", "contains")

# Priorities of edge types; others have 0.3.
EDGE_PRIORITY = {
    "contradicts": 1.0, "flags": 1.0,
    "derives_from": 0.7, "summarizes": 0.7, "resolves": 0.7, "supersedes": 0.7,
    "supports": 0.5, "questions": 0.5, "prerequisite": 0.5, "evolved_from": 0.5,
}
OTHER_PRIORITY = 0.3

# Structural edge types, whose cost has a floor.
STRUCTURAL_EDGES = ("defined_in", "belongs_to", "sibling")
BROWSE_EDGES = ("clicked", "backtracked", "session_item")
