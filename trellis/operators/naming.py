"""Names for categories by rules, orderings and clusters of a bounded set of topics."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Parts of generic names, words that themes leave out, prefixes by type.
GENERIC_PARTS = ("other", "misc", "diverse", "various", "uncategorized", "unclassified", "general", "remaining", "leftover")
THEME_STOP = ("the", "a", "an", "and", "or", "in", "of", "to", "for", "with", "on", "at", "by", "is", "are", "was")
PREFIXES = {"debug": "Debug:", "code": "Code:", "paste": "Paste:"}


def is_generic(name: Column) -> Column:
    lower = F.lower(name)
    out = F.contains(lower, F.lit(GENERIC_PARTS[0]))
    for p in GENERIC_PARTS[1:]:
        out = out | F.contains(lower, F.lit(p))
    return out


def common_themes(children: DataFrame, share: float = 0.4) -> DataFrame:
    """(parent_id, theme): the most frequent word of the children's names, if enough have it."""
    words = children.select("parent_id", F.explode(F.split(F.trim(F.lower("name")), r"\s+")).alias("word")).where((F.octet_length("word") > 3) & ~c("word").isin(*THEME_STOP))
    n = words.groupBy("parent_id", "word").agg(F.count("*").alias("n"))
    total = children.groupBy("parent_id").agg(F.count("*").alias("total"))
    best = n.join(total, "parent_id").where((c("n") >= F.ceil(c("total") * share)) & (c("total") >= 2)).groupBy("parent_id").agg(F.min_by("word", F.struct(-c("n"), c("word"))).alias("w"))
    return best.select("parent_id", F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)"), F.lit(" Discussions")).alias("theme"))


def fallback_names(children: DataFrame) -> DataFrame:
    """(parent_id, name): the common theme, else the first child's name, shortened."""
    first = children.groupBy("parent_id").agg(F.min("name").alias("first"))
    short = F.when(F.octet_length("first") > 25, F.concat(F.substring("first", 1, 22), F.lit("..."))).otherwise(c("first"))
    return first.join(common_themes(children), "parent_id", "left").select("parent_id", F.coalesce("theme", F.concat(short, F.lit(" and Related"))).alias("name"))


def hidden_title(kind: Column, content: Column) -> Column:
    """A title for code, debug output and pastes: the first line that says something, after a prefix by type."""
    lines = F.filter(F.split(content, "\n"), lambda x: (F.octet_length(F.trim(x)) > 3) & ~F.trim(x).rlike(r"^(```|#|//)"))
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit("Untitled"))
    short = F.when(F.octet_length(line) > 60, F.concat(F.substring(line, 1, 57), F.lit("..."))).otherwise(line)
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv)), kind)
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit(" "), short)).otherwise(short)


def disambiguate(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Equal names in a group get (2), (3) and so on, by id."""
    k = F.row_number().over(Window.partitionBy(group, name).orderBy("id"))
    return rows.withColumn(name, F.when(k > 1, F.concat(c(name), F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(c(name)))


# ---- on a bounded set of topics (a category's children), in memory


def greedy_order(ids: list[str], vectors: dict[str, np.ndarray]) -> list[str]:
    """From the first topic with a vector always to the nearest left; those without a vector last.
    Unchanged if less than half have one."""
    have = [i for i in ids if i in vectors]
    if 2 * len(have) < len(ids) or not have:
        return list(ids)
    out, left = [have[0]], have[1:]
    while left:
        here = vectors[out[-1]]
        sims = [float(here @ vectors[i] / (np.linalg.norm(here) * np.linalg.norm(vectors[i]) or 1.0)) for i in left]
        out.append(left.pop(int(np.argmax(sims))))
    return out + [i for i in ids if i not in vectors]


def tight_clusters(ids: list[str], m: np.ndarray, least_size: int, least_mean: float) -> list[list[str]]:
    """Clusters grown from the best connected topics: a topic joins if it is near all members; a cluster
    stays if it is large and similar enough on average."""
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = unit @ unit.T
    np.fill_diagonal(sims, 1.0)
    seeds = sorted(range(len(ids)), key=lambda i: (-int((sims[i] >= least_mean).sum()), ids[i]))
    used: set[int] = set()
    out = []
    for s in seeds:
        if s in used:
            continue
        members = [s]
        for j in range(len(ids)):
            if j != s and j not in used and all(sims[j, k] >= least_mean - 0.10 for k in members):
                members.append(j)
        if len(members) >= max(2, least_size):
            mean = np.mean([sims[a, b] for n, a in enumerate(members) for b in members[n + 1 :]])
            if mean >= least_mean:
                used.update(members)
                out.append(sorted(ids[k] for k in members))
    return out


def parse_groups(reply: dict[str, list[str]], topics: list[str]) -> dict[str, list[str]]:
    """A grouping reply made whole: generic names replaced by the first topic's, similar groups merged, and what
    is left out gathered in a group of its own."""
    groups: dict[str, list[str]] = {}
    for name, members in reply.items():
        members = [t for t in members if t in topics]
        if not members:
            continue
        if any(p in name.lower() for p in GENERIC_PARTS):
            name = f"{members[0]} and Related"
        same = next((g for g in groups if g.lower() == name.lower() or g.lower() in name.lower() or name.lower() in g.lower()), name)
        groups.setdefault(same, []).extend(members)
    taken = Counter(t for g in groups.values() for t in g)
    if rest := [t for t in topics if t not in taken]:
        groups.setdefault(f"{rest[0]} and Related", []).extend(rest)
    return groups


def theme_threshold(n: int, share: float = 0.4) -> int:
    return math.ceil(n * share)
