"""Conversations, messages and papers to nodes and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

c = F.col
GAP_MS, BURST_MS, LOOK_BACK, LOOK_BACK_MS = 300_000, 30_000, 10, 900_000


def alternate_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with an assistant turn right after it;
    a user turn without is dropped, any other turn stands alone as an answer."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"), F.lag("role").over(w).alias("last_role"))
    paired = (c("role") == "user") & (c("next_role") == "assistant")
    taken = (c("role") == "assistant") & (F.coalesce("last_role", F.lit("")) == "user")
    return t.where(paired | ((c("role") != "user") & ~taken)).select("conv_id", "turn", F.when(paired, c("text")).alias("question"), F.when(paired, c("next_text")).otherwise(c("text")).alias("answer"))


def block_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn with all assistant turns up to the next user turn, a blank line between."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.where(c("role").isin("user", "assistant")).withColumn("block", F.sum((c("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    said = F.sort_array(F.collect_list(F.when(c("role") == "assistant", F.struct("turn", "text"))))
    out = t.groupBy("conv_id", "block").agg(F.min(F.when(c("role") == "user", c("turn"))).alias("turn"), F.max(F.when(c("role") == "user", c("text"))).alias("question"), said.alias("a"))
    return out.where(F.size("a") > 0).select("conv_id", "turn", "question", F.array_join(F.transform("a", lambda x: x["text"]), "\n\n").alias("answer"))


def new_papers(papers: DataFrame, known: DataFrame) -> DataFrame:
    """papers with `verdict`: id, doi, garbage, hash or new, against what is known; in_batch says
    whether an earlier paper of the same batch has the same hash."""
    h = X.content_hash(c("title"), c("abstract"))
    k = known.select(c("node_id").alias("__id"), F.lower("doi").alias("__doi"), h.alias("__h"))
    out = papers.withColumn("hash", h).withColumn("bad", X.is_garbage(c("title"), c("abstract")))
    for name, mine, theirs in (("id", c("node_id"), "__id"), ("doi", F.lower("doi"), "__doi"), ("hash", c("hash"), "__h")):
        seen = k.select(c(theirs).alias("__k")).where("__k is not null").distinct().withColumn(f"__{name}", F.lit(True))
        out = out.join(seen, mine == c("__k"), "left").drop("__k")
    verdict = F.when(c("__id"), "id").when(c("__doi"), "doi").when(c("bad"), "garbage").when(c("__hash"), "hash").otherwise("new")
    again = F.row_number().over(Window.partitionBy("hash").orderBy("node_id")) > 1
    return out.select(*papers.columns, "hash", verdict.alias("verdict"), again.alias("in_batch"))


def message_gaps(messages: DataFrame) -> DataFrame:
    """Messages with the gap to the one before in the conversation and whether the author is the same."""
    w = Window.partitionBy("conversation_id").orderBy("sent_at", "id")
    return messages.withColumn("gap_ms", c("sent_at") - F.lag("sent_at").over(w)).withColumn("same_author", c("author") == F.lag("author").over(w))


def threads(messages: DataFrame, gap_ms: int = GAP_MS, burst_ms: int = BURST_MS) -> DataFrame:
    """(id, conversation_id, thread): a thread goes on over a short gap by the same author or a very short one."""
    m = message_gaps(messages)
    joins = (c("gap_ms") <= gap_ms) & (c("same_author") | (c("gap_ms") < burst_ms))
    w = Window.partitionBy("conversation_id").orderBy("sent_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("id", "conversation_id", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w).alias("thread"))


def thread_edges(messages: DataFrame, gap_ms: int = GAP_MS, burst_ms: int = BURST_MS, least: float = 0.3) -> DataFrame:
    """(id, weight): links to the message before, 1 in a burst, else falling with the gap."""
    w = F.when(c("same_author") & (c("gap_ms") < burst_ms), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - c("gap_ms") / gap_ms))
    return message_gaps(messages).where("gap_ms is not null").select("id", F.round(w, 9).alias("weight")).where(c("weight") >= least)


def shared_links(messages: DataFrame) -> DataFrame:
    """(url, n, first_id) of the links in messages, normalised."""
    found = messages.where("body is not null").select("id", "sent_at", F.explode(X.urls(c("body"))).alias("raw"))
    return found.groupBy(X.normalise_url(c("raw")).alias("url")).agg(F.count("*").alias("n"), F.min_by("id", F.struct("sent_at", "id")).alias("first_id"))


def agreements(messages: DataFrame, look_back_ms: int = LOOK_BACK_MS) -> DataFrame:
    """(proposal, id, author): agreeing messages with the proposal they answer: the nearest of the last ten messages
    within the time that proposes something, by somebody else. A window over a fixed number of rows, no self-join."""
    w = Window.partitionBy("conversation_id").orderBy("sent_at", "id").rowsBetween(-LOOK_BACK, -1)
    proposing = F.when(F.coalesce(c("body").rlike(X.PROPOSES), F.lit(False)), F.struct("sent_at", "id", "author"))
    m = messages.withColumn("before", F.collect_list(proposing).over(w))
    near = F.filter("before", lambda p: (p["sent_at"] >= c("sent_at") - look_back_ms) & (p["author"] != c("author")))
    return m.where(c("body").rlike(X.AGREES)).withColumn("near", near).where(F.size("near") > 0).select(F.element_at("near", -1)["id"].alias("proposal"), "id", "author")


def decisions(messages: DataFrame, look_back_ms: int = LOOK_BACK_MS) -> DataFrame:
    """(proposal, agreers): proposals that enough different people agreed to."""
    people = messages.groupBy("conversation_id").agg(F.countDistinct("author").alias("people"))
    a = agreements(messages, look_back_ms).join(messages.select(c("id").alias("proposal"), "conversation_id"), "proposal").join(people, "conversation_id")
    return a.groupBy("proposal").agg(F.countDistinct("author").alias("agreers"), F.first("people").alias("people")).where(c("agreers") >= F.greatest(F.lit(2), F.least(F.lit(2), F.floor(c("people") / 2)))).select("proposal", "agreers")


def quoted_threads(messages: DataFrame, gap_ms: int = GAP_MS, burst_ms: int = BURST_MS) -> DataFrame:
    """Threads of messages that may quote (quote_id): a quote's thread comes first. Sequential in a conversation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        thread: dict[int, int] = {}
        out, last, n = [], None, 0
        for m in pdf.sort_values(["sent_at", "id"]).itertuples():
            if pd.notna(m.quote_id) and int(m.quote_id) in thread:
                t = thread[int(m.quote_id)]
            elif last is not None and m.sent_at - last.sent_at <= gap_ms and (m.author == last.author or m.sent_at - last.sent_at < burst_ms):
                t = thread[last.id]
            else:
                n += 1
                t = n
            thread[m.id], last = t, m
            out.append((m.id, m.conversation_id, t))
        return pd.DataFrame(out, columns=["id", "conversation_id", "thread"])

    return messages.select("id", "conversation_id", "author", "sent_at", "quote_id").groupBy("conversation_id").applyInPandas(run, "id long, conversation_id long, thread long")


def author_map(text: str) -> dict[str, str]:
    """'a=Ann, b=Bob' as a map."""
    return dict(tuple(x.strip() for x in part.split("=", 1)) for part in text.split(",") if "=" in part)


def pages_visited(visits: DataFrame) -> DataFrame:
    """Page state by URL: visits, first and last, and the dwell time of the pages before, as it is booked."""
    w = Window.partitionBy("tab_id").orderBy("seen_at", "url", "dwell_ms")
    v = visits.withColumn("previous_dwell", F.lag("dwell_ms").over(w))
    return v.groupBy("url").agg(F.count("*").alias("visits"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.sum(F.coalesce("previous_dwell", F.lit(0))).alias("dwell_ms")).select(X.url_id(c("url")).alias("page_id"), "url", "visits", "first_seen", "last_seen", "dwell_ms")


def session_items(visits: DataFrame) -> DataFrame:
    """Visits of a session in order, with the page before."""
    w = Window.partitionBy("session_id").orderBy("seen_at", "url")
    return visits.select("session_id", "url", (F.row_number().over(w) - 1).alias("ordinal"), F.lag("url").over(w).alias("previous"))


def merge_sessions(visits: DataFrame, into: str, other: str) -> DataFrame:
    """The items of two sessions as one, the other's after."""
    w = Window.partitionBy(F.lit(into)).orderBy(F.when(c("session_id") == into, 0).otherwise(1), "seen_at", "url")
    return visits.where(c("session_id").isin(into, other)).select("url", "seen_at", (F.row_number().over(w) - 1).alias("ordinal"))


def gap_sessions(visits: DataFrame, gap_ms: int) -> DataFrame:
    """(tab_id, session, visits): sessions that a long gap ends."""
    w = Window.partitionBy("tab_id").orderBy("seen_at", "url")
    new = F.coalesce(c("seen_at") - F.lag("seen_at").over(w) > gap_ms, F.lit(True)).cast("int")
    v = visits.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return v.groupBy("tab_id", "session").agg(F.count("*").alias("visits"), F.min("seen_at").alias("start"))
