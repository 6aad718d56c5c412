"""Incremental and streaming ingest.

The high-water import takes rows newer than the last imported, counts late ones and keeps no
other state than the mark. Sessions and page state run as Structured Streaming with
watermarks, so state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def above_mark(rows: DataFrame, mark: int, time: str = "sent_at") -> tuple[DataFrame, Row]:
    """(rows newer than the mark, counts of new and late rows with the next mark)."""
    counts = rows.agg(F.count_if(c(time) > mark).alias("new"), F.count_if(c(time) <= mark).alias("late"), F.greatest(F.coalesce(F.max(time), F.lit(mark)), F.lit(mark)).alias("mark")).first()
    return rows.where(c(time) > mark), counts


class HighWaterImport:
    """A foreachBatch sink: appends what is newer than the mark to a Parquet folder, numbered on from the last
    row. Batches come in order from one query, and a batch that is written again overwrites its own folder."""

    def __init__(self, folder: str, time: str = "sent_at", mark: int = -1):
        self.folder, self.time, self.mark, self.late, self.imported = folder, time, mark, 0, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        new, counts = above_mark(batch, self.mark, self.time)
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        self.mark, self.late, self.imported = counts.mark, self.late + counts.late, self.imported + counts.new
        batch.unpersist()


def sessions_by_gap(visits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(tab_id, start, end, visits) of visits with an event time; batch or stream."""
    v = visits.withWatermark("ts", late) if visits.isStreaming else visits
    return v.groupBy("tab_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("visits")).select("tab_id", c("w.start").alias("start"), c("w.end").alias("end"), "visits")


def page_state(visits: DataFrame) -> DataFrame:
    """(url, visits, last_seen, dwell_ms), in update mode on a stream."""
    return visits.groupBy("url").agg(F.count("*").alias("visits"), F.max("seen_at").alias("last_seen"), F.sum("dwell_ms").alias("dwell_ms"))


def windowed_counts(visits: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    v = visits.withWatermark("ts", late) if visits.isStreaming else visits
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return v.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(c("w.start").alias("start"), "kind", "n")


# ---- one live session for each tab

LIVE = "tab_id long, seen_at long, url string, session string, ordinal int"


def assign_sessions(visits: DataFrame) -> DataFrame:
    """Each visit with its session: the live one, else the one it names, else a new one. A visit of kind 'pause'
    ends the live session, 'resume' takes up the last one. State: (session, visits, number), one for each tab."""

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, count, number, last = state.get if state.exists else (None, 0, 0, None)
        rows = []
        for m in pd.concat(list(batches)).sort_values(["seen_at", "url"]).itertuples():
            if m.kind == "resume" and live is None and last is not None:
                live = last
            if live is None:
                number += 1
                live = m.session_id if isinstance(m.session_id, str) and m.session_id else f"{key[0]}-{number}"
                count = 0
            rows.append((key[0], m.seen_at, m.url, live, count))
            count += 1
            last = live
            if m.kind == "pause":
                live = None
        state.update((live, count, number, last))
        yield pd.DataFrame(rows, columns=["tab_id", "seen_at", "url", "session", "ordinal"])

    rows = visits.select("tab_id", "seen_at", "url", "kind", "session_id")
    return rows.groupBy("tab_id").applyInPandasWithState(run, LIVE, "live string, count int, number int, last string", "append", GroupStateTimeout.NoTimeout)
