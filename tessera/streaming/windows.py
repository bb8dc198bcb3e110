"""Statistics, runs and counts over streams, with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_statistics(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value per time window and event type; also works on a batch."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


RUNS = "user_id long, event_type string, start timestamp, end timestamp, n long"
_STATE = "ts array<long>, id array<long>, kind array<string>, run_kind string, run_start long, run_end long, run_n long"


def event_runs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Runs of equal event types of each user (user_id, event_type, start, end, n), in the order of time, then id.

    Rows wait in the user's state until the watermark has passed them, so those that come late by less take their
    place; a run is given out when one of another type follows it. The state holds the rows of the watermark's
    delay and one open run.
    """
    timed = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ids, kinds, kind, start, end, n = state.get if state.exists else ([], [], [], None, 0, 0, 0)
        waiting = list(zip(ts, ids, kinds))
        for frame in frames:
            waiting += zip((frame["ts"].astype("datetime64[us]").astype("int64")).tolist(), frame["event_id"].tolist(), frame["event_type"].tolist())
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: r[:2])
        ready = sum(t < mark * 1000 for t, _, _ in waiting)
        out = []
        for t, _, k in waiting[:ready]:
            if n and k == kind:
                end, n = t, n + 1
                continue
            if n:
                out.append((key[0], kind, start, end, n))
            kind, start, end, n = k, t, t, 1
        waiting = waiting[ready:]
        state.update(([r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting], kind, start, end, n))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, mark + 1))
        if out:
            found = pd.DataFrame(out, columns=["user_id", "event_type", "start", "end", "n"])
            yield found.assign(start=pd.to_datetime(found["start"], unit="us"), end=pd.to_datetime(found["end"], unit="us"))

    return timed.groupBy("user_id").applyInPandasWithState(step, RUNS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def candidate_counts(hits: DataFrame, families: DataFrame, cutoff: float = 1e-5, late: str = "1 hour") -> DataFrame:
    """Distinct proteins by species and family of a stream of hits (ts, species, accession, protein_id, evalue); also works on a batch.

    A protein counts once while its hits come within the watermark of each other; families: (accession, family).
    """
    kept = hits.where(F.col("evalue") <= cutoff).withWatermark("ts", late)
    named = kept.join(families, "accession").select("ts", "species", "family", "protein_id")
    once = named.dropDuplicatesWithinWatermark(["species", "family", "protein_id"]) if hits.isStreaming else named.dropDuplicates(["species", "family", "protein_id"])
    return once.groupBy("species", "family").agg(F.count("*").alias("candidate_count"))
