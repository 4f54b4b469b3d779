"""Live views of runs as streams: latest frames, snapshots, session expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Least time between two frames of a view.
FRAME_MS = 80


def latest_frames(steps: DataFrame) -> DataFrame:
    """The last frame of each run, for update mode: slow readers skip frames, none waits."""
    rest = [c for c in steps.columns if c != "run_id"]
    return steps.groupBy("run_id").agg(F.max_by(F.struct(*rest), "iteration").alias("frame")).select("run_id", "frame.*")


def follow(steps: DataFrame, sink, frame_ms: int = FRAME_MS) -> DataStreamWriter:
    """A writer that hands each batch's changed frames to sink(df, batch), at most one batch each frame_ms."""
    return latest_frames(steps).writeStream.outputMode("update").trigger(processingTime=f"{frame_ms} milliseconds").foreachBatch(sink)


def snapshots(steps: DataFrame, path: str) -> DataStreamWriter:
    """A writer that replaces the table at path with all runs' last frames after each batch."""
    return latest_frames(steps).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))


def active_sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """session_id, start, end, events of sessions that an idle time ends; late events beyond it are dropped with their state."""
    window = F.session_window("ts", idle)
    out = events.withWatermark("ts", idle).groupBy(window.alias("w"), "session_id").agg(F.count("*").alias("events"))
    return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
