"""Structured Streaming: the same columns on streams, and windowed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.assess import assess, assess_output
from ..sources.config import Config


def assess_stream(stream: DataFrame, text: str = "text", url: str | None = None, cfg: Config = Config()) -> DataFrame:
    """Assessment needs no state, so a stream takes the batch plan as it is."""
    return assess(stream, text, url, cfg)


def assess_output_stream(stream: DataFrame, text: str = "text", prompt: str | None = None, cfg: Config = Config()) -> DataFrame:
    return assess_output(stream, text, prompt, cfg)


def windowed_counters(assessed: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals of assessed, blocked, suspicious and clean rows in each window of event time; rows later than ``late`` are dropped
    by the watermark, as a stream must to bound its state."""
    threat = F.size("risk.patterns") > 0
    return (
        assessed.withWatermark(ts, late)
        .groupBy(F.window(ts, window))
        .agg(F.count("*").alias("total"), F.count_if(F.col("risk.blocked")).alias("blocked"), F.count_if(threat).alias("threats"), F.count_if(~threat).alias("clean"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "blocked", "threats", "clean")
    )


def to_parquet(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream's rows to a Parquet folder, exactly once; ``trigger`` as in DataStreamWriter.trigger()."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
