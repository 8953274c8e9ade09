"""Streams: the chunk grid over events, and a ledger kept up to date from arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenar.operators.ledger import ledger_of


def event_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """``window_start, kind, n, total`` per step; works on a table and on a stream.

    On a stream, events later than ``late`` are left out, which bounds the state.
    """
    timed = events.withColumn("__lumenar_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__lumenar_ts", late)
    grid = timed.groupBy(F.window("__lumenar_ts", width), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grid.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", who: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``who, session_start, session_end, n`` of events that follow each other within ``gap``."""
    timed = events.withColumn("__lumenar_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__lumenar_ts", late)
    found = timed.groupBy(F.session_window("__lumenar_ts", gap), F.col(who)).agg(F.count("*").alias("n"))
    return found.select(who, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def ledger_stream(documents: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Appends ``url, tasks`` of arriving document texts (``value``) as Parquet to ``out``, then ends."""
    from lumenar.operators.ledger import output_of, state

    url = F.try_variant_get(F.try_parse_json("value"), "$.url", "string")
    tasks = ledger_of(F.try_variant_get(F.try_parse_json("value"), "$.default_tasks", "string"))
    states = F.map_entries(F.transform_values(tasks, lambda _, v: F.struct(state(v).alias("state"), output_of(v).alias("output"))))
    rows = documents.select(url.alias("url"), states.alias("tasks")).filter("url is not null")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
