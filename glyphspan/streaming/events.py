"""The append-only stream of events: automated users are filtered out, the rest is appended with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of the user agents by which automated users show themselves.
AGENTS = ("Googlebot", "AdsBot-Google", "Slurp", "msnbot", "yandex.com/bots", "Baiduspider", "DuckDuckBot", "bingbot", "GPTBot", "ClaudeBot")


def is_automated(agent: Column, parts: tuple[str, ...] = AGENTS) -> Column:
    """Whether a user agent holds one of ``parts``, whatever the case; a null one does not."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.lower(agent), F.lit(part.lower()))
    return F.coalesce(found, F.lit(False))


def wanted(events: DataFrame, agent: str = "agent", parts: tuple[str, ...] = AGENTS, source: str = "web") -> DataFrame:
    """Events of users that are not automated, with their source; a table without a column of agents is taken whole."""
    rows = events.where(~is_automated(F.col(agent), parts)) if agent in events.columns else events
    return rows.withColumn("source", F.lit(source))


def append_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, schema, agent: str = "agent", key: str = "event_id", ts: str = "ts", late: str = "1 day"):
    """Start a query that appends wanted events of new files in ``folder`` to ``out``, with the server's time of receipt.

    Each file is taken once; an event that comes again (by ``key``, at the same ``ts``) within ``late`` of the latest event
    is left out, so files that are sent twice do not count twice; older ones are dropped as too late."""
    rows = wanted(spark.readStream.schema(schema).parquet(folder), agent)
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicates([key, ts]).withColumn("received", F.current_timestamp())
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def phase_durations(marks: DataFrame, request: str = "request", phase: str = "phase", ts: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, phase, requests, mean_ms, most_ms): how long requests stay in each phase, by windows of the time a phase began.

    ``marks`` are (request, phase, ts): a request enters a phase; it is left when the request enters the next, and the last
    mark of a request ends it.  On a stream a session of a request ends ``late`` after its last mark and is then told; marks
    that come later than that are dropped.  A request has a bounded number of phases, so a session's marks are one row."""
    spans = F.session_window(F.col(ts), late)
    marks = marks.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = marks.withWatermark(ts, late) if marks.isStreaming else marks
    each = timed.groupBy(F.col(request).alias("request"), spans).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(phase).alias("phase")))).alias("marks"))
    steps = F.zip_with(F.slice("marks", F.lit(1), F.size("marks") - 1), F.slice("marks", F.lit(2), F.greatest(F.size("marks") - 1, F.lit(0))), lambda a, b: F.struct(a["phase"].alias("phase"), a["ts"].alias("began"), (F.unix_micros(b["ts"]) - F.unix_micros(a["ts"])).alias("micros")))
    told = each.where(F.size("marks") > 1).select(F.explode(steps).alias("s")).select(F.window("s.began", window)["start"].alias("start"), "s.phase", "s.micros")
    return told.groupBy("start", "phase").agg(F.count(F.lit(1)).alias("requests"), (F.avg("micros") / 1000).alias("mean_ms"), (F.max("micros") / 1000).alias("most_ms"))
