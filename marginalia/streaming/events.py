"""Streams over the event log: windows with watermarks, sessions, and session state with expiry.

The reference has no streams; these are extensions over the same log tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.storage import load, new_path


def read_stream(spark: SparkSession, sf_dir: str, table: str = "events", files: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, a bounded number of files a batch."""
    schema = load(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Count and sum by tumbling window and type; rows later than the watermark are dropped by a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of a user that follow one another within the gap, as sessions."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def expiring_state(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(user_id, opened, n): a session per user that ends after ``minutes`` of event time without news."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "n": [n]})
            return
        opened, n = state.get if state.exists else (None, 0)
        last = 0
        for pdf in pdfs:
            n += len(pdf)
            first = int(pdf["ts"].min().timestamp() * 1000)
            opened = first if opened is None else min(opened, first)
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, opened long, n long", "opened long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all files there are, into a table of the shared folder; returns that table.

    For ``update`` and ``complete`` results the sink keeps each batch's rows with its number.
    """
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    schema = stream.schema.add("_batch", "long")

    spark.createDataFrame([], schema).write.parquet(f"{out}/data/b=-1")  # there may be no batch at all

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/data/b={batch}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


def q_stream_windows(spark, d):
    """Hourly counts by type, from a stream: the last state of each window."""
    t = run_to_end(windowed(read_stream(spark, d)), "update")
    last = t.withColumn("r", F.row_number().over(Window.partitionBy("start", "event_type").orderBy(F.desc("_batch")))).filter("r = 1")
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def q_batch_windows(spark, d):
    """The same windows over the log as a table."""
    return windowed(load(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def q_sessions(spark, d):
    s = sessions(load(spark, d, "events"))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {"stream_windows": q_stream_windows, "batch_windows": q_batch_windows, "session_state": q_sessions}
_W = "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"
SQL = {
    "stream_windows": _W,
    "batch_windows": _W,
    "session_state": "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k",
}
