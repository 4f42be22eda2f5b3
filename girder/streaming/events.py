"""Event streams. Windows, sessions and budgets take a static or a streaming DataFrame and declare their watermark."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of those there."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need times with a zone


def windowed_metrics(events: DataFrame, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(by, start, n, total) of each tumbling window; rows later than ``delay`` are left out of a stream."""
    timed = events.withWatermark("ts", delay).groupBy(F.window("ts", width), by)
    total = F.sum(F.col("value").cast("decimal(38,6)")).cast("double")
    return timed.agg(F.count("*").alias("n"), total.alias("total")).select(by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, by: str, gap: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    """(by, start, n) of each run of events that are less than ``gap`` apart."""
    timed = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), by)
    return timed.agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def first_arrivals(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """A stream without repeats of the same keys within ``delay``; Spark has this for streams only."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class Bucket:
    """The times of the last events that were let through, ``limit`` at most."""

    def __init__(self, limit: int, seconds: int, times: Iterable[int] = ()):
        self.limit, self.span, self.times = limit, seconds * 1_000_000, deque(times)

    def ask(self, at: int) -> tuple[int, bool]:
        """(events let through within the span before, whether this one is denied); one that is denied isn't recorded."""
        while self.times and self.times[0] < at - self.span:
            self.times.popleft()
        recent = len(self.times)
        if recent < self.limit:
            self.times.append(at)
        return recent, recent >= self.limit


def limited(events: DataFrame, by: str, limit: int, seconds: int) -> DataFrame:
    """(event_id, by, recent, limited) of static rows, in order of time within each ``by``. A task holds ``limit`` times, however many events there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, bucket = None, Bucket(limit, seconds)
        for batch in batches:
            told = []
            for own, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != who:
                    who, bucket = own, Bucket(limit, seconds)
                told.append(bucket.ask(at))
            columns = [batch.column(0), batch.column(1), pa.array([n for n, _ in told], pa.int64()), pa.array([d for _, d in told], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["event_id", by, "recent", "limited"])

    rows = events.select("event_id", F.col(by).cast("long").alias(by), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition(by).sortWithinPartitions(by, "at", "event_id").mapInArrow(run, f"event_id long, {by} long, recent long, limited boolean")


def limited_stream(stream: DataFrame, by: str, limit: int, seconds: int) -> DataFrame:
    """The same on a stream: the times are kept as state for each ``by``; rows of a micro-batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = Bucket(limit, seconds, state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])  # of one key in one micro-batch
        told = [bucket.ask(at) for at in rows["at"].tolist()]
        state.update((list(bucket.times),))
        yield pd.DataFrame({"event_id": rows["event_id"], by: rows[by], "recent": [n for n, _ in told], "limited": [d for _, d in told]})

    rows = stream.select("event_id", F.col(by).cast("long").alias(by), F.unix_micros("ts").alias("at"))
    schema = f"event_id long, {by} long, recent long, limited boolean"
    return rows.groupBy(by).applyInPandasWithState(run, schema, "times array<long>", "append", GroupStateTimeout.NoTimeout)


def daily_budget(usage: DataFrame, by: str, amount: str, budget: float, delay: str = "10 minutes") -> DataFrame:
    """(by, day, used, left, degraded) of each day: what is used up to the budget, and whether it is used up."""
    days = usage.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), by).agg(F.sum(F.col(amount).cast("decimal(38,6)")).cast("double").alias("used"))
    return days.select(by, F.col("window.start").alias("day"), "used", F.greatest(F.lit(0.0), budget - F.col("used")).alias("left"), (F.col("used") >= budget).alias("degraded"))


def index_changes(stream: DataFrame, replace: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Give each micro-batch of changed documents to ``replace``, the latest version of each; a rerun goes on where the last one stopped."""

    def latest(batch: DataFrame, _: int) -> None:
        replace(batch.groupBy("doc_id").agg(F.max(F.struct("ts", "text")).alias("last")).select("doc_id", "last.*"))

    stream.writeStream.foreachBatch(latest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Work off what has arrived and append finished windows to Parquet; a rerun goes on where the last one stopped."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
