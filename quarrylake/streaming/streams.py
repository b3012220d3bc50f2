"""Structured Streaming: rate counters, duplicate windows, sessions, incremental counts and lifecycles (stateful.py has those on timers).

Each function takes a streaming or a batch DataFrame and returns one of the same kind where the semantics allow it;
event times are timestamps (cast timestamp_ntz first).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def event_stream(spark, folder: str, schema) -> DataFrame:
    """New parquet files of a folder, with ts as a timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def rate_counts(events: DataFrame, keys: list[str], watermark: str = "5 minutes") -> DataFrame:
    """Requests by key and minute. A new minute starts from nothing."""
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    return e.groupBy(F.window("ts", "1 minute"), *keys).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("minute"), *keys, "requests")


def over_limit(events: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return rate_counts(events, keys).where(F.col("requests") > limit)


def drop_repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Stream: the first of equal keys within an hour. The batch twin is drop_repeats_batch."""
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(keys)


def drop_repeats_batch(events: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Rows that come at least an hour after the row of the same keys before them, or are the first."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("ts").cast("timestamp").cast("double") - F.col("_b").cast("timestamp").cast("double") >= seconds)).drop("_b")


def settle(events: DataFrame, keys: list[str], gap: str = "45 seconds") -> DataFrame:
    """One row a burst of changes: it ends when nothing comes for the gap."""
    e = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("changes")).select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "changes")


def latest_demand(events: DataFrame, key: str) -> DataFrame:
    """The newest demand of each key; older ones are superseded."""
    return events.groupBy(key).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"), (F.count("*") - 1).alias("superseded"))


def retain(events: DataFrame, now: str, days: int = 365, most: int = 5000) -> DataFrame:
    """The newest events, no older than days, most at the most: a bounded top-k."""
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def keep_counts(changes: DataFrame, table: str, keys: list[str], checkpoint: str, signed: str = "sign"):
    """Streams signed rows into a table of counts: each batch adds its sums to a new version of the table, so a batch that is run again gives the same version."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        delta = batch.groupBy(*keys).agg(F.sum(signed).cast("long").alias("count"))
        if batch_id:
            prior = spark.read.parquet(f"{table}/v={batch_id - 1}")
            delta = prior.select(*keys, "count").unionByName(delta).groupBy(*keys).agg(F.sum("count").cast("long").alias("count")).where("count <> 0")
        delta.write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def lifecycle_stream(operations: DataFrame, transitions: dict[tuple[str, str], str]) -> DataFrame:
    """State of each handoff after every operation in a batch, kept between batches (id, operation, ts) -> (id, state, rejected)."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else "active"
        rejected = 0
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            to = transitions.get((at, row.operation))
            rejected += to is None
            at = to or at
        state.update((at,))
        yield pd.DataFrame([(key[0], at, rejected)], columns=["id", "state", "rejected"])

    return operations.groupBy("id").applyInPandasWithState(step, "id string, state string, rejected int", "state string", "update", "NoTimeout")


def generation_digest(previous: str, changes: DataFrame) -> DataFrame:
    """One row: a digest chained to the last one, of a set of changes (uri, change) summed in parallel."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\x00", "uri", "change"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return changes.agg(F.sha2(F.concat(F.lit(previous), F.lit(":"), F.count("*").cast("string"), F.lit(":"), F.coalesce(F.sum(part), F.lit(0)).cast("string")), 256).alias("generation"))


def rotate(keys: DataFrame, after: str, key: str = "share") -> DataFrame:
    """Keys with their position: from the one after on, then the others. For the shares of a directory, which are few."""
    order = [F.when(F.col(key) >= after, 0).otherwise(1), key]
    return keys.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("position")
