"""Structured Streaming twins: windowed summaries of the query log, the sliding rate limit as state, and incremental
upkeep of the chunk store.

Watermarks are our addition: late rows are counted until the watermark passes their window. Windows are
aligned to the epoch, so none is lost or counted twice after a pause.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone import runtime
from siltstone.operators import admission, convergence


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count of each window and group; ``time`` is cast to an instant, as a watermark needs one."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    counted = timed.groupBy(F.window("_time", width), *by).agg(F.count("*").alias("events"))
    return counted.select(F.unix_seconds(F.col("window.start")).alias("window_start"), *by, "events")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def limited(events: DataFrame, key: str, time_s: str, limit: int = admission.PER_HOUR, window: float = admission.WINDOW_S) -> DataFrame:
    """(key, t, accepted): the state of a key is the times of the at most ``limit`` accepted events of one window."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        times = sorted(t for pdf in batches for t in pdf["t"].tolist())
        accepted = admission.admit(iter(times), limit, window, held)
        state.update((list(held),))
        yield pd.DataFrame({"key": [k[0]] * len(times), "t": times, "accepted": accepted})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(time_s).cast("double").alias("t"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, t double, accepted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def keep_latest(counts: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a windowed aggregate in update mode: each micro-batch writes the groups that it changed to a folder of its own,
    which a replay overwrites. State goes when the watermark has passed, and no batch rewrites what came before."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, sink: str, keys: list[str], value: str) -> DataFrame:
    """What ``keep_latest`` wrote last of each group."""
    return spark.read.parquet(sink).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def keep_store(chunks: DataFrame, store: str, checkpoint: str, every: str | None = None):
    """Merge each micro-batch of chunks into the store (``convergence.merged``), as a new snapshot named by its batch: a
    replayed batch writes the same snapshot again. ``every`` is the interval of a periodic refresh; without one, what is
    there is taken and the query ends. Returns the started query."""

    def step(batch: DataFrame, number: int) -> None:
        # A replay finds its own snapshot current and merges into it, which changes nothing.
        after = runtime.materialise(convergence.merged(convergence.current(batch.sparkSession, store), batch), "store")
        convergence.publish(after, store, f"batch-{number}", marker=str(number))
        runtime.drop(after)

    when = {"processingTime": every} if every else {"availableNow": True}
    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**when).start()
