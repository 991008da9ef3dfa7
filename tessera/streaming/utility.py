"""Streams: folder watch and the running utility of chunks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_folder(spark: SparkSession, folder: str, ingest: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = "60 seconds", glob: str = "*") -> StreamingQuery:
    """New files under folder, once each by content: ingest(batch, epoch). Writers must move files in; the checkpoint outlives restarts.
    every=None handles what is there and ends."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    fresh = files.withColumn("file_hash", F.sha2("content", 256)).dropDuplicates(["file_hash"])
    writer = fresh.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running_utility(events: DataFrame, alpha: float = 0.15, start: float = 0.5) -> DataFrame:
    """events (a stream): chunk_id, ts, seq, contribution -> chunk_id, utility_ema, use_count after each batch. The state is the average
    and the count; the rows of a batch are folded in their order (ts, seq)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for c in rows["contribution"].fillna(1.0).clip(0, 1):
            ema, n = (1 - alpha) * ema + alpha * c, n + 1
        state.update((float(ema), int(n)))
        yield pd.DataFrame({"chunk_id": [key[0]], "utility_ema": [float(ema)], "use_count": [n]})

    return events.groupBy("chunk_id").applyInPandasWithState(fold, "chunk_id long, utility_ema double, use_count long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))


def upserted(updates: DataFrame, keys: list[str], path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """A stream of updates into a table with one row a key, the newest: each batch is written as a new version (epoch=n under path) of
    what the version before held and the batch's rows. A batch that is run again writes the same version. No row comes to the driver."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch
        if epoch:
            old = spark.read.schema(batch.schema).parquet(f"{path}/epoch={epoch - 1}")
            new = old.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of a table of upserted(); an empty one before the first batch."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    epochs = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{path}/epoch={max(epochs)}") if epochs else spark.createDataFrame([], schema)


def background(spark: SparkSession, cycle: Callable[[int], None], every: str, checkpoint: str) -> StreamingQuery:
    """cycle(n) again and again, at the interval given, on the streaming engine's own thread; stop() ends it. A run that fails is told to
    the log and does not end the next ones."""

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            cycle(epoch)
        except Exception:
            logging.getLogger(__name__).exception("cycle %d failed", epoch)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
