"""Incremental jobs: file streams, state across batches, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", most_files: int = 15) -> DataFrame:
    """New files of a folder, at most ``most_files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(fmt).load(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later call goes on where it ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def first_seen_by_hash(stream: DataFrame, index: str, out: str, checkpoint: str, key: str = "sha", order: str = "id") -> StreamingQuery:
    """Rows whose key no earlier batch held, the first of each key.

    The keys seen live in a table beside the output.  A batch that is repeated
    after a failure overwrites what it wrote before, so nothing doubles.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        try:
            seen = spark.read.parquet(index).filter(F.col("batch") < number).select(key)
            rows = rows.join(seen, key, "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch has no index yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark.read.parquet(f"{out}/batch={number}").select(key).write.mode("overwrite").parquet(f"{index}/batch={number}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def attempts(log: DataFrame, most: int = 3) -> DataFrame:
    """stem, n_failed, ok, state of an attempts log (stem, outcome): done,
    given_up after ``most`` failures, else retry; rate limits count for nothing."""
    g = log.groupBy("stem").agg(F.count_if(F.col("outcome") == "failed").alias("n_failed"), F.coalesce(F.bool_or(F.col("outcome") == "ok"), F.lit(False)).alias("ok"))
    return g.withColumn("state", F.when(F.col("ok"), "done").when(F.col("n_failed") >= most, "given_up").otherwise("retry"))


def tumbling(events: DataFrame, time: str, width: str, group: str, value: str, late: str = "1 hour") -> DataFrame:
    """window_start, group, n, total per tumbling window, stream or table."""
    src = events.withWatermark(time, late) if events.isStreaming else events
    return (
        src.groupBy(F.window(time, width).alias("w"), group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), group, "n", "total")
    )


def sliding(events: DataFrame, time: str, width: str, step: str, group: str, late: str = "1 hour") -> DataFrame:
    src = events.withWatermark(time, late) if events.isStreaming else events
    return src.groupBy(F.window(time, width, step).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), group, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n: runs of events not parted by a gap."""
    src = events.withWatermark(time, late) if events.isStreaming else events
    return (
        src.groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event per key within the watermark (a stream) or at all (a table)."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(time)).alias("r")).select(*keys, "r.*")
