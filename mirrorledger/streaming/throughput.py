"""Read throughput per device over a sliding window of read events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import MIB
from .ingest import ALL_THERE_IS

WINDOW_SECONDS = 5


def sliding_throughput(events: DataFrame, *, slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """``ts, device, bytes`` to bytes and rate per device and window; works on streams and on tables.

    The rate divides by the fixed window length. Events later than the watermark are dropped by a stream.
    """
    windows = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{WINDOW_SECONDS} seconds", slide), "device")
        .agg(F.sum("bytes").alias("bytes"))
    )
    return _rates(windows)


def _rates(windows: DataFrame) -> DataFrame:
    return windows.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "device",
        "bytes",
        (F.col("bytes") / WINDOW_SECONDS).alias("bytes_per_second"),
        F.bround(F.col("bytes") / F.lit(float(MIB)) / WINDOW_SECONDS, 1).alias("mb_per_second"),
    )


def total_throughput(by_device: DataFrame) -> DataFrame:
    """All devices together, per window."""
    return by_device.groupBy("window_start", "window_end").agg(
        F.sum("bytes").alias("bytes"), (F.sum("bytes") / WINDOW_SECONDS).alias("bytes_per_second")
    )


def write_windows(windows: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Closed windows, appended as Parquet. ``trigger``: as for ``DataStreamWriter.trigger``; without it the stream ends when
    all there is has been read. Windows that are open then stay in the stream's state, see :func:`open_windows`."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that the stream of this checkpoint has not closed, with what they hold after its last batch.

    They are read from its state store, one task for each state partition; the stream may go on afterwards.
    """
    state = spark.read.format("statestore").load(checkpoint)
    (total,) = state.schema["value"].dataType.names
    return _rates(state.select("key.window", "key.device", F.col(f"value.`{total}`").alias("bytes")))
