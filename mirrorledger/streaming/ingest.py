"""Streams over manifests: new rows of an inventory arrive as files land in a folder."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.inventory import Destination
from ..operators.match import candidates, match
from ..sources.store import FingerprintStore


ALL_THERE_IS = {"availableNow": True}


def ingest(
    fingerprints: DataFrame,
    store: FingerprintStore,
    checkpoint: str,
    *,
    first_batch: int = 0,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Feed a stream of fingerprinted files into the store, one write per micro-batch.

    A micro-batch that is run again after a failure replaces its own write. ``trigger``: as for
    ``DataStreamWriter.trigger``; without it the stream ends when all there is has been stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch, first_batch + number)

    return (
        fingerprints.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )


def verify_stream(
    source: DataFrame,
    inventory: DataFrame,
    destinations: list[Destination],
    mode: str,
    path: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Match a stream of fingerprinted source files against the destinations as they are.

    Each file's verdict depends on that file and the destinations only, so micro-batches are matched independently. The
    destinations' lookup tables are written once, before the first batch. Results go to ``path`` as ``batch=<n>``.
    ``trigger``: as for ``DataStreamWriter.trigger``; without it the stream ends when all there is has been matched.
    """
    prepared = candidates(inventory, destinations, mode, keep=True)

    def write(batch: DataFrame, number: int) -> None:
        results = match(batch, None, destinations, mode, prepared=prepared)
        results.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_THERE_IS))
        .start()
    )
