"""Bounded, reproducible samples of labelled documents, and training on them in a task."""

import pickle
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 1 << 18


def labels_by_id(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label (0 or 1), one row per id. Rows without id or label are left out; of contradicting rows 1 wins."""
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def digests(rows: DataFrame, row_id: str, text: str, max_bytes: int) -> DataFrame:
    """The id, digest (key) and hash of the id (place) of each text of at most ``max_bytes``; the text itself goes no further."""
    known = rows.where(F.octet_length(text) <= max_bytes)
    return known.select(row_id, F.md5(text).alias("__key"), F.xxhash64(row_id, F.lit(7)).alias("__place"))


def chosen(rows: DataFrame, row_id: str, text: str, max_bytes: int) -> DataFrame:
    """Each different text of at most ``max_bytes`` once, as its key and the smallest place of its ids."""
    return digests(rows, row_id, text, max_bytes).groupBy("__key").agg(F.min("__place").alias("__place"))


def texts_of(rows: DataFrame, row_id: str, text: str, picked: DataFrame) -> DataFrame:
    """The texts of the ``picked`` keys and places, which are broadcast."""
    keyed = rows.select(F.md5(text).alias("__key"), F.xxhash64(row_id, F.lit(7)).alias("__place"), F.col(text))
    return keyed.join(F.broadcast(picked), ["__key", "__place"])


def sample(docs: DataFrame, known: DataFrame, per_class: int, max_bytes: int = MAX_TEXT_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` labelled texts of each class (text, label), chosen by a hash of their ids, and how many labelled
    rows each class has. Labels without a document, repeated texts and texts over ``max_bytes`` are left out before the
    choice, so they take no places in it. A text that has both labels counts as 1. Labels are joined with digests, so no text
    is shuffled before the choice; at most ``2 * per_class`` digests are broadcast."""
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labelled = digests(texts, "doc_id", "text", max_bytes).join(known, "doc_id")
    rows = labelled.groupBy("__key").agg(F.min("__place").alias("__place"), F.max("label").alias("label"))
    parts = [rows.where(F.col("label") == c).orderBy("__place", "__key").limit(per_class) for c in (0, 1)]
    found = texts_of(texts, "doc_id", "text", parts[0].unionByName(parts[1]))
    return found.groupBy("text").agg(F.max("label").alias("label")), counts


def fitted(rows: DataFrame, fit: Callable, counts: dict[int, int]) -> dict:
    """The ``state`` of the model ``fit(texts, labels, counts)`` of the sampled rows, made in one task of an executor; only
    that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("text", pa.string()), ("label", pa.int32())])
        table = pa.Table.from_batches([b.cast(kind) for b in batches], kind).sort_by([("text", "ascending")]).combine_chunks()
        texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        made = zlib.compress(pickle.dumps(fit(texts, table.column("label").to_numpy(), counts).state()), 1)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["made"])

    made = rows.select("text", "label").coalesce(1).mapInArrow(run, "made binary").first()
    return pickle.loads(zlib.decompress(made["made"])) if made else fit(pa.array([], pa.string()), [], counts).state()
