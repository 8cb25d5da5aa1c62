"""Benchmark decontamination: a prefix-filtered set join between documents and item windows.

Each benchmark item is cut into windows of ``size`` consecutive words (a shorter item is one window). A window occurs in
a document only if all its shingles do, so for exact containment one necessary shingle is enough as its prefix: the one
that is rarest over all documents. Documents give their shingles that pass a fixed-size filter of prefixes, with the
words around them; these are joined with the windows on the prefix shingle, bounded by position and length (the window
must fit into the document around the shingle), and verified word by word.

Nulls and edges: a null or word-free text has no words and no hits; an item without words has no windows; a null item id
counts as the empty id. Repeated documents each get their row; repeated items count once. Empty tables give empty results
or no hits. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .rows import ROW_KEY, hash_filter, join_same, keyed, passes
from .wordbytes import Words, sliced, window_hash

WINDOW = 10
SHINGLE = 3


def item_windows(benchmark: DataFrame, size: int = WINDOW, item_column: str = "item_id") -> DataFrame:
    """One row per item and window: item_id (string), window (words joined by a blank), n (its words), shingles."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item_id": [], "window": [], "n": [], "shingles": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(pa.array([text], pa.large_string()))
                if not len(words):
                    continue
                listed, hashes = words.text(0, len(words)), words.hashes
                n = min(size, len(listed))
                width = min(SHINGLE, n)
                shingles = window_hash(hashes, width).view(np.int64)
                for i in range(len(listed) - n + 1):
                    out["item_id"].append(item)
                    out["window"].append(b" ".join(listed[i : i + n]).decode())
                    out["n"].append(n)
                    out["shingles"].append(shingles[i : i + n - width + 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["item_id"], pa.string()),
                    pa.array(out["window"], pa.string()),
                    pa.array(out["n"], pa.int32()),
                    pa.array(out["shingles"], pa.list_(pa.int64())),
                ],
                names=list(out),
            )

    return rows.mapInArrow(cut, "item_id string, window string, n int, shingles array<bigint>")


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word position of all shingles that lie within one document."""
    hashes = window_hash(words.hashes, width)
    doc = words.doc
    whole = doc[: len(hashes)] == doc[width - 1 :] if len(hashes) else np.zeros(0, bool)
    return hashes, whole


def shingle_counts(docs: DataFrame, table: np.ndarray, widths: list[int]) -> DataFrame:
    """How often each shingle that passes the filter occurs over all documents: sh, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                words = Words(piece.column("text"))
                found = [np.zeros(0, np.uint64)]
                for width in widths:
                    hashes, whole = _shingles(words, width)
                    found.append(hashes[whole & passes(table, hashes)])
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["sh", "n"])

    return docs.select("text").mapInArrow(count, "sh bigint, n bigint").groupBy("sh").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, table: np.ndarray, widths: list[int], size: int) -> DataFrame:
    """Per document its word count and the shingles that pass the filter, each with the words a window could cover."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {ROW_KEY} bigint, n_words bigint, found array<struct<sh:bigint,pos:int,low:int,near:string>>"
    kind = pa.list_(pa.struct([("sh", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("near", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                words = Words(piece.column("text"))
                doc, first = words.doc, words.first
                found: list[list] = [[] for _ in range(piece.num_rows)]
                for width in widths:
                    hashes, whole = _shingles(words, width)
                    for at in np.flatnonzero(whole & passes(table, hashes)).tolist():
                        d = doc[at]
                        low = max(first[d], at - size + width)
                        high = min(first[d + 1], at + size)
                        near = b" ".join(words.text(low, high)).decode()
                        found[d].append((int(hashes[at].view(np.int64)), at - first[d], low - first[d], near))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column(ROW_KEY), pa.array(words.counts), pa.array(found, kind)],
                    names=["doc_id", ROW_KEY, "n_words", "found"],
                )

    return docs.mapInArrow(find, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, row key, n_words, spans (word ranges that repeat a window), items (sorted ids)."""
    rows = keyed(docs)
    items, _ = materialise(item_windows(benchmark, size), "windows")
    windows = items.groupBy("window", "n").agg(F.first("shingles").alias("shingles"))
    shingles = windows.select("window", "n", F.posexplode("shingles").alias("offset", "sh"))
    widths = sorted({min(SHINGLE, r["n"]) for r in items.select("n").distinct().collect()})
    counts = shingle_counts(rows, hash_filter(shingles, "sh"), widths)
    rarity = shingles.join(counts.withColumnRenamed("n", "seen"), "sh", "left").fillna(0, ["seen"])
    # A window with a shingle that no document has cannot occur, so it needs no candidates.
    prefixes = (
        rarity.groupBy("window", "n")
        .agg(F.min(F.struct("seen", "sh", "offset")).alias("p"))
        .where("p.seen > 0")
        .select("window", "n", "p.sh", "p.offset")
    )
    prefixes, _ = materialise(prefixes, "prefixes")
    found, _ = materialise(_candidates(rows, hash_filter(prefixes, "sh"), widths, size), "candidates")
    start = F.col("pos") - F.col("offset")
    fits = (start >= F.col("low")) & (start + F.col("n") <= F.col("n_words"))
    verified = F.array_join(F.slice(F.split("near", " "), start - F.col("low") + 1, F.col("n")), " ") == F.col("window")
    hits = (
        found.select("doc_id", ROW_KEY, "n_words", F.inline("found"))
        .join(prefixes, "sh")
        .where(fits)
        .where(verified)
        .select("doc_id", ROW_KEY, "window", start.alias("begin"), (start + F.col("n")).alias("end"))
    )
    hits, _ = materialise(hits, "hits")
    spans = hits.groupBy("doc_id", ROW_KEY).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    named = (
        hits.select("doc_id", ROW_KEY, "window")
        .distinct()
        .join(items.select("window", "item_id").distinct(), "window")
        .groupBy("doc_id", ROW_KEY)
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    keys = ["doc_id", ROW_KEY]
    per_doc = join_same(spans, named, keys)
    return join_same(found.select("doc_id", ROW_KEY, "n_words"), per_doc, keys, "left").select(
        "doc_id",
        ROW_KEY,
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Number of word positions in the union of sorted ranges."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("reach"))

    def add(acc, span):
        begin = F.greatest(acc["reach"], span["begin"].cast("bigint"))
        more = F.greatest(F.lit(0).cast("bigint"), span["end"].cast("bigint") - begin)
        reach = F.greatest(acc["reach"], span["end"].cast("bigint"))
        return F.struct((acc["total"] + more).alias("total"), reach.alias("reach"))

    return F.aggregate(spans, zero, add, lambda acc: acc["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, row key, n_words, n_hit, items, spans, contaminated."""
    n_hit = covered(F.col("spans"))
    return overlaps(docs, benchmark, size).select(
        "doc_id", ROW_KEY, "n_words", n_hit.alias("n_hit"), "items", "spans", (n_hit > 0).alias("contaminated")
    )
