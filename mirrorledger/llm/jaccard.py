"""N-gram Jaccard join by chosen paths: every pair of documents whose word shingles agree by ``threshold`` or more.

In each run a record follows one path: at every level one randomly chosen hash function samples one of its shingles, and
records that share the sampled shingle stay together. Two sets of similarity s share a sample with probability s, so a
path of ``depth`` levels keeps a pair at the threshold together with probability ``threshold ** depth`` or more; runs are
repeated until the miss probability is below ``1 - recall``. Only buckets of more than ``leaf`` records are split further.
Small buckets, and blocks of those that are still large after the last level, are compared all against all inside a task:
first by the samples themselves, then exactly on the whole shingle sets. A pair counts in the first run that brings it
together, so no pair list is ever written: a task returns for each record its number of links and the smallest record it
is connected to, and star contraction joins these to classes.

Documents with equal shingle sets are one record throughout, however many they are. Texts of fewer than five but at least
one word have one shingle, all their words. Texts without words (null counts as empty) are records by equal text and link
to nothing else. Repeated rows are copies of each other. A class without any non-null id has a null class id. Empty tables
give empty results. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..workspace import materialise
from .components import components
from .rows import ROW_KEY, keyed, unsent
from .wordbytes import Words, mix, sliced, utf8, window_hash

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
LEAF = 1000
SLACK = 5.0  # standard deviations of sample agreement below the threshold's that still get an exact comparison


def runs_for(threshold: float, recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, sorted within each row, and where each row's begin (rows + 1 entries)."""
    hashes, doc = words.hashes, words.doc
    found, whose = window_hash(hashes, size), doc[: max(0, len(doc) - size + 1)]
    whole = whose == doc[size - 1 :] if len(found) else np.zeros(0, bool)
    found, whose = found[whole], whose[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        own = [window_hash(hashes[words.first[r] : words.first[r + 1]], int(words.counts[r]))[0] for r in short.tolist()]
        found, whose = np.concatenate([found, np.array(own, np.uint64)]), np.concatenate([whose, short])
    order = np.lexsort((found, whose))
    found, whose = found[order], whose[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
    found, whose = found[fresh], whose[fresh]
    return found, np.searchsorted(whose, np.arange(words.rows + 1))


def _per_row(values: np.ndarray, edges: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    out = np.full(len(edges) - 1, empty, values.dtype)
    filled = np.flatnonzero(np.diff(edges))
    if len(filled):
        out[filled] = ufunc.reduceat(values, edges[filled])
    return out


def signatures(rows: DataFrame, size: int, samples: int) -> DataFrame:
    """doc_id, row key, fp (16 bytes that name the shingle set), n (its size), mins (its sampled shingles' hashes)."""
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {ROW_KEY} bigint, fp binary, n int, mins array<int>"
    seeds = mix(np.arange(1, 2 * samples + 3, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                found, edges = shingle_sets(Words(piece.column("text")), size)
                n = np.diff(edges)
                name = np.stack([_per_row(mix(found ^ s), edges, np.add, 0) for s in seeds[-2:]], axis=1)
                name[:, 1] += n.astype(np.uint64)
                names = [row.tobytes() for row in name]
                empty = np.flatnonzero(n == 0).tolist()
                if empty:
                    data, offsets = utf8(piece.column("text"))
                    for r in empty:
                        own = data[offsets[r] : offsets[r + 1]].tobytes()
                        names[r] = hashlib.blake2b(own, digest_size=16).digest()
                mins = np.empty((len(n), samples), np.uint32)
                for k in range(samples):
                    drawn = ((found * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]) >> np.uint64(32)).astype(np.uint32)
                    mins[:, k] = _per_row(drawn, edges, np.minimum, 0)
                flat = pa.array(mins.view(np.int32).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column(ROW_KEY),
                        pa.array(names, pa.binary()),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * samples, pa.int32()), flat),
                    ],
                    names=["doc_id", ROW_KEY, "fp", "n", "mins"],
                )

    return rows.mapInArrow(sign, schema)


def _leaves(records: DataFrame, count: int, runs: int, depth: int, leaf: int) -> DataFrame:
    """id, run, node, members: the bucket in which each record ends in each run, if it is not alone there."""
    level = records.where("n > 0").select(
        "id",
        F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"),
        F.col("mins"),
    )
    level = level.select("id", "run", F.slice("mins", F.col("run") * depth + 1, depth).alias("path"))
    level = level.select("id", "run", "path", F.xxhash64("run", F.col("path")[0]).alias("node"))
    done, left = None, count * runs
    for k in range(depth):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        rows, left = materialise(level.join(unsent(sizes, left), "node"), f"level{k}")
        ended = rows if k == depth - 1 else rows.where(F.col("members") <= leaf)
        ended = ended.select("id", "run", "node", "members")
        done = ended if done is None else done.unionByName(ended)
        if k < depth - 1:
            level = rows.where(F.col("members") > leaf).select(
                "id", "run", "path", F.xxhash64("node", F.col("path")[k + 1]).alias("node")
            )
    return done


def _bucket_rows(records: DataFrame, count: int, leaves: DataFrame, runs: int, leaf: int) -> DataFrame:
    """A row for each record and group of records that one task compares, with what tells whether a pair is new here."""
    paths = leaves.groupBy("id").agg(F.collect_list(F.struct("run", "node", "members")).alias("ends"))
    where = F.map_from_entries(F.transform("ends", lambda e: F.struct(e["run"], e["node"])))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(where[r], F.lit(0).cast("bigint")))
    rows = (
        paths.withColumn("nodes", nodes)
        .join(unsent(records.select("id", "copies", "mins"), count), "id")
        .select("id", "copies", "mins", "nodes", F.inline("ends"))
    )
    blocks = F.ceil(F.col("members") / leaf).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("bigint")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(
        F.xxhash64("node", low, high).alias("bucket"),
        "id", "copies", "run", "node", "nodes", "mins",
        F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2).alias("side"),
    )


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000, size: int = 64 << 20) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut anew so that no group is divided, in tables of about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str, kind) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy().astype(kind).reshape(table.num_rows, -1)


def _pairs(table: pa.Table, agreed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one bucket that no earlier run brought together and whose samples agree often enough."""
    bucket, side, run = (table.column(c).to_numpy() for c in ("bucket", "side", "run"))
    node, nodes, mins = table.column("node").to_numpy(), _matrix(table, "nodes", np.int64), _matrix(table, "mins", np.int32)
    earlier = np.arange(nodes.shape[1])[None, :] < run[:, None]
    for step in range(1, table.num_rows):
        i = np.flatnonzero(bucket[:-step] == bucket[step:])
        if not len(i):
            return
        i = i[(node[i] == node[i + step]) & ((side[i] == 0) | (side[i] != side[i + step]))]
        met = ((nodes[i] == nodes[i + step]) & (nodes[i] != 0) & earlier[i]).any(axis=1)
        i = i[~met]
        i = i[(mins[i] == mins[i + step]).sum(axis=1) >= agreed]
        if len(i):
            yield i, i + step


def _with_partner(rows: DataFrame, agreed: int) -> DataFrame:
    """The bucket rows that have at least one pair to compare exactly."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            paired = np.zeros(table.num_rows, bool)
            for i, j in _pairs(table, agreed):
                paired[i] = paired[j] = True
            yield from table.filter(pa.array(paired)).combine_chunks().to_batches()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, rows.schema)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, by bit sets over the shingles that more than one set has."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(seen > 1)
    column = np.full(len(values), -1)
    column[common] = np.arange(len(common))
    column = column[at]
    total = np.zeros(len(i), np.int64)
    for a in range(0, len(common), 8192):
        inside = (column >= a) & (column < a + 8192)
        bits = np.zeros((len(sets), min(8192, -(-(len(common) - a) // 64) * 64)), bool)
        bits[owner[inside], column[inside] - a] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for b in range(0, len(i), 20_000):
            k = slice(b, b + 20_000)
            total[k] += np.bitwise_count(packed[i[k]] & packed[j[k]]).sum(axis=1, dtype=np.int64)
    return total


def _compare(rows: DataFrame, threshold: float, agreed: int) -> DataFrame:
    """id, links (documents in linked records), root (smallest record it is connected to here)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            found = list(_pairs(table, agreed))
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket, ids, copies = (table.column(c).to_numpy() for c in ("bucket", "id", "copies"))
            shingles = table.column("shingles").combine_chunks()
            order = np.argsort(bucket[i], kind="stable")
            i, j = i[order], j[order]
            good = np.zeros(len(i), bool)
            cuts = np.flatnonzero(np.diff(bucket[i])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
                used, k = np.unique(np.concatenate([i[a:b], j[a:b]]), return_inverse=True)
                sets = [np.frombuffer(shingles[x].as_buffer(), np.uint64) for x in used.tolist()]
                sizes = np.array([len(s) for s in sets])
                x, y = k[: b - a], k[b - a :]
                both = _shared(sets, x, y)
                good[a:b] = both / (sizes[x] + sizes[y] - both) >= threshold
            i, j = i[good], j[good]
            links = np.zeros(table.num_rows, np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = ids.copy()
            while len(i):
                low = np.minimum(root[i], root[j])
                if (root[i] == low).all() and (root[j] == low).all():
                    break
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
            linked = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[linked]), pa.array(links[linked]), pa.array(root[linked])], names=["id", "links", "root"]
            )

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        verify, "id bigint, links bigint, root bigint"
    )


def _sets(records: DataFrame, rows: DataFrame, n_rows: int, wanted: DataFrame, size: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the wanted records, from one document of each."""
    source = wanted.join(unsent(records.select("id", "sample.*"), n_rows), "id").select(
        "id", F.col("doc_id").alias("__id"), F.col(ROW_KEY).alias("__key")
    )
    on = rows["doc_id"].eqNullSafe(source["__id"]) & (rows[ROW_KEY] == source["__key"])
    texts = rows.join(unsent(source, n_rows), on).select("id", "text").dropDuplicates(["id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                found, edges = shingle_sets(Words(piece.column("text")), size)
                sets = [found[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return texts.mapInArrow(cut, "id bigint, shingles binary")


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    recall: float = RECALL,
    depth: int = DEPTH,
    leaf: int = LEAF,
) -> DataFrame:
    """One row per document: doc_id, row key, class_id (smallest doc_id of its class), class_key, n_links, n_copies,
    n_shingles. A class is a connected group; n_links counts the documents of similarity ``threshold`` or more to this
    one, n_copies those of equal shingles."""
    runs = runs_for(threshold, recall, depth)
    samples = runs * depth
    agreed = max(1, math.floor(samples * threshold - SLACK * math.sqrt(samples * threshold * (1 - threshold))))
    rows = keyed(docs)
    signed, n_rows = materialise(signatures(rows, size, samples), "signatures")
    records = signed.groupBy("fp").agg(
        F.min("doc_id").alias("low"),
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("doc_id", ROW_KEY)).alias("sample"),
        F.first("n").alias("n"),
        F.first("mins").alias("mins"),
    )
    records, count = materialise(records.withColumn("id", F.monotonically_increasing_id()), "records")
    leaves, _ = materialise(_leaves(records, count, runs, depth, leaf), "leaves")
    active, _ = materialise(_with_partner(_bucket_rows(records, count, leaves, runs, leaf), agreed), "active")
    sets = _sets(records, rows, n_rows, active.select("id").distinct(), size)
    linked, _ = materialise(_compare(active.join(sets.hint("merge"), "id"), threshold, agreed), "linked")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    stars = components(linked.where("root < id").select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = (
        records.select("id", "fp", "low", "copies", "n")
        .join(unsent(stars.select(F.col("u").alias("id"), F.col("v").alias("star")), count), "id", "left")
        .join(unsent(links, count), "id", "left")
        .withColumn("class_key", F.coalesce("star", "id"))
    )
    named, _ = materialise(named, "named")
    lows = named.groupBy("class_key").agg(F.min("low").alias("class_id"))
    results = named.join(unsent(lows, count), "class_key").select(
        "fp", "class_id", "class_key", "copies", "n", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    found = lookup(
        signed.select("doc_id", ROW_KEY, "fp"), unsent(results, n_rows), ["fp"], spread_by=F.col("doc_id"), left_rows=n_rows, how="inner"
    )
    return found.select(
        "doc_id",
        ROW_KEY,
        "class_id",
        "class_key",
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
        F.col("n").cast("bigint").alias("n_shingles"),
    )


def representatives(found: DataFrame) -> DataFrame:
    """One (doc_id, row key) for each class: its smallest id."""
    first = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)).alias("r"))
    return first.select("r.doc_id", f"r.{ROW_KEY}")
