"""MinHash near-duplicate removal by tensored banding: documents whose word shingles agree by 85 percent or more.

Two small collections of ``KEYS`` keys are made for each shingle set, each key of ``HASHES`` minhashes. A table is named by
one key of either collection, so ``KEYS ** 2`` tables of ``2 * HASHES`` minhashes each come from ``2 * KEYS * HASHES``
minhashes instead of ``KEYS ** 2 * 2 * HASHES``: here 144 tables from 72 minhashes instead of 864. Two sets share a table
if they share a key of the first and a key of the second collection, which sets of similarity 0.85 miss with a probability
of ``2 * (1 - 0.85 ** 3) ** 12``, about 2 in 100 000. A key that only one set has leads nowhere, so only sets with a shared
key in both collections are put into tables; for most documents no table row is ever written.

Sets that share a table are linked to the table's smallest one, and the components of these links are clusters. A cluster
is compared in tiles inside tasks: pairs that share a table and are not yet connected are verified on their full sets. A
set is sent once (to a cluster's one tile) or, in a cluster too large for a tile, once for each pair of blocks, however
many tables it shares; no list of pairs is written. Tasks return for each set the smallest one it is connected to, and
star contraction joins these to components.

Words are the runs without white space of the lower-cased (A-Z) text; a set is a document's distinct five-word shingles, or
all its words if they are fewer. Documents with equal sets are one record throughout, however many they are. A text without
words (null too) has no set and is linked with nothing. Repeated rows are copies of each other. A component's id is its
smallest non-null ``doc_id``, null if there is none; ``kept`` holds for rows whose id is that (null for null). A text of any
length is read whole; its set is in memory in one task. Empty tables give empty results. Only ``doc_id`` and ``text`` are
read, so other columns may have any name.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..workspace import materialise
from .components import components
from .jaccard import shingle_sets, whole_groups
from .rows import ROW_KEY, hash_filter, keyed, passes
from .wordbytes import Words, all_but, mix, sliced

SHINGLE = 5
PERCENT = 85
KEYS = 12
HASHES = 3
TILE_ROWS = 1000
TILE_SHINGLES = 2_000_000
CHECKED = 5000  # pairs that are verified together before those between connected sets are left out
FILTER_BITS = 22

_IS_WORD = all_but(b" \t\n\x0b\x0c\r")


def _least(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros(len(edges) - 1, values.dtype)
    filled = np.flatnonzero(np.diff(edges))
    if len(filled):
        out[filled] = np.minimum.reduceat(values, edges[filled])
    return out


def collection_keys(found: np.ndarray, edges: np.ndarray, keys: int, hashes: int) -> np.ndarray:
    """For each set the keys of both collections, one row of ``2 * keys``."""
    seeds = mix(np.arange(1, 4 * keys * hashes + 1, dtype=np.uint64))
    out = np.zeros((len(edges) - 1, 2 * keys), np.uint64)
    for k in range(2 * keys):
        for h in range(hashes):
            at = 2 * (k * hashes + h)
            drawn = ((found * (seeds[at] | np.uint64(1)) + seeds[at + 1]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = mix(out[:, k] + _least(drawn, edges).astype(np.uint64) + np.uint64(1))
    return out


def signatures(rows: DataFrame, size: int, keys: int, hashes: int) -> DataFrame:
    """doc_id, row key, fp (16 bytes that name the set, null without words), n (its size), keys of both collections."""
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {ROW_KEY} bigint, fp binary, n bigint, keys array<bigint>"
    names = mix(np.array([3, 5], np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                found, edges = shingle_sets(Words(piece.column("text"), _IS_WORD), size)
                n = np.diff(edges)
                sums = np.zeros((2, len(found) + 1), np.uint64)
                for k in range(2):
                    np.cumsum(mix(found ^ names[k]), out=sums[k, 1:])
                name = (sums[:, edges[1:]] - sums[:, edges[:-1]]).T.copy()
                name[:, 1] += n.astype(np.uint64)
                flat = pa.array(collection_keys(found, edges, keys, hashes).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * keys, pa.int32()), flat)
                fp = pa.array([row.tobytes() if k else None for row, k in zip(name, n.tolist(), strict=True)], pa.binary())
                columns = [piece.column("doc_id"), piece.column(ROW_KEY), fp, pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", ROW_KEY, "fp", "n", "keys"])

    return rows.mapInArrow(sign, schema)


def table_rows(records: DataFrame, n_records: int, keys: int) -> DataFrame:
    """id, bucket: the tables of each record that has a shared key in either collection, from its shared keys alone."""
    slots = F.transform("keys", lambda k, i: F.struct(i.alias("slot"), k.alias("key")))
    each = records.select("id", F.inline(slots))
    shared = each.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("slot", "key")
    each = lookup(each, shared, ["slot", "key"], spread_by=F.col("id"), left_rows=n_records * 2 * keys, how="left_semi")
    own = each.groupBy("id").agg(F.collect_list(F.struct("slot", "key")).alias("own"))
    first, second = F.filter("own", lambda s: s["slot"] < keys), F.filter("own", lambda s: s["slot"] >= keys)
    tables = F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b)))
    return own.select("id", F.explode(F.flatten(tables)).alias("bucket"))


def clusters(records: DataFrame, n_records: int, keys: int) -> DataFrame:
    """id, cluster: records connected by shared tables, those connected to another one."""
    rows, n_rows = materialise(table_rows(records, n_records, keys), "tables")
    least = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    links = lookup(rows, least, ["bucket"], spread_by=F.col("id"), left_rows=n_rows, how="inner")
    links = links.where("id > low").select(F.col("id").alias("u"), F.col("low").alias("v"))
    found = components(links)
    return found.select(F.col("u").alias("id"), F.col("v").alias("cluster")).unionByName(
        found.select(F.col("v").alias("id"), F.col("v").alias("cluster")).distinct()
    )


def texts_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The columns of ``members`` (id, sample, ...) with the text of each one's sample. A bit set of fixed size keeps most
    other texts out of the shuffle."""
    known = rows.sparkSession.sparkContext.broadcast(hash_filter(members.select(F.xxhash64("sample.*").alias("h")), "h", FILTER_BITS))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(known.value, batch.column("h").to_numpy().view(np.uint64))))

    hashed = rows.withColumn("h", F.xxhash64("doc_id", ROW_KEY))
    likely = hashed.mapInArrow(screen, hashed.schema)
    wanted = members.withColumns({"__id": F.col("sample.doc_id"), "__key": F.col(f"sample.{ROW_KEY}")}).drop("sample")
    on = likely["doc_id"].eqNullSafe(wanted["__id"]) & (likely[ROW_KEY] == wanted["__key"])
    return likely.join(wanted, on).select(*(c for c in wanted.columns if c[:2] != "__"), "text").dropDuplicates(["id"])


def tiles(rows: DataFrame, records: DataFrame, found: DataFrame) -> DataFrame:
    """tile, side, id, keys, text: a row for each record of a cluster and pair of blocks in which it is compared."""
    members = found.join(records.select("id", "n", "keys", "sample"), "id")
    members, _ = materialise(members, "members")
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks")
    )
    texts = texts_of(rows, members)
    spread = texts.join(sizes, "cluster")
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int")
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    return spread.select(F.xxhash64("cluster", low, high).alias("tile"), side.alias("side"), "id", "keys", "text")


class _Groups:
    """Connected sets of rows; the smallest row names a group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.top(x), self.top(y)
            if a != b:
                self.root[max(a, b)] = min(a, b)
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]


def _agree(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets are similar enough, by exact intersections."""
    good = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = sets[x], sets[y]
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            continue
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int(np.count_nonzero(b[at] == a))
        good[k] = 100 * both >= percent * (len(a) + len(b) - both)
    return good


def connect(tile: np.ndarray, side: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each row the first row of its tile that it is connected to. ``keys`` has both collections, half of the columns each."""
    groups, half = _Groups(len(tile)), keys.shape[1] // 2
    held, n_held = [], 0

    def check() -> None:
        nonlocal held, n_held
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        held, n_held = [], 0
        apart = groups.root[i] != groups.root[j]
        i, j = i[apart], j[apart]
        good = _agree(sets, i, j, percent)
        groups.join(i[good], j[good])

    for step in range(1, len(tile)):
        i = np.flatnonzero(tile[:-step] == tile[step:])
        if not len(i):
            break
        i = i[((side[i] == 0) | (side[i] != side[i + step])) & (groups.root[i] != groups.root[i + step])]
        for begin in range(0, len(i), CHECKED):
            x = i[begin : begin + CHECKED]
            same = keys[x] == keys[x + step]
            x = x[same[:, :half].any(axis=1) & same[:, half:].any(axis=1)]
            if len(x):
                held.append((x, x + step))
                n_held += len(x)
                if n_held >= CHECKED:
                    check()
    if held:
        check()
    return groups.root


def verified(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """id, root: records connected to a smaller one of their tile by links verified on full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            sets: list[np.ndarray] = []
            for batch in table.select(["text"]).to_batches():
                for piece in sliced(batch):
                    found, edges = shingle_sets(Words(piece.column("text"), _IS_WORD), size)
                    sets += [found[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            tile, side, ids = (table.column(c).to_numpy() for c in ("tile", "side", "id"))
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            root = connect(tile, side, keys, sets, percent)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["id", "root"])

    dealt = rows.repartition("tile").sortWithinPartitions("tile", "id")
    return dealt.mapInArrow(verify, "id bigint, root bigint")


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, keys: int = KEYS, hashes: int = HASHES
) -> DataFrame:
    """One row per document: doc_id, row key, n_shingles, component_id, kept."""
    rows = keyed(docs)
    signed, n_rows = materialise(signatures(rows, size, keys, hashes), "signatures")
    records = signed.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("low"),
        F.min(F.struct("doc_id", ROW_KEY)).alias("sample"),
        F.first("n").alias("n"),
        F.first("keys").alias("keys"),
    )
    records, n_records = materialise(records.withColumn("id", F.monotonically_increasing_id()), "records")
    found, _ = materialise(clusters(records, n_records, keys), "clusters")
    linked, _ = materialise(verified(tiles(rows, records, found), size, percent), "linked")
    links = linked.select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v"))
    stars = components(links).select(F.col("u").alias("id"), F.col("v").alias("star"))
    named = records.select("id", "fp", "low").join(stars, "id", "left").withColumn("star", F.coalesce("star", "id"))
    named, n_named = materialise(named, "named")
    lows = named.groupBy("star").agg(F.min("low").alias("component_id"))
    ids = lookup(named, lows, ["star"], spread_by=F.col("id"), left_rows=n_named, how="inner").select("fp", "component_id")
    keyed_rows = signed.select("doc_id", ROW_KEY, "n", "fp")
    result = lookup(keyed_rows, ids, ["fp"], spread_by=F.col("doc_id"), left_rows=n_rows, how="left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    result = result.select("doc_id", ROW_KEY, F.col("n").alias("n_shingles"), component.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
