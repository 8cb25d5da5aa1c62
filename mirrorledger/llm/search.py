"""Exact top-k search by BM25 over an inverted index with block-max dynamic pruning.

The index is built in one pass: each task writes shards of up to ``SHARD_DOCS`` documents, with for each term its postings
(document in the shard, frequency) in document order, in the shortest numbers that hold them. Within a shard similar documents
get neighbouring numbers, and numbers fall into blocks of ``BLOCK_DOCS``.

A query's terms are parted by their upper bounds (block-max MaxScore). The lists of the rare terms, whose bounds are high,
are added up; for the frequent ones only their maxima in each block are taken at first. Together they bound each document's
score, and the frequent terms are looked at only for documents whose bound reaches the k-th best score known (in blocks that
are open to one of a group of queries, by a matrix product for the group, so queries with the same frequent terms go together). That is the
best of this shard, of those the task has searched before, and of earlier rounds: one part of the index in ``PARTS`` is
searched first, then three, then the rest, and after a round the k-th best score of each query so far is its floor in the
next. So how many rows a task sends on falls with the number of shards, and the k best over all shards are exact: a
document is left out only if k others score higher. Document frequencies, number and mean length of documents are those of
the whole collection, so scores of different shards compare.

Queries are whole texts (their distinct words). They are worked off in blocks of about ``BLOCK_TERMS`` terms, the only part
of them that is broadcast, against all shards.

Scores are sums over the shared terms of idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)) with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), in an order that is the same in all shards; equal scores rank by id, nulls
first, and then by row key. A document without words has no score and is never found; a query without words finds nothing. A null id is never
a query. Repeated rows are found as often as they occur; a repeated query row is one query. Empty tables give empty
results. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import materialise, new_path
from .rows import ROW_KEY, hash_filter, keyed, passes
from .wordbytes import HASHED_BYTES, Words, sliced

K1, B = 1.2, 0.75
K = 10
SHARD_DOCS = 10_000
SHARD_POSTINGS = 2_500_000
BLOCK_DOCS = 16
BLOCK_TERMS = 2_000_000
ALIKE = 32  # frequent terms that decide which documents are alike
FREQUENT_ROWS = 1024  # most terms of a query block that are laid out for all documents of a shard
FREQUENT_SHARE = 1 / 32  # and the share of all documents that such a term must be in
SLACK = 1 + 1e-4  # for bounds, which are added up in another order and in part in short numbers
GROUP = 128  # queries searched together in a shard
GROUPED = 4096  # queries of a block among which those of a group are chosen
SHARE_DOCS = 1024  # documents whose frequent terms are added up at a time
SHARE_BLOCKS = 128  # blocks whose bounds are worked out at a time for all queries of a group
ADDED_POSTINGS = 1 << 16  # postings that are worked out at a time
COUNTED_SHARDS, COUNTED_TERMS = 16, 4_000_000  # shards a task counts document frequencies of, and terms it holds
PARTS = 16
ROUNDS = ((0, 0), (1, 3), (4, PARTS - 1))  # parts of the index searched in each round


def _postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of each distinct word of each row."""
    hashes, doc = words.hashes, words.doc
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(fresh)
    return d[at].astype(np.int32), h[at], np.diff(np.append(at, len(h))).astype(np.int32)


def _shortest(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the shortest unsigned type that holds all of them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _binary(numbers: np.ndarray) -> pa.Array:
    """A row of one binary value, without another copy of it."""
    offsets = pa.py_buffer(np.array([0, numbers.nbytes], np.int32))
    return pa.Array.from_buffers(pa.binary(), 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(numbers))])


def _stored(binary, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_shortest``; how long one is follows from the bytes."""
    return np.frombuffer(binary, f"u{memoryview(binary).nbytes // n}") if n else np.zeros(0, np.uint8)


def _renumbered(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """New numbers that put documents side by side whose most used frequent word is the same, by length. ``term``: numbers."""
    seen = np.bincount(term)
    common = np.argsort(-seen, kind="stable")[:ALIKE]
    place = np.full(len(seen), -1)
    place[common] = np.arange(len(common))
    at = np.flatnonzero(place[term] >= 0)
    at = at[np.argsort(tf[at], kind="stable")]  # the last one written is the most used
    kind = np.full(len(lengths), len(common))
    kind[doc[at]] = place[term[at]]
    number = np.empty(len(lengths), np.uint32)
    number[np.lexsort((lengths, kind))] = np.arange(len(lengths))
    return number


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: docs (ids and row keys by number), lengths, terms, first (of each term's postings), posted, tfs."""
    rows = keyed(docs)
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"ids array<{kind}>, row_keys array<bigint>, part int, n bigint, words bigint, lengths binary, terms binary, first binary, posted binary, tfs binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = n = 0
        # One part for all shards of a task, so that a file of the index is read in one round only.
        part = TaskContext.get().partitionId() % PARTS

        def shard() -> pa.RecordBatch:
            ids = pa.chunked_array([p[0] for p in held]).combine_chunks()
            keys = pa.chunked_array([p[1] for p in held]).combine_chunks()
            lengths = np.concatenate([p[5] for p in held])
            base = np.cumsum([0, *(len(p[0]) for p in held)])
            terms = np.unique(np.concatenate([np.unique(p[3]) for p in held]))
            doc, term = np.empty(size, np.uint32), np.empty(size, np.uint32)
            tf, at = np.empty(size, np.uint32), 0
            for k in range(len(held)):  # part by part, each let go as soon as it is taken over
                piece, held[k] = held[k], None
                some = slice(at, at + len(piece[2]))
                doc[some], term[some], tf[some] = piece[2] + base[k], np.searchsorted(terms, piece[3]), piece[4]
                at = some.stop
            number = _renumbered(doc, term, tf, lengths)
            back = np.argsort(number)
            doc = number[doc]
            first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
            key = term.astype(np.uint64)
            del term
            key <<= np.uint64(32)
            key |= doc
            order = np.argsort(key)
            del key
            doc, tf = _shortest(doc)[order], _shortest(tf)[order]
            del order
            ids, keys = ids.take(pa.array(back)), keys.take(pa.array(back))
            offsets = pa.array([0, len(ids)], pa.int32())
            binaries = lengths[back].astype(np.uint32), terms, first.astype(np.int64), doc, tf
            columns = [pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, keys)]
            columns += [pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
            columns += [_binary(b) for b in binaries]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for piece in sliced(batch, limit=HASHED_BYTES):
                words = Words(piece.column("text"))
                doc, term, tf = _postings(words)
                own = pa.array(np.arange(piece.num_rows))  # taken over, since a slice would keep the whole batch with its texts
                ids, keys = piece.column("doc_id").take(own), piece.column(ROW_KEY).take(own)
                held.append((ids, keys, doc, term, tf, words.counts))
                size, n = size + len(doc), n + piece.num_rows
                if n >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield shard()
                    held, size, n = [], 0, 0
        if held:
            yield shard()

    return rows.mapInArrow(build, schema)


def query_terms(queries: DataFrame) -> DataFrame:
    """doc_id, row key and terms (distinct hashes, sorted) of each distinct query row that has words."""
    rows = keyed(queries).dropDuplicates(["doc_id", ROW_KEY])
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {ROW_KEY} bigint, terms array<bigint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, limit=HASHED_BYTES):
                doc, term, _ = _postings(Words(piece.column("text")))
                edges = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(edges), pa.array(term.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column(ROW_KEY), terms], names=["doc_id", ROW_KEY, "terms"]
                )

    return rows.mapInArrow(cut, schema).where(F.size("terms") > 0)


def document_frequencies(index: DataFrame, wanted: np.ndarray, shards: int) -> DataFrame:
    """Documents of each term that passes the filter, over all shards: term, df.

    A task takes several shards and adds them up before it sends anything, holding at most about ``COUNTED_TERMS`` terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            counts = np.concatenate([d for _, d in held])
            total = np.zeros(len(terms), np.int64)
            np.add.at(total, at, counts)
            return terms, total

        def rows() -> Iterator[pa.RecordBatch]:
            terms, df = added()
            for a in range(0, len(terms), 100_000):
                some = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(df[some])], names=["term", "df"])

        for batch in batches:
            for terms, first in zip(batch.column(0), batch.column(1), strict=True):
                terms = np.frombuffer(terms.as_buffer(), np.uint64)
                df = np.diff(np.frombuffer(first.as_buffer(), np.int64))
                ok = passes(wanted, terms)
                held.append((terms[ok], df[ok]))
                if sum(len(t) for t, _ in held) > COUNTED_TERMS:
                    held = [added()]
                    if len(held[0][0]) > COUNTED_TERMS // 2:
                        yield from rows()
                        held = []
        if held:
            yield from rows()

    tasks = max(index.sparkSession.sparkContext.defaultParallelism, shards // COUNTED_SHARDS)
    counted = index.select("terms", "first").coalesce(tasks).mapInArrow(count, "term bigint, df bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """One shard in memory, with contributions and the block maxima of its frequent terms.

    ``frequent``: the terms of low upper bound, whose frequencies and contributions are laid out for all documents, a row
    each; their postings are let go. Where ``vocabulary`` (term hashes) is given, queries name their other terms by places in
    it, which are looked up once for all queries, and postings of terms outside it are let go too. Of ``offered`` blocks
    (over all queries) ``scored`` were open to their query for more than maxima.
    """

    scored = offered = 0

    def __init__(self, row: dict, mean_length: float, frequent: np.ndarray, vocabulary: np.ndarray | None = None):
        self.terms, self.first = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["first"], np.int64)
        self.posted, tfs = (_stored(row[c], int(self.first[-1])) for c in ("posted", "tfs"))
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.float64)
        self.n = len(lengths)
        self.norm = K1 * (1 - B + B * lengths / mean_length)
        self.blocks = -(-self.n // BLOCK_DOCS)
        self.tfs = np.zeros((len(frequent), self.blocks * BLOCK_DOCS), tfs.dtype)
        self.short = np.zeros(self.tfs.shape, np.float32)
        at, known = self._found(frequent)
        for k in np.flatnonzero(known).tolist():
            some = slice(self.first[at[k]], self.first[at[k] + 1])
            posted, tf = self.posted[some], tfs[some]
            self.tfs[k, posted] = tf
            self.short[k, posted] = tf * (K1 + 1) / (tf + self.norm[posted])
        self.short = self.short.reshape(len(frequent), self.blocks, BLOCK_DOCS)
        self.row_max = _block_maxima(self.short)
        if len(frequent) or vocabulary is not None:
            wanted = np.full(len(self.terms), vocabulary is None)
            if vocabulary is not None:
                own, has = self._found(vocabulary)
                wanted[own[has]] = True
            wanted[at[known]] = False
            sizes = np.diff(self.first)
            kept = np.repeat(wanted, sizes)
            self.posted, tfs = self.posted[kept], tfs[kept]
            self.first = np.concatenate([[0], np.cumsum(sizes * wanted)])
        self.impact = np.empty(len(tfs))
        for a in range(0, len(tfs), ADDED_POSTINGS):
            some = slice(a, a + ADDED_POSTINGS)
            tf = tfs[some].astype(np.float64)
            self.impact[some] = tf * (K1 + 1) / (tf + self.norm[self.posted[some]])
        self.lists = None if vocabulary is None else self._lists(vocabulary)

    def _found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return at, self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)

    def _lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of each term begin, and how many there are."""
        at, known = self._found(terms)
        return (self.first[at], np.diff(self.first)[at] * known) if len(self.terms) else (at, np.zeros(len(terms), np.int64))

    def _frequent_share(self, docs: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the frequent terms add to the scores of ``docs``, term by term in their order (bincount adds in turn)."""
        out = [np.zeros(0)]
        for a in range(0, len(docs), SHARE_DOCS):
            some = docs[a : a + SHARE_DOCS]
            tf = self.tfs[rows[:, None], some].astype(np.float64)
            values = tf * (K1 + 1) / (tf + self.norm[some]) * weights[:, None]
            out.append(np.bincount(np.tile(np.arange(len(some)), len(rows)), values.ravel(), minlength=len(some)))
        return np.concatenate(out)

    def _rare_share(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the lists of ``terms`` add to the score of each document."""
        a, n = self._lists(terms) if self.lists is None else (x[terms] for x in self.lists)
        ends = np.cumsum(n)
        # Some terms at a time, posting by posting in the order of the terms, so that sums are the same however they are cut.
        out = np.zeros(self.blocks * BLOCK_DOCS) if not len(n) else None
        begin = done = 0
        while begin < len(n):
            end = max(begin + 1, int(np.searchsorted(ends, ADDED_POSTINGS + done, "right")))
            size = n[begin:end]
            postings = np.repeat(a[begin:end] - ends[begin:end] + size + done, size)
            postings += np.arange(len(postings))
            added = self.impact[postings]
            added *= np.repeat(weights[begin:end], size)
            if begin == 0:
                out = np.bincount(self.posted[postings], added, minlength=self.blocks * BLOCK_DOCS)
            else:
                np.add.at(out, self.posted[postings], added)
            begin, done = end, int(ends[end - 1])
        return out

    def top_each(self, wanted: list, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query numbers and scores of at least the ``k`` best documents (all that tie with the k-th), leaving out
        scores below the query's floor.

        A query is its frequent terms (row and weight), its other terms, those of high upper bound, and their weights. The
        lists of the latter are added up; for the frequent terms only their maxima in each block are added at first. Blocks
        stay open while the bound of a document in them reaches the floor, or without one the k-th best sum so far. In the
        blocks that are open to some query of the group the frequent terms that the group has are added for all of them by
        one matrix product in short numbers, again a bound; those that can still be among the best are added up exactly, in
        the order of the terms, so that equal documents score alike.
        """
        pairs = [np.asarray(frequent, float).reshape(-1, 2) for frequent, _, _ in wanted]
        own = [pair[:, 0].astype(np.int64) for pair in pairs]
        rows = np.unique(np.concatenate(own))
        weights = np.zeros((len(wanted), len(rows)), np.float32)
        least, rare = floors.astype(float), np.empty((len(wanted), self.blocks * BLOCK_DOCS))
        for q, (_, terms, term_weights) in enumerate(wanted):
            weights[q, np.searchsorted(rows, own[q])] = pairs[q][:, 1]
            rare[q] = self._rare_share(terms, term_weights)
            if least[q] <= 0:
                least[q] = _kth(rare[q], k)  # contributions are not negative, so k documents score this much at least
        rare = rare.reshape(len(wanted), self.blocks, BLOCK_DOCS)
        bound = (_block_maxima(rare) + weights @ self.row_max[rows]) * SLACK
        is_open = (bound >= least[:, None]) & (bound > 0)
        self.offered += is_open.size
        self.scored += int(is_open.sum())
        used = np.flatnonzero(is_open.any(axis=0))
        shares = np.empty((len(wanted), len(used), BLOCK_DOCS), np.float32)
        for a in range(0, len(used), SHARE_BLOCKS):
            some = used[a : a + SHARE_BLOCKS]
            short = self.short[rows[:, None], some].reshape(len(rows), len(some) * BLOCK_DOCS)
            shares[:, a : a + SHARE_BLOCKS] = (weights @ short).reshape(len(wanted), len(some), BLOCK_DOCS)
        out = []
        for q in range(len(wanted)):
            mine = np.flatnonzero(is_open[q, used])
            bound = (rare[q, used[mine]] + shares[q, mine]).ravel() * SLACK
            at = np.flatnonzero((bound >= least[q]) & (bound > 0))
            if len(at) > k:
                least[q] = max(least[q], _kth(bound[at], k) / SLACK**2)
                at = at[bound[at] >= least[q]]
            docs = used[mine[at // BLOCK_DOCS]] * BLOCK_DOCS + at % BLOCK_DOCS
            scores = rare[q].ravel()[docs]
            if len(own[q]) and len(docs):
                scores = scores + self._frequent_share(docs, own[q], pairs[q][:, 1])
            keep = scores >= max(least[q] / SLACK**2, floors[q], _kth(scores, k))
            out.append((docs[keep], scores[keep]))
        return out

    def top(self, frequent: list, terms: np.ndarray, weights: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """``top_each`` for one query."""
        return self.top_each([(frequent, terms, weights)], k, np.array([least]))[0]


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th best score, 0 where there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else 0.0


def _block_maxima(rows: np.ndarray) -> np.ndarray:
    """The maxima along the last axis; ``max`` takes twice as long for short ones."""
    found = np.maximum.reduceat(rows.ravel(), np.arange(0, rows.size, rows.shape[2])) if rows.size else rows.ravel()
    return found.reshape(rows.shape[:2])


def _grouped(rows: list[np.ndarray], count: int) -> np.ndarray:
    """An order of queries in which ``GROUP`` after ``GROUP`` have much the same frequent terms. ``rows``: those of each query.

    A group is the query with most of them, of ``GROUPED`` queries at a time, and those that are most alike by cosine.
    """
    order = [np.zeros(0, np.int64)]
    for a in range(0, len(rows), GROUPED):
        some = rows[a : a + GROUPED]
        has = np.zeros((len(some), count), np.float32)
        for q, own in enumerate(some):
            has[q, own] = 1 / math.sqrt(max(1, len(own)))
        left = np.lexsort((np.arange(len(some)), [-len(own) for own in some]))
        while len(left):
            alike = np.argsort(-(has[left] @ has[left[0]]), kind="stable")
            order.append(left[alike[:GROUP]] + a)
            left = left[np.sort(alike[GROUP:])]
    return np.concatenate(order)


class _QueryBlock:
    """A block of queries, broadcast for all rounds: the terms and weights of all, and for each query the numbers of its
    frequent terms' rows and the places of its other terms."""

    def __init__(self, spark, block: pa.Table, frequencies: pa.Table, n: int):
        term = frequencies.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        df = frequencies.column("df").to_numpy()[order].astype(float)
        term, idf = term[order], np.log(1 + (n - df + 0.5) / (df + 0.5))
        often = np.lexsort((term, -df))[:FREQUENT_ROWS]
        often = np.sort(often[df[often] > n * FREQUENT_SHARE]).astype(np.int32)
        row = np.full(len(term), -1, np.int32)
        row[often] = np.arange(len(often))
        queries = []
        for terms in block.column("terms"):
            own = np.searchsorted(term, np.sort(terms.values.to_numpy().view(np.uint64))).astype(np.int32)
            queries.append((row[own[row[own] >= 0]], own[row[own] < 0]))
        order = _grouped([rows for rows, _ in queries], len(often))
        self.n = len(queries)
        ids, keys = (block.column(c).combine_chunks().take(pa.array(order)) for c in ("doc_id", ROW_KEY))
        self.shared = spark.sparkContext.broadcast(([queries[q] for q in order.tolist()], term, idf, often, ids, keys))


def _search_round(index: DataFrame, block: _QueryBlock, floors: np.ndarray, mean: float, k: int) -> DataFrame:
    """The best of each task's shards for each query of a block, leaving out scores below the query's floor:
    query_id, query_key, doc_id, doc_key, score and query (its number in the block)."""
    shared, floors = block.shared, index.sparkSession.sparkContext.broadcast(floors)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {kind}, query_key bigint, doc_id {kind}, doc_key bigint, score double, query int"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, vocabulary, idf, often, query_ids, query_keys = shared.value
        # The k best scores of each query so far; the floors stand for scores found in earlier rounds.
        best, least = np.full((len(wanted), k), -np.inf), floors.value.copy()
        kept: list[pa.Table] = []
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                row = {c: one.column(c)[0].as_buffer() for c in ("terms", "first", "posted", "tfs", "lengths")}
                shard = Shard(row, mean, vocabulary[often], vocabulary)
                ids, keys = one.column("ids")[0].values, one.column("row_keys")[0].values
                by_id = pc.sort_indices(pa.table({"i": ids, "k": keys}), [("i", "ascending"), ("k", "ascending")], null_placement="at_start")
                place = np.empty(shard.n, np.int64)
                place[by_id.to_numpy()] = np.arange(shard.n)
                numbers, docs, scores = [], [], []
                for a in range(0, len(wanted), GROUP):
                    some = [(np.stack([own, idf[often[own]]], axis=1), rest, idf[rest]) for own, rest in wanted[a : a + GROUP]]
                    for q, (found, score) in enumerate(shard.top_each(some, k, least[a : a + GROUP]), a):
                        if not len(found):
                            continue
                        first = np.lexsort((place[found], -score))[:k]
                        numbers.append(np.full(len(first), q, np.int32))
                        docs.append(found[first])
                        scores.append(score[first])
                        best[q] = np.sort(np.concatenate([best[q], score[first]]))[-k:]
                        least[q] = max(least[q], best[q, 0])
                if any(map(len, numbers)):
                    at, q = pa.array(np.concatenate(docs)), np.concatenate(numbers)
                    kept.append(pa.table({"q": q, "s": np.concatenate(scores), "i": ids.take(at), "k": keys.take(at)}))
                    kept = [_first_k(kept, least, k)]
                del shard
        for out in kept[0].to_batches(10_000) if kept else ():
            q = out["q"]
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(q), query_keys.take(q), out["i"], out["k"], out["s"], q],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    return index.mapInArrow(search, schema)


def _first_k(found: list[pa.Table], least: np.ndarray, k: int) -> pa.Table:
    """The first ``k`` rows of each query by falling score, id (nulls first) and row key."""
    rows = pa.concat_tables(found)
    rows = rows.filter(pa.array(rows["s"].to_numpy() >= least[rows["q"].to_numpy()]))
    keys = [("q", "ascending"), ("s", "descending"), ("i", "ascending"), ("k", "ascending")]
    rows = rows.take(pc.sort_indices(rows, keys, null_placement="at_start"))
    q = rows["q"].to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k)).combine_chunks()


def _floors(found: DataFrame, n: int, k: int) -> np.ndarray:
    """The k-th best score found so far of each query of a block, 0 where fewer are known."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc()))
    known = found.select("query", "score", rank.alias("rank")).where(F.col("rank") == k).select("query", "score").toArrow()
    floors = np.zeros(n)
    floors[known.column("query").to_numpy()] = known.column("score").to_numpy()
    return floors


def top_k(docs: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The ``k`` best documents of each query row of ``docs``: query_id, query_key, rank, doc_id, score."""
    spark = docs.sparkSession
    index, shards = materialise(build_index(docs), "index")
    totals = index.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    queries, _ = materialise(query_terms(docs.where(is_query)), "queries")
    terms = queries.select(F.explode("terms").alias("term"))
    frequencies, _ = materialise(document_frequencies(index, hash_filter(terms, "term", 24), shards), "frequencies")
    total = queries.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    path = new_path(spark, "found")
    blocks = max(1, math.ceil(total / BLOCK_TERMS))
    number = F.pmod(F.xxhash64("doc_id", ROW_KEY), F.lit(blocks))
    mean = (totals["words"] or 1) / max(1, totals["n"] or 0)
    for b in range(blocks):
        some = queries.where(number == b)
        own = some.select(F.explode("terms").alias("term")).distinct().join(frequencies, "term")
        block = _QueryBlock(spark, some.toArrow(), own.toArrow(), totals["n"] or 0)
        floors = np.zeros(block.n)
        for r, (low, high) in enumerate(ROUNDS):
            found = _search_round(index.where(F.col("part").between(low, high)), block, floors, mean, k)
            found.write.parquet(f"{path}/block={b}/round={r}")
            if r + 1 < len(ROUNDS):
                so_far = [f"{path}/block={b}/round={x}" for x in range(r + 1)]
                floors = _floors(spark.read.schema(found.schema).parquet(*so_far), block.n, k)
        block.shared.destroy()
    best = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "doc_id", "doc_key")
    everything = spark.read.schema(found.schema).parquet(path)
    ranked = everything.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "query_key", "rank", "doc_id", "score")
