"""Order-preserving packing of token streams into windows by dynamic programming.

Documents are tokenized, ended by a separator id and laid end to end in table order. A window may begin and end at a
document's end, at a sentence's end, or, in a stretch of ``stretch`` ids without either, every ``stretch`` ids. Among all
ways to cut, the one with the least total cost is taken: the padding of each window (a window of ``capacity`` ids or of a
power of two has none), a small cost per window, and a penalty for a cut inside a document (more where it is inside a
sentence). With f(j) the least cost of a stream cut at position j, f(j) is the minimum over the positions i at most
``capacity`` before j of f(i) + capacity - (j - i), and i + f(i) in a sliding range is kept in a monotone queue, so each
position costs constant time. Powers of two are looked up one by one.

Each task packs its own part of the table, in blocks of bounded size; the window open at the end of a block goes on in the
next. So nothing is shuffled and only one window per task ends early.

A null text is empty and has only its separator. Repeated documents are packed as often as they occur. Empty tables give
no pieces. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import load
from .wordbytes import sliced

CAPACITY = 2048
SEPARATOR = 1
STRETCH = 64
WINDOW_COST = 2.0
CUT_SENTENCE_END = 2.0
CUT_INSIDE = 8.0
BLOCK = 1 << 19

PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, begins: np.ndarray, stretch: int):
    """Positions at which the stream may be cut, and the penalty of each; 0 and the stream's end are among them."""
    sentence = np.flatnonzero(ends[ids[:-1]] & begins[ids[1:]]) + 1
    natural = np.union1d(np.concatenate([[0], doc_ends]), sentence)
    gaps = np.diff(natural)
    long = np.flatnonzero(gaps > stretch)
    forced = [np.arange(natural[k] + stretch, natural[k + 1], stretch) for k in long.tolist()]
    position = np.union1d(natural, np.concatenate(forced)) if forced else natural
    penalty = np.full(len(position), CUT_INSIDE)
    penalty[np.searchsorted(position, sentence)] = CUT_SENTENCE_END
    penalty[np.searchsorted(position, doc_ends)] = 0
    penalty[0] = 0
    return position, penalty


def best_cuts(position: np.ndarray, penalty: np.ndarray, capacity: int, window_cost: float = WINDOW_COST) -> list[int]:
    """Indexes into ``position`` of the cuts of least cost, first and last included."""
    n = len(position)
    powers = [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity]
    exact: list[list[int]] = [[] for _ in range(n)]
    for p in powers:
        at = np.searchsorted(position, position - p)
        hit = np.flatnonzero((position >= p) & (position[at] == position - p))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact[j].append(i)
    pos, extra = position.tolist(), penalty.tolist()
    cost, before = [0.0] * n, [0] * n
    value = [0.0] * n  # position plus cost: what a later window compares
    value[0] = float(pos[0])
    queue = deque([0])
    for j in range(1, n):
        here = pos[j]
        low = here - capacity
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = value[i] + capacity - here
        for k in exact[j]:
            if cost[k] < best:
                best, i = cost[k], k
        best += extra[j] + window_cost
        cost[j], before[j], value[j] = best, i, best + here
        v = value[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(before[cuts[-1]])
    return cuts[::-1]


class _Stream:
    """The documents of one task that are not yet packed."""

    def __init__(self, tokenizer, capacity: int, stretch: int, first_sequence: int):
        self.tokenizer, self.capacity, self.stretch = tokenizer, capacity, stretch
        self.sequence = first_sequence
        self.parts: list[np.ndarray] = []
        self.owners: list = []  # id, ids that lie before the part, ids of the whole document
        self.size = 0

    def add(self, owner, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.owners.append((owner, 0, len(ids)))
        self.size += len(ids)

    def pack(self, kind: pa.DataType, last: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        ends = np.cumsum([len(p) for p in self.parts]).astype(np.int64)
        out: list[tuple] = []
        if len(ids):
            tok = self.tokenizer
            position, penalty = candidates(ids, ends, tok.ends, tok.begins, self.stretch)
            cuts = position[best_cuts(position, penalty, self.capacity)]
            if not last:
                cuts = cuts[:-1]
            done = int(cuts[-1])
            edges = np.union1d(cuts, np.concatenate([[0], ends[ends < done]]))
            part = np.searchsorted(ends, edges[:-1], side="right")
            window = np.searchsorted(cuts, edges[:-1], side="right") - 1
            begin = ends - np.array([len(p) for p in self.parts])
            spans = zip(edges[:-1].tolist(), edges[1:].tolist(), part.tolist(), window.tolist(), strict=True)
            lows, starts, windows = begin.tolist(), self.owners, cuts.tolist()
            for a, b, d, w in spans:
                owner, skipped, total = starts[d]
                out.append(
                    (owner, skipped + a - lows[d], b - a, ids[a:b].tobytes(), total, self.sequence + w, a - windows[w])
                )
            self.sequence += len(cuts) - 1
            keep = int(np.searchsorted(ends, done, side="right"))
            self.parts, self.owners = self.parts[keep:], self.owners[keep:]
            if self.parts and done > lows[keep]:
                gone = done - lows[keep]
                owner, skipped, total = self.owners[0]
                self.parts[0] = self.parts[0][gone:]
                self.owners[0] = (owner, skipped + gone, total)
            self.size = sum(map(len, self.parts))
        columns = list(zip(*out, strict=True)) or [[] for _ in range(7)]
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", *(c.split()[0] for c in PIECE.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, stretch: int = STRETCH
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. ``sequence_id`` is unique, not
    dense: its upper bits are the number of the task.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        stream = _Stream(tok, capacity, stretch, TaskContext.get().partitionId() << 33)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for piece in sliced(batch):
                for owner, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    stream.add(owner, np.append(tok.ids(text or ""), np.uint32(separator)))
                    if stream.size >= block:
                        yield stream.pack(kind, False)
        if kind is not None:
            yield stream.pack(kind, True)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {PIECE}")
