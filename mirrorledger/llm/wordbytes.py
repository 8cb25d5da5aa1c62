"""Words of a batch of texts as numpy arrays, taken from the UTF-8 bytes that Arrow already holds.

A word is a run of the characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Every character outside
ASCII is a word character and has only bytes of 0x80 or more, so the same words come out byte by byte.
"""

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

SLICE_BYTES = 2 << 20
HASHED_BYTES = 1 << 18


def all_but(separators: bytes) -> np.ndarray:
    """A table of the bytes in words that end only at ASCII ``separators``."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


def worker_cache() -> types.ModuleType:
    """A holder that lives as long as the Python worker, so tables are built once per worker and not once per task."""
    return sys.modules.setdefault("mirrorledger_worker_cache", types.ModuleType("mirrorledger_worker_cache"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    known = getattr(cache, "powers", None)
    if known is None or len(known[0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        known = cache.powers = np.cumprod(up), np.cumprod(down)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """The batch in pieces of about ``limit`` text bytes, at least one row each, so temporary arrays stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The words of a text column.

    ``starts``, ``ends``: byte range of each word in ``lower`` (the lower-cased bytes); ``first``: for each row the index
    of its first word, with one entry more than rows; ``doc``: row of each word; ``hashes``: 64 bits of each word;
    ``offsets``: where each row begins in ``lower``. Another table of the 256 bytes makes other words (see ``all_but``).
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray = _IS_WORD):
        data, offsets = utf8(column)
        self.rows = len(offsets) - 1
        self.lower = _LOWER[data]
        inside = is_word[self.lower]
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            begins[edge] = inside[edge]
            stops[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets
        self._sums = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        up, down = _powers(len(self.lower) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.lower) + 1, np.uint64)
            np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * up[: len(self.lower)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def text(self, a: int, b: int) -> list[bytes]:
        """Words ``a`` to ``b`` (exclusive) themselves."""
        return [self.lower[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)]


def text_hash(column: pa.Array) -> np.ndarray:
    """64 bits of each text of a column, equal for equal bytes in any batch; case is kept, null counts as empty. Taken in
    pieces, since a byte takes several numbers of 64 bits meanwhile."""
    texts = pa.RecordBatch.from_arrays([column.cast(pa.large_string())], names=["text"])
    pieces = [_text_hash(piece.column("text")) for piece in sliced(texts, limit=HASHED_BYTES)]
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)


def _text_hash(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]])


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes, for each start; windows may cross rows, callers mask those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _BASE + hashes[k : k + n]
    return mix(total)
