"""Quality by nearest-neighbour voting in a latent-semantic space.

A document becomes a vector of hashed byte trigrams, pairs of byte classes and a few measures of repetition. Weighted by
the rarity of each feature, the vectors of a bounded sample of labelled documents span a latent space (truncated singular
value decomposition by subspace iteration). Every document is projected into it, and its exact cosines with all labelled
vectors are computed block by block as matrix products; the labels of the ``NEIGHBOURS`` nearest vote with weights that
grow with the cosine. The labelled vectors, at most ``2 * PER_CLASS`` of ``LATENT`` numbers, are what is broadcast.

Of vectors that tie for the last place among the nearest the one that comes first in the broadcast order (by text) votes. A
text of any length is read whole, in slices of about 2 MiB or one text. A null text is empty; texts without bytes are all the same point and get the share of label 1. Repeated rows get equal
rows. Without any labels every score is 1, so nothing is rejected. Only ``doc_id`` and ``text`` are read, so other columns
may have any name.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_TEXT_BYTES, fitted, labels_by_id, sample
from .wordbytes import Words, sliced, utf8

PER_CLASS = 2000
TRIGRAMS = 2048
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 20.0
THRESHOLD = 0.5
SHAPE_WEIGHT = 1.0
REPEAT_WEIGHT = 1.0

#: Byte classes: other, upper, lower, digit, blank, line end, sentence mark, quote or bracket, symbol, outside ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 9
for _chars, _k in ((" \t", 4), ("\r\n", 5), (".,;:!?", 6), ("\"'()[]{}-", 7), ("#$%&*+/<=>@\\^_`|~", 8)):
    _CLASS[[ord(c) for c in _chars]] = _k
CLASSES = 10
REPEATS = 4
WIDTH = TRIGRAMS + CLASSES * CLASSES + REPEATS


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def raw_features(column: pa.Array) -> np.ndarray:
    """Frequencies of trigrams and class pairs (square roots, so that rows are unit vectors), and repetition measures."""
    data, offsets = utf8(column)
    rows, n = len(offsets) - 1, len(data)
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.zeros((rows, WIDTH), np.float32)
    if n >= 3:
        code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - 11)
        whole = doc[:-2] == doc[2:]
        grams = np.bincount(doc[:-2][whole] * TRIGRAMS + code[whole], minlength=rows * TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(grams.reshape(rows, TRIGRAMS))
    if n >= 2:
        kind = _CLASS[data].astype(np.int64)
        whole = doc[:-1] == doc[1:]
        pairs = (doc[:-1] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        pairs = np.bincount(pairs[whole], minlength=rows * CLASSES * CLASSES)
        out[:, TRIGRAMS:-REPEATS] = np.sqrt(pairs.reshape(rows, -1))
    out[:, :TRIGRAMS] = _unit(out[:, :TRIGRAMS])
    out[:, TRIGRAMS:-REPEATS] = _unit(out[:, TRIGRAMS:-REPEATS])
    out[:, -REPEATS:] = _repetition(Words(column))
    return out


def _repetition(words: Words) -> np.ndarray:
    """Shares of words equal to the one before, of repeated words, of repeated word pairs, and the mean word length."""
    out = np.zeros((words.rows, REPEATS), np.float32)
    n, doc, hashes = words.counts, words.doc, words.hashes
    if not len(words):
        return out
    some = np.maximum(n, 1)
    next_same = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
    out[:, 0] = np.bincount(doc[1:][next_same], minlength=words.rows) / some
    follow = hashes.copy()
    follow[:-1] = follow[:-1] * np.uint64(31) + hashes[1:]
    for k, h in ((1, hashes), (2, follow)):
        order = np.lexsort((h, doc))
        again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out[:, k] = np.bincount(doc[order][1:][again], minlength=words.rows) / some
    out[:, 3] = np.bincount(doc, words.ends - words.starts, minlength=words.rows) / some / 20
    return out


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest of each row; of equal ones those that come first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k).tolist():
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return near


@dataclass
class Model:
    prior: float = 1.0
    weight: np.ndarray | None = None  # of each feature
    basis: np.ndarray | None = None  # features x latent
    vectors: np.ndarray | None = None  # unit vectors of the labelled documents
    labels: np.ndarray | None = None

    def state(self) -> dict:
        return dict(vars(self))

    def latent(self, features: np.ndarray) -> np.ndarray:
        return _unit((features * self.weight) @ self.basis)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Weighted vote of the nearest labelled documents."""
        out = np.full(len(column), self.prior)
        if self.vectors is None:
            return out
        filled = np.flatnonzero(np.diff(utf8(column)[1]) > 0)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(filled), 256):
            block = filled[a : a + 256]
            points = self.latent(raw_features(column.take(pa.array(block))))
            cosine = points @ self.vectors.T
            near = _nearest(cosine, k)
            close = np.take_along_axis(cosine, near, axis=1)
            vote = np.exp(SHARPNESS * (close - close.max(axis=1, keepdims=True)))
            out[block] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return out


def _truncated_basis(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    q = np.random.default_rng(1).normal(size=(x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, rotation = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ rotation.T)[:, :k].astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, counts: dict[int, int]) -> Model:
    total = sum(counts.values())
    if not total:
        return Model()
    prior = counts.get(1, 0) / total
    blocks = [raw_features(piece.column(0)) for piece in sliced(pa.RecordBatch.from_arrays([texts], ["text"]))]
    if not blocks:
        return Model(prior)
    x = np.concatenate(blocks)
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    weight = rarity.astype(np.float32)
    weight[TRIGRAMS:-REPEATS] = SHAPE_WEIGHT
    weight[-REPEATS:] = REPEAT_WEIGHT
    model = Model(prior, weight, _truncated_basis(x * weight, LATENT))
    model.vectors, model.labels = model.latent(x), np.asarray(labels, np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality", max_bytes: int = MAX_TEXT_BYTES) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class, of at most ``max_bytes`` each."""
    rows, counts = sample(docs, labels_by_id(labels, label), per_class, max_bytes)
    return Model(**fitted(rows, fit, counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                scores = shared.value.scores(piece.column("text").cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                scores = shared.value.scores(piece.column("text").cast(pa.large_string()))
                yield piece.filter(pc.greater_equal(pa.array(scores, pa.float64()), threshold))

    return docs.mapInArrow(run, docs.schema)
