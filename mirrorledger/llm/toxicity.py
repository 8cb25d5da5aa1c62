"""Toxicity by a linear-chain conditional random field over words.

Labelled documents give labelled tokens: a word of a toxic document is offending if the word, or the stem it begins with, is
much more frequent among toxic than among other documents. The field has two states per word, hashed features of the word
and its first bytes, and transition weights; it is trained by gradient ascent on a bounded sample of the labelled rows. A word or stem is taken as offending in toxic
documents if chance (the share of toxic documents in the sample) would bring it into so many of them with a probability
below ``CHANCE``, and more than half of its documents, and twice chance's share, are toxic.
Forward-backward gives each word's probability of being offending. A document's score is a logistic function of the
probability that any word is offending, of the largest one and of the expected number; words of probability 0.5 or more
are its spans, given as byte offsets in the UTF-8 text.

Forward and backward passes run on all documents of a slice at once: documents are cut into chunks of ``CHUNK`` words, the
2 x 2 transfer matrix of each chunk is multiplied up, messages go from chunk to chunk, and then through all chunks side by
side. The result is the exact one whatever a text's length.

A null text is empty; a text without words has the score of no evidence. Repeated rows get equal rows. Without labels of
both classes every score is the share of label 1 (0 without any labels). Only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_TEXT_BYTES, fitted, labels_by_id, sample
from .wordbytes import Words, sliced

PER_CLASS = 2000
TABLE_BITS = 20
MIN_WEIGHT = 0.05  # smaller weights are not kept
STEMS = (4, 5, 6, 7)
CHUNK = 64
EPOCHS = 6
BATCH_DOCS = 64
CHANCE = 4e-3  # a feature marks if chance would bring it into so many toxic documents with a smaller probability
MIN_WORDS = 3
THRESHOLD = 0.3


def features(words: Words) -> np.ndarray:
    """64-bit names of each word's features, one column per kind: the word, and its first bytes for each stem length."""
    starts, ends = words.starts, words.ends
    columns = [words.hashes]
    columns += [words.span_hash(starts, np.minimum(ends, starts + n)) ^ np.uint64(n) for n in STEMS]
    return np.stack(columns, axis=1)


class Weights:
    """Weights by feature name: a table by the name's upper bits that also holds its lower bits, so other names get 0.

    Of two features that share a slot the one of larger weight stays; ``TABLE_BITS`` leaves few such slots.
    """

    def __init__(self, names: np.ndarray, weights: np.ndarray):
        order = np.argsort(np.abs(weights), kind="stable")
        order = order[np.abs(weights[order]) >= MIN_WEIGHT]
        slot = names[order] >> np.uint64(64 - TABLE_BITS)
        self.check = np.zeros(1 << TABLE_BITS, np.uint32)
        self.weight = np.zeros(1 << TABLE_BITS, np.float32)
        self.check[slot], self.weight[slot] = names[order].astype(np.uint32), weights[order]

    def __getitem__(self, names: np.ndarray) -> np.ndarray:
        slot = names >> np.uint64(64 - TABLE_BITS)
        return np.where(self.check[slot] == names.astype(np.uint32), self.weight[slot], np.float32(0))


class _Chunks:
    """Words of many documents laid out as (position in chunk, chunk), with the chunks of a document in sequence."""

    def __init__(self, counts: np.ndarray):
        per_doc = -(-counts // CHUNK)
        self.chunks = int(per_doc.sum())
        self.first = np.cumsum(per_doc) - per_doc
        begin = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) - np.repeat(begin, counts)
        self.row, self.column = place % CHUNK, np.repeat(self.first, counts) + place // CHUNK
        order = np.argsort(-per_doc, kind="stable")
        self.order = order[per_doc[order] > 0]
        self.per_doc = per_doc[self.order]

    def waves(self) -> Iterator[np.ndarray]:
        """The k-th chunk of every document that has one, for k = 0, 1, ..."""
        first = self.first[self.order]
        for k in range(int(self.per_doc[0]) if len(self.per_doc) else 0):
            yield first[: np.searchsorted(-self.per_doc, -k, side="left")] + k


def marginals(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of state 1 for each word, with the forward and backward odds they are the product of.

    ``emission``: log odds of each word for state 1; ``transition``: 2 x 2 positive weights, from the row to the column.
    A document starts as if after a word of state 0.
    """
    grid = _Chunks(counts)
    x = np.ones((CHUNK, grid.chunks))
    x[grid.row, grid.column] = np.exp(np.clip(emission, -30, 30))
    real = np.zeros((CHUNK, grid.chunks), bool)
    real[grid.row, grid.column] = True
    (t00, t01), (t10, t11) = transition
    m00, m01 = np.ones(grid.chunks), np.zeros(grid.chunks)
    m10, m11 = np.zeros(grid.chunks), np.ones(grid.chunks)
    for k in range(CHUNK):
        on, xk = real[k], x[k]
        n00, n01 = t00 * m00 + t10 * m10, t00 * m01 + t10 * m11
        n10, n11 = xk * (t01 * m00 + t11 * m10), xk * (t01 * m01 + t11 * m11)
        scale = 1 / np.maximum(np.maximum(n00, n01), np.maximum(n10, n11))
        m00, m01 = np.where(on, n00 * scale, m00), np.where(on, n01 * scale, m01)
        m10, m11 = np.where(on, n10 * scale, m10), np.where(on, n11 * scale, m11)
    enter, leave = np.zeros(grid.chunks), np.ones(grid.chunks)
    waves = list(grid.waves())
    for now, following in zip(waves[:-1], waves[1:], strict=True):
        now = now[: len(following)]
        odds = enter[now]
        enter[following] = (m10[now] + m11[now] * odds) / (m00[now] + m01[now] * odds)
    for now, following in zip(waves[-2::-1], waves[:0:-1], strict=True):
        odds = leave[following]
        leave[now[: len(following)]] = (m01[following] + m11[following] * odds) / (m00[following] + m10[following] * odds)
    forward, backward = np.empty_like(x), np.empty_like(x)
    odds = enter
    for k in range(CHUNK):
        odds = np.where(real[k], x[k] * (t01 + t11 * odds) / (t00 + t10 * odds), odds)
        forward[k] = odds
    odds = leave
    for k in range(CHUNK - 1, -1, -1):
        backward[k] = odds
        odds = np.where(real[k], (t10 + t11 * x[k] * odds) / (t00 + t01 * x[k] * odds), odds)
    f, b = forward[grid.row, grid.column], backward[grid.row, grid.column]
    return f * b, f, b


class _Layout:
    """Where the words of each document stand, without the words."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.rows = counts, len(counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


@dataclass
class Model:
    prior: float = 0.0
    weights: Weights | None = None
    transition: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def state(self) -> dict:
        """What the model holds, in arrays alone."""
        return vars(self) | {"weights": self.weights and vars(self.weights)}

    @staticmethod
    def of(state: dict) -> "Model":
        model = Model(**state)
        if state["weights"]:
            model.weights = Weights.__new__(Weights)
            vars(model.weights).update(state["weights"])
        return model

    def probabilities(self, words: Words) -> np.ndarray:
        odds, _, _ = marginals(self.weights[features(words)].sum(axis=1), words.counts, self.transition)
        return odds / (1 + odds)

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document, probability of each word."""
        if self.weights is None:
            return np.full(words.rows, self.prior), np.zeros(len(words))
        p = self.probabilities(words)
        return 1 / (1 + np.exp(-(summary(p, words) @ self.logistic))), p


def summary(p: np.ndarray, words: Words | _Layout) -> np.ndarray:
    """Per document: 1, and bounded log odds of any offending word, of the likeliest one, and the expected number.

    For the first and the last each probability counts by its square, so many unlikely words don't add up in long documents.
    """
    p = np.clip(p, 1e-9, 1 - 1e-9)
    filled = np.flatnonzero(words.counts)
    none, most, number = np.zeros(words.rows), np.full(words.rows, 1e-9), np.zeros(words.rows)
    if len(filled):
        at = words.first[filled]
        none[filled] = np.add.reduceat(np.log1p(-p * p), at)
        most[filled] = np.maximum.reduceat(p, at)
        number[filled] = np.add.reduceat(p * p, at)
    some = np.log(np.clip(-np.expm1(none), 1e-9, 1)) - np.maximum(none, -20)
    return np.stack([np.ones(words.rows), some / 4, np.log(most / (1 - most)) / 4, np.log1p(number)], axis=1)


def _distinct_words(stem: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(np.unique(stem.astype(np.int64) * size + word) // size, minlength=size)


def tail(seen: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Probability of ``seen`` or more successes among ``total`` trials of probability ``share`` (bounded from above)."""
    out = np.ones(len(seen))
    able = np.flatnonzero(seen > share * total)
    if len(able):
        each, code = np.unique(np.stack([seen[able], total[able]], axis=1), axis=0, return_inverse=True)
        sums = np.empty(len(each))
        for k, (a, n) in enumerate(each.tolist()):
            i = np.arange(a, min(n, a + 200) + 1)
            logs = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i.tolist()]
            sums[k] = np.exp(np.array(logs) + i * math.log(share) + (n - i) * math.log1p(-share)).sum()
        out[able] = sums[code.ravel()]
    return out


def _marking(feature: np.ndarray, doc: np.ndarray, size: int, toxic: np.ndarray) -> np.ndarray:
    """Which features mark toxic documents: those in more of them than chance explains, and in more of them than not."""
    n = len(toxic)
    pair = np.unique(feature.astype(np.int64) * n + doc)
    whose, where = pair // n, pair % n
    seen = np.bincount(whose[toxic[where]], minlength=size)
    total = np.bincount(whose, minlength=size)
    share = toxic.mean()
    return (tail(seen, total, share) < CHANCE) & (seen / np.maximum(total, 1) > max(0.5, 2 * share if share < 0.4 else 0.8))


def label_words(feature: np.ndarray, size: int, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 for words of toxic documents that mark them, by themselves or by a stem; and the stems that count as features.

    ``feature``: numbers below ``size``. A stem counts if ``MIN_WORDS`` different offending words begin with it, so one
    offending word does not make every word that begins like it suspicious.
    """
    tokens = np.zeros(len(doc), bool)
    for k in range(feature.shape[1]):
        left = np.flatnonzero(~tokens)
        marks = _marking(feature[left, k], doc[left], size, toxic)
        if k:
            bad = left[toxic[doc[left]]]
            marks &= _distinct_words(feature[bad, k], feature[bad, 0], size) >= MIN_WORDS
        tokens |= marks[feature[:, k]] & toxic[doc]
    counted = np.zeros(size, bool)
    for k in range(1, feature.shape[1]):
        counted |= _distinct_words(feature[tokens, k], feature[tokens, 0], size) >= MIN_WORDS
    counted[feature[:, 0]] = True
    return tokens, counted


def _fit_field(words: _Layout, feature: np.ndarray, counted: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the counted features and transitions, by stochastic gradient ascent with per-weight steps."""
    size = len(counted)
    counts, first = words.counts, words.first
    weights, log_t = np.zeros(size), np.log(np.array([[1.0, 0.01], [0.5, 0.5]]))
    weights_sq, t_sq = np.full(size, 1e-2), np.full((2, 2), 1.0)
    order = np.random.default_rng(1).permutation(words.rows)
    bias, bias_sq = -4.0, 1.0
    for _ in range(EPOCHS):
        for a in range(0, len(order), BATCH_DOCS):
            docs = np.sort(order[a : a + BATCH_DOCS])
            docs = docs[counts[docs] > 0]
            if not len(docs):
                continue
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            f, y = feature[at], target[at].astype(float)
            t = np.exp(log_t)
            odds, forward, backward = marginals(weights[f].sum(axis=1) + bias, counts[docs], t)
            miss = y - odds / (1 + odds)
            used, at = np.unique(f, return_inverse=True)
            step = (np.bincount(at.ravel(), np.repeat(miss, f.shape[1])) - 1e-3 * weights[used]) * counted[used]
            weights_sq[used] += step**2
            weights[used] += 0.5 * step / np.sqrt(weights_sq[used])
            bias_sq += miss.sum() ** 2
            bias += 0.5 * miss.sum() / np.sqrt(bias_sq)
            starts = np.zeros(len(y), bool)
            starts[np.cumsum(counts[docs]) - counts[docs]] = True
            r = np.where(starts, 0.0, np.roll(forward, 1))
            previous = np.where(starts, 0.0, np.roll(y, 1))
            x = np.exp(np.clip(weights[f].sum(axis=1) + bias, -30, 30)) * backward
            joint = np.stack([t[0, 0] + 0 * r, t[0, 1] * x, t[1, 0] * r, t[1, 1] * r * x], axis=1)
            joint /= joint.sum(axis=1, keepdims=True)
            seen = np.stack([(1 - previous) * (1 - y), (1 - previous) * y, previous * (1 - y), previous * y], axis=1)
            step_t = (seen - joint).sum(axis=0).reshape(2, 2)
            t_sq += step_t**2
            log_t = np.clip(log_t + 0.1 * step_t / np.sqrt(t_sq), -8, 3)
    # The bias is a weight of every word; it is kept in the transitions into state 1.
    t = np.exp(log_t)
    t[:, 1] *= np.exp(bias)
    return weights, t


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
    return w


def fit(texts: pa.Array, labels: np.ndarray, counts: dict[int, int]) -> Model:
    """``labels`` of the sampled ``texts``; ``counts``: labelled rows of each class, for the share of toxic documents."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    toxic = np.asarray(labels, bool)
    if not toxic.any() or toxic.all():
        return Model(prior)
    pieces = [Words(p.column(0)) for p in sliced(pa.RecordBatch.from_arrays([texts], ["text"]))]
    names = np.unique(np.concatenate([np.unique(features(some)) for some in pieces]))
    feature = np.concatenate([np.searchsorted(names, features(some)).astype(np.int32) for some in pieces])
    words = _Layout(np.concatenate([some.counts for some in pieces]))
    del pieces
    target, counted = label_words(feature, len(names), words.doc, toxic)
    weights, transition = _fit_field(words, feature, counted, target)
    model = Model(prior, Weights(names, weights), transition)
    share = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    known = model.weights[names]
    odds, _, _ = marginals(known[feature].sum(axis=1), words.counts, transition)
    model.logistic = _fit_logistic(summary(odds / (1 + odds), words), toxic.astype(float), share)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "toxic", max_bytes: int = MAX_TEXT_BYTES) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class, of at most ``max_bytes`` each."""
    rows, counts = sample(docs, labels_by_id(labels, label), per_class, max_bytes)
    return Model.of(fitted(rows, fit, counts))


def _in_slices(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    for piece in sliced(batch):
        words = Words(piece.column("text").cast(pa.large_string()))
        yield piece, words, *model.scores(words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score, spans (byte ranges of offending words with their probability)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, words, scores, p in _in_slices(shared.value, batch):
                at = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(words.first, at, side="right") - 1
                spans: list[list] = [[] for _ in range(piece.num_rows)]
                begin = words.starts[at] - words.offsets[doc]
                end = words.ends[at] - words.offsets[doc]
                for d, a, b, q in zip(doc.tolist(), begin.tolist(), end.tolist(), p[at].tolist(), strict=True):
                    spans[d].append((a, b, q))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    names=["doc_id", "score", "spans"],
                )

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, score double, spans array<struct<begin:bigint,end:bigint,p:double>>"
    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, _, scores, _ in _in_slices(shared.value, batch):
                yield piece.filter(pc.less(pa.array(scores, pa.float64()), threshold))

    return docs.mapInArrow(run, docs.schema)
