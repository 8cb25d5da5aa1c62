"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that were not met before are laid out as one flat array of symbols with row lengths. In every
round each row applies its pair of lowest rank at all its places at once (left to right where places overlap), until no
row has a pair that merges; the symbols that are left are the row's tokens. A document's count is the sum over its
pre-tokens. Applying one pair everywhere at once equals merging one by one from the left if a merge ranks behind those
that make its parts, which is checked when a tokenizer is loaded.

Texts are normalised and split here where all their characters are in ranges for which this equals the tokenizer's own
library (a test compares them); any other text is normalised and split by that library. A pre-token of more than
``LONG`` bytes is counted by the library's model, since a round per merge of one long row would be slow. Special strings
inside a text count as one token each, as the library does by default.

A null text is empty and has no tokens. Repeated rows get equal rows; empty tables give empty results. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_letters
from .wordbytes import sliced, worker_cache

LIMIT = 2048
LONG = 4096
KNOWN_WORDS = 400_000

# Latin letters, general punctuation and currency signs; no combining marks, which normalisation would compose.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")
_LETTERS = "\ue000"  # marks pre-tokens in byte letters; none of the characters above
_NEVER = np.iinfo(np.int64).max


class Merger:
    """A BPE model with a word-end suffix, its merges as sorted arrays."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd):
            raise ValueError(f"{path} is not a plain BPE model")
        self.library = Tokenizer.from_file(path)
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        made: dict[str, int] = {}
        keys, results = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
        self.width = len(vocabulary)
        for rank, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError(f"{path} ranks a merge before one that makes its parts")
            made.setdefault(a + b, rank)
            keys[rank] = vocabulary[a] * self.width + vocabulary[b]
            results[rank] = vocabulary[a + b]
        self.rank = np.argsort(keys, kind="stable")
        self.keys, self.results = keys[self.rank], results
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        self.letter = [""] * 256
        self.byte = byte_letters()
        for letter, byte in self.byte.items():
            self.inner[byte], self.last[byte] = vocabulary[letter], vocabulary[letter + suffix]
            self.letter[byte] = letter
        self.split = self._split(spec, regex)
        self.special = {t["content"] for t in spec.get("added_tokens", [])}
        found = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.specials = re.compile(f"({found})") if found else None
        self.known: dict[str, int] = {}

    @staticmethod
    def _split(spec: dict, regex):
        """The file's split pattern if its steps are those that are done here, else None."""
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            return None
        rule, letters = parts
        if rule["behavior"] != "Removed" or not rule["invert"] or letters["use_regex"] or letters["add_prefix_space"]:
            return None
        return regex.compile(rule["pattern"]["Regex"])

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings. Those from the library are in its byte letters and marked."""
        if self.split is not None and _OTHER.search(text) is None:
            return self.split.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [_LETTERS + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _bytes(self, word: str) -> bytes:
        return bytes(self.byte[c] for c in word[1:]) if word[0] == _LETTERS else word.encode()

    def learn(self, words: list[str]) -> None:
        """Counts the tokens of words that are not known yet."""
        raw = [self._bytes(w) for w in words]
        short = [k for k, r in enumerate(raw) if len(r) <= LONG]
        for k in set(range(len(raw))) - set(short):
            self.known[words[k]] = len(self.library.model.tokenize("".join(self.letter[b] for b in raw[k])))
        counts = self.merged([raw[k] for k in short])
        self.known.update(zip((words[k] for k in short), counts.tolist(), strict=True))

    def merged(self, rows: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each row."""
        lengths = np.array([len(r) for r in rows], np.int64)
        counts = lengths.copy()
        data = np.frombuffer(b"".join(rows), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        filled = lengths > 0
        symbols[ends[filled] - 1] = self.last[data[ends[filled] - 1]]
        active = np.flatnonzero(lengths > 1)
        symbols = symbols[np.repeat(lengths > 1, lengths)]
        lengths = lengths[active]
        while len(active):
            edges = np.cumsum(lengths)
            starts = edges - lengths
            key = symbols * self.width
            key[:-1] += symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], _NEVER)
            rank[edges - 1] = _NEVER  # the last symbol of a row has no right neighbour
            least = np.minimum.reduceat(rank, starts)
            marked = (rank == np.repeat(least, lengths)) & (rank != _NEVER)
            # In a run of equal symbols places overlap: every second one merges.
            place = np.arange(len(marked))
            opens = marked.copy()
            opens[1:] &= ~marked[:-1]
            run = np.maximum.accumulate(np.where(opens, place, 0))
            marked &= (place - run) % 2 == 0
            at = np.flatnonzero(marked)
            symbols[at] = self.results[rank[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            lengths = lengths - np.add.reduceat(gone, starts, dtype=np.int64)
            counts[active] = lengths
            on = (least != _NEVER) & (lengths > 1)
            symbols = symbols[~gone]
            symbols = symbols[np.repeat(on, lengths)]
            active, lengths = active[on], lengths[on]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split: list[list[str]] = []
        special = [0] * len(texts)
        for k, text in enumerate(texts):
            parts = self.specials.split(text) if self.specials and "<" in text else [text]
            words: list[str] = []
            for part in parts:
                if part in self.special:
                    special[k] += 1
                elif part:
                    words += self.words(part)
            split.append(words)
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known.clear()
            fresh = set().union(*split)
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [n + sum(map(known, words)) for n, words in zip(special, split, strict=True)]


def load(path: str) -> Merger:
    known = worker_cache().__dict__.setdefault("mergers", {})
    if path not in known:
        known[path] = Merger(path)
    return known[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``tokenizer`` is a path all executors can read."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = load(tokenizer)
        for batch in batches:
            for piece in sliced(batch):
                text = pc.fill_null(piece.column("text"), "")
                n = pa.array(merger.count(text.to_pylist()), pa.int64())
                size = pc.binary_length(text).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), size, n, pc.greater(n, limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
