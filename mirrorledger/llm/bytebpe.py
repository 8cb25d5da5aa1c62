"""Ids of a byte-level BPE tokenizer file (``.json``), the same as its own library gives.

Where the file's merges are ranked as its ids, which holds for the usual byte-level vocabularies and is checked, the faster
merging library is loaded with the same table. Otherwise, and for a text on which that gives up, the file's own library
is used.
"""

import json

import numpy as np

from .wordbytes import worker_cache

# Fixed value: the split pattern of byte-level BPE files that name no other.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves,
    the other bytes take the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked(spec: dict) -> dict[bytes, int] | None:
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")]
    if spec.get("normalizer") or not plain or model["type"] != "BPE" or any(odd) or model.get("ignore_merges"):
        return None
    vocabulary = model["vocab"]
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    first = len(vocabulary) - len(pairs)
    if any(vocabulary.get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
        return None
    letters = byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = spec.get("added_tokens", [])
        ranks = _ranked(spec)
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        self.fast = None
        if ranks is not None and simple:
            import tiktoken

            special = {t["content"]: t["id"] for t in added}
            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        size = self.library.get_vocab_size(with_added_tokens=True)
        pieces = [self.library.id_to_token(i) or "" for i in range(size)]
        #: Ids that can end a sentence, and ids that can begin the next one.
        self.ends = np.array([p.rstrip("ĠĊ").endswith((".", "!", "?")) or p.endswith("Ċ") for p in pieces])
        self.begins = np.array([p.startswith(("Ġ", "Ċ")) for p in pieces])

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.asarray(self.fast.encode(text, allowed_special="all"), np.uint32)
            except Exception:  # a run of characters that its pattern matcher can't hold
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def load(path: str) -> ByteBpe:
    cache = worker_cache()
    known = cache.__dict__.setdefault("byte_bpe", {})
    if path not in known:
        known[path] = ByteBpe(path)
    return known[path]
