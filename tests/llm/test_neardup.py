"""MinHash near-duplicates against comparing all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mirrorledger.llm import neardup as nd
from mirrorledger.llm.jaccard import shingle_sets
from mirrorledger.llm.wordbytes import Words


def plain_set(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) of each (doc_id, text)."""
    sets = [plain_set(t) for _, t in rows]
    where = {}
    for r, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(r)
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for r, s in enumerate(sets):
        for q, both in Counter(q for x in s for q in where[x] if q < r).items():
            if 100 * both >= 85 * (len(s) + len(sets[q]) - both):
                group[max(top(r), top(q))] = min(top(r), top(q))
    low = {}
    for r, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(r)] = min(low.get(top(r), doc_id), doc_id)
    out = []
    for r, (doc_id, _) in enumerate(rows):
        component = low.get(top(r)) if sets[r] else doc_id
        out.append((doc_id, len(sets[r]), component, doc_id == component))
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def found(result):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in result.collect()), key=key)


def edited(rng, text, share):
    return " ".join(f"w{rng.randint(0, 9**6)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(8)
    out = list(enumerate(texts)) + [(3, "the same id with another text"), (None, texts[0]), (None, "x y"), (None, None), (0, texts[0])]
    base = " ".join(rng.choice("abcdefghijklm") + rng.choice("nopqrstuv") for _ in range(300))
    out += [(500 + k, edited(rng, base, 0.004 * (k % 6))) for k in range(400)]
    chain, words = [], [f"c{k}" for k in range(400)]
    for k in range(40):
        chain.append(" ".join(words[5 * k : 5 * k + 200]))
    out += [(2000 + k, t) for k, t in enumerate(chain)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tile", [1000, 37])
def test_components_of_all_pairs(spark, rows, tile, monkeypatch):
    """With small tiles a cluster is compared block by block."""
    monkeypatch.setattr(nd, "TILE_ROWS", tile)
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id bigint, text string, fp string, kept boolean").repartition(4)
    result = found(nd.near_duplicates(docs))
    assert result == sorted(plain(rows), key=key)
    assert max(Counter(r[2] for r in result).values()) > 100


def test_a_pair_shares_a_table_with_the_stated_probability():
    rng = random.Random(1)
    missed = trials = 0
    for _ in range(60):
        words = [f"v{rng.randint(0, 9**9)}" for _ in range(1004)]
        near = words[:461] + ["other"] * 3 + words[464:540] + [f"u{k}" for k in range(70)] + words[610:]
        found, edges = shingle_sets(Words(pa.array([" ".join(words), " ".join(near)]), nd._IS_WORD), 5)
        keys = nd.collection_keys(found, edges, nd.KEYS, nd.HASHES)
        same = keys[0] == keys[1]
        assert 0.8 < len(np.intersect1d(found[: edges[1]], found[edges[1] :])) / len(np.unique(found)) < 0.86
        trials += 1
        missed += not (same[: nd.KEYS].any() and same[nd.KEYS :].any())
    assert trials == 60 and missed == 0


def test_similarity_is_exact_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:85], a[:84], np.concatenate([a[:92], np.arange(1000, 1008, dtype=np.uint64)])]
    good = nd._agree(sets, np.array([0, 0, 0, 1]), np.array([1, 2, 3, 0]), 85)
    assert good.tolist() == [True, False, 100 * 92 >= 85 * 108, True]


def test_empty_table_and_long_text(spark):
    schema = "doc_id bigint, text string"
    assert nd.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(str(k % 50_021) for k in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, None)]
    assert found(nd.near_duplicates(spark.createDataFrame(rows, schema))) == sorted(plain(rows), key=key)
