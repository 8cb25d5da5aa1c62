"""Words, Jaccard join, decontamination, token counts and packing against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorledger.llm import bytebpe, decontam, jaccard, packing, tokencount
from mirrorledger.llm import components as components_module
from mirrorledger.llm import rows as rows_module
from mirrorledger.llm.components import components
from mirrorledger.llm.rows import hash_filter, passes
from mirrorledger.llm.wordbytes import Words, sliced

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain_words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(max_size=30), max_size=8))
def test_words_equal_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()))
    found = [[w.decode() for w in words.text(words.first[k], words.first[k + 1])] for k in range(len(texts))]
    assert found == [plain_words(t) for t in texts]
    names = defaultdict(set)
    for h, w in zip(words.hashes.tolist(), words.text(0, len(words)), strict=True):
        names[h].add(w)
    assert all(len(v) == 1 for v in names.values())
    assert len(names) == len(set(words.text(0, len(words))))


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 500, "c"])], ["text"])
    pieces = list(sliced(batch, limit=100))
    assert sum(p.num_rows for p in pieces) == 5 and len(pieces) > 1


def test_jaccard_join_broadcasts_no_table_of_its_size(spark, docs, monkeypatch):
    """However small Spark takes a table to be, as after an explode, it is sent nowhere whole from ``SENT_ROWS`` rows on."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    written, links = jaccard.materialise, components_module._written
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: written(seen(df), name))
    monkeypatch.setattr(components_module, "_written", lambda df: links(seen(df)))
    monkeypatch.setattr(rows_module, "SENT_ROWS", -1)
    found = seen(jaccard.classes(docs, leaf=4))
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert len(joins) > 10 and not [line for line in joins if "Broadcast" in line]
    monkeypatch.undo()
    again = jaccard.classes(docs, leaf=4)
    assert Counter(found.drop("class_key").collect()) == Counter(again.drop("class_key").collect())


def test_filter_passes_all_its_hashes(spark):
    rows = spark.range(1000).selectExpr("xxhash64(id) AS h")
    hashes = np.array([r.h for r in rows.collect()]).view(np.uint64)
    table = hash_filter(rows, "h", 16)
    assert passes(table, hashes).all()
    assert passes(table, hashes * np.uint64(3)).mean() < 0.1


def test_components_of_a_chain_and_a_star(spark):
    links = [(k + 1, k) for k in range(40)] + [(100 + k, 99) for k in range(1, 30)] + [(7, 3), (7, 3)]
    found = {r.u: r.v for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100 + k: 99 for k in range(1, 30)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_classes(rows, threshold):
    """class id, links and copies of each (id, text) row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else text or "")
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            alike = x == y if isinstance(x, str) or isinstance(y, str) else len(x & y) / len(x | y) >= threshold
            if alike:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    lows = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        lows[find(k)] += [] if doc_id is None else [doc_id]
    size = Counter(sets)
    return Counter((i, min(lows[find(k)], default=None), links[k], size[sets[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("leaf", [1000, 4])
def test_jaccard_classes_equal_all_pairs(spark, docs, leaf):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = jaccard.classes(docs, leaf=leaf)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in found.collect()) == plain_classes(rows, 0.8)


def test_one_representative_for_each_class(docs, no_docs):
    found = jaccard.classes(docs)
    assert jaccard.representatives(found).count() == found.select("class_key").distinct().count()
    assert jaccard.classes(no_docs).count() == 0


def test_runs_reach_the_recall():
    assert (1 - 0.8**3) ** jaccard.runs_for(0.8, 0.999, 3) <= 0.001


def plain_contamination(text, items, size=10):
    words = plain_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = plain_words(item_text)
        n = min(size, len(w))
        for window in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set():
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == window:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_equals_search(spark, docs, texts):
    part = texts[4].split()
    items = [
        (1, " ".join(part[3:18])), (2, "one"), (10, "TWO words"), (None, " ".join(part[:10])), (4, None), (5, "?!"),
        (6, " ".join(texts[2].split()[5:20]) + " other"), (6, texts[7]), (7, "not there at all"), (8, texts[4]),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.contamination(docs, bench).collect()
    assert len(found) == docs.count()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, hit, ids = plain_contamination(r.text, items)
        want[(r.doc_id, n, hit, tuple(ids), hit > 0)] += 1
    assert got == want


def test_contamination_of_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(no_docs, bench).count() == 0
    assert decontam.contamination(docs, bench).where("contaminated OR n_hit > 0").count() == 0


def library_counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(WORD_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(docs, no_docs):
    rows = tokencount.token_counts(docs, WORD_BPE).collect()
    given_rows = docs.select("doc_id", "text").collect()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()), n, n > 2048)
        for r, n in zip(given_rows, library_counts([r.text for r in given_rows]), strict=True)
    )
    assert Counter(tuple(r) for r in rows) == want
    assert tokencount.token_counts(no_docs, WORD_BPE).count() == 0


def test_token_counts_of_odd_texts():
    safe = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))]
    texts = [f"a{c}b {c}{c} 1{c}'S {c}'ll" for c in safe]
    texts += ["<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "", "a" * 5000, "aaab" * 900, "한국어 é Σας テスト", "\0a", "İI ŉ ǅ"]
    assert tokencount.load(WORD_BPE).count(texts) == library_counts(texts)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_token_counts_of_any_text(text):
    assert tokencount.load(WORD_BPE).count([text]) == library_counts([text])


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    tok = bytebpe.load(BYTE_BPE)
    assert tok.fast is not None
    assert tok.ids(text).tolist() == tok.library.encode(text, add_special_tokens=False).ids


def plain_cost(position, penalty, capacity):
    best = [0.0]
    for j in range(1, len(position)):
        options = []
        for i in range(j):
            n = position[j] - position[i]
            if n <= capacity:
                options.append(best[i] + (0 if n & (n - 1) == 0 else capacity - n) + packing.WINDOW_COST + penalty[j])
        best.append(min(options))
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 2.0, 8.0])), min_size=1, max_size=40))
def test_cuts_have_the_least_cost(steps):
    position = np.cumsum([0, *(n for n, _ in steps)])
    penalty = np.array([0.0, *(p for _, p in steps)])
    cuts = packing.best_cuts(position, penalty, 16)
    cost = 0.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(position[b] - position[a])
        assert n <= 16
        cost += (0 if n & (n - 1) == 0 else 16 - n) + packing.WINDOW_COST + penalty[b]
    assert cuts[0] == 0 and cuts[-1] == len(position) - 1
    assert cost == pytest.approx(plain_cost(position.tolist(), penalty.tolist(), 16))


@pytest.mark.parametrize("block", [packing.BLOCK, 3000])
def test_pieces_hold_each_id_once(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    pieces = packing.pack(docs, BYTE_BPE).collect()
    tok = bytebpe.load(BYTE_BPE)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[(r.doc_id, np.append(tok.ids(r.text or ""), np.uint32(1)).tobytes())] += 1
    windows = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        windows[p.sequence_id].append(p)
    lengths = []
    for parts in windows.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        lengths.append(sum(p.length for p in parts))
    assert max(lengths) <= 2048
    # Pieces in stream order give the documents again.
    got, held = Counter(), b""
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(held) // 4
        held += bytes(p.ids)
        if len(held) == 4 * p.doc_tokens:
            got[(p.doc_id, held)] += 1
            held = b""
    assert got == want and not held
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [r.n for r in packing.pack(docs, BYTE_BPE).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding / sum(sizes) < 0.01


def test_checksum_is_that_of_the_ids(spark, docs):
    from pyspark.sql import functions as F

    row = packing.pack(docs, BYTE_BPE).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids))
