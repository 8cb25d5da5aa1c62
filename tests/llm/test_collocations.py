"""Collocations against plain counting of all phrases."""

import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirrorledger.llm import collocations as co
from mirrorledger.llm import wordbytes

DOCS = "doc_id bigint, text string, lang string, phrase string, n long"
NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, min_count, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        large = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        dropped = set()
        for p, a in large.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    if a >= f[p[i : i + k]]:
                        dropped.add(p[i : i + k])
        best = []
        for p, a in large.items():
            if p not in dropped:
                score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["ab", "B", "a", "é", "of", "the", "x-y", " z", "naïve", "#", "0", "THE"]
    out = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "?"]) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    phrase = "one two three four five six "
    out += [(phrase * 5, "en"), (None, "en"), ("", None), ("...", "fr"), (out[0][0], "en"), (out[0][0], "en"), ("the " * 3000, "es")]
    out.append((" ".join(rng.choice(words) for _ in range(20_000)), "en"))
    return out


@pytest.mark.parametrize("min_count,top,held", [(4, 2000, 400_000), (9, 15, 50)])
def test_counts_scores_and_ranks(spark, rows, min_count, top, held, monkeypatch):
    """With few entries held, tasks send and merge the same stripes in many pieces."""
    for name in ("HELD", "HELD_WORDS", "HELD_NODES", "EMITTED"):
        monkeypatch.setattr(co, name, held)
    docs = spark.createDataFrame([(k, t, lang, "p", 1) for k, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    found = sorted(tuple(r[c] for c in NAMES) for r in co.mine(docs, min_count, top).collect())
    assert found == plain(rows, min_count, top)
    assert len(found) > 30


def test_full_filters_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "FILTER_BITS", 6)
    docs = spark.createDataFrame([(k, t, lang, "p", 1) for k, (t, lang) in enumerate(rows)], DOCS)
    found = sorted(tuple(r[c] for c in NAMES) for r in co.mine(docs, 6).collect())
    assert found == plain(rows, 6)


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**13, 10**14, 10**13 + 7, 10**13 + 1), (10**12, 9 * 10**18, 10**12 + 3, 10**13), (100, 100, 100, 100), (3, 10, 7, 11)]
    table = spark.createDataFrame(cases, "a long, n long, l long, r long").withColumn("s", F.expr(co.SCORE))
    assert [r.s for r in table.collect()] == [1000 * a * n // (left * right) for a, n, left, right in cases]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert co.mine(empty).count() == 0
    assert co.mine(spark.createDataFrame([(1, None, None, None, None), (2, " \t.", "en", "", 0)], DOCS), 1).count() == 0


def test_a_task_adds_up_in_its_own_thread():
    """Threads that Arrow starts inside a task keep memory of their own, which an executor's limit has no room for."""
    code = """if True:
        import os
        import pyarrow as pa
        from mirrorledger.llm.collocations import _added
        words = pa.array([f"w{k % 40_000}" for k in range(100_000)])
        before = len(os.listdir("/proc/self/task"))
        added = _added([pa.table({"next": words, "n": pa.array([1] * 100_000)}) for _ in range(4)])
        print(len(os.listdir("/proc/self/task")) - before, added.num_rows, sum(added.column("n").to_pylist()))
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["0", "40000", "400000"]


def test_texts_hash_alike_in_pieces(monkeypatch):
    texts = pa.array(["", "ab", None, "ü" * 50, "a", "ab", "x" * 9, ""])
    whole = wordbytes.text_hash(texts)
    monkeypatch.setattr(wordbytes, "HASHED_BYTES", 4)
    assert wordbytes.text_hash(texts).tolist() == wordbytes.text_hash(texts.slice(0)).tolist() == whole.tolist()
    assert wordbytes.text_hash(texts.slice(3, 3)).tolist() == whole[3:6].tolist()
    assert wordbytes.text_hash(pa.array([], pa.string())).tolist() == []


def test_full_counters_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "COUNTER_BITS", 6)
    docs = spark.createDataFrame([(k, t, lang, "p", 1) for k, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    found = sorted(tuple(r[c] for c in NAMES) for r in co.mine(docs, 6).collect())
    assert found == plain(rows, 6)


def test_rare_phrases_of_frequent_words_are_not_sent(spark, monkeypatch):
    """400 words occur often, and next to one another in some 40 000 ways; only one phrase of three words is frequent."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(" ".join(rng.choice(words) for _ in range(500)) + ". one two three", "en") for _ in range(100)]
    sent, merged = [], co.merged

    def counted(stripes, min_count):
        sent.append(stripes.agg(F.sum(F.size("nexts"))).first()[0])
        return merged(stripes, min_count)

    monkeypatch.setattr(co, "merged", counted)
    docs = spark.createDataFrame([(k, t, lang, "p", 1) for k, (t, lang) in enumerate(rows)], DOCS).repartition(2)
    found = sorted(tuple(r[c] for c in NAMES) for r in co.mine(docs, 50).collect())
    assert found == plain(rows, 50) and [r[2] for r in found] == ["one two three"]
    assert sent[1] < 4_000 and sent[2] < 10


def test_rows_sent_do_not_grow_with_the_parts_of_the_input(spark, rows, monkeypatch):
    """A core adds up all it reads, so a prefix is sent once for each core and not once for each part."""
    sent, merged = [], co.merged

    def counted(stripes, min_count):
        found = stripes.groupBy("lang", "prefix", "words").agg(F.countDistinct("key").alias("parts"), F.count("key").alias("n"))
        sent.append(found.agg(F.sum("n"), F.sum("parts")).first())
        return merged(stripes, min_count)

    monkeypatch.setattr(co, "merged", counted)
    docs = spark.createDataFrame([(k, t, lang, "p", 1) for k, (t, lang) in enumerate(rows)], DOCS)
    docs = docs.repartition(5 * spark.sparkContext.defaultParallelism)
    found = sorted(tuple(r[c] for c in NAMES) for r in co.mine(docs, 6).collect())
    assert found == plain(rows, 6)
    assert all(n <= parts * spark.sparkContext.defaultParallelism for n, parts in sent)
