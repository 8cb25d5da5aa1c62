"""URL filter, search, WARC round trip, queries and pipeline."""

import base64
import hashlib
import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from mirrorledger.llm import jaccard, search, urls, warc
from mirrorledger.llm import queries as q
from mirrorledger.llm.rows import ROW_KEY
from test_texts import plain_words

SF = "/root/testdata/sf0.001"
URLS = [
    "http://A.example.NET/en/x?q=/de/", "https://example.net/en", "http://example.net/EN/", "http://x.org/fr/1#a/b", "http://org/fr/",
    "http://example.com/de/?", "http://notexample.com/de/", "http://a.b.example.com/de/x", "http://net", "http://net/", "x://y//en/",
    "no scheme", "", None, "://", "http://u@example.com:80/de/", "http://a.net/\n/x", "a://b.net/c://d.org/fr/",
]


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_equal_the_plain_rule(spark):
    rows = [(k, u, "clash", None) for k, u in enumerate(URLS)] + [(0, URLS[0], "r", "p"), (None, URLS[2], "r", "p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, path string")
    rules = spark.createDataFrame(q.URL_RULES, "host string, path string, verdict string")
    found = Counter(tuple(r) for r in urls.judge(pages, rules).collect())
    assert found == Counter((r[0], *plain_verdict(r[1], q.URL_RULES)) for r in rows)
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert urls.judge(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_many_rules_and_ties(spark):
    rules = [(f"h{k}.org", f"/p{k % 7}", ("block", "allow")[k % 2]) for k in range(3000)]
    rules += [("same.org", "/x", "allow"), ("same.org", "/x", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(k, f"http://w.h{k}.org/p{k % 5}/z") for k in range(4000)] + [(-1, "http://same.org/x")], "page_id bigint, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    for k in range(4000):
        fits = k < 3000 and k % 5 == k % 7
        assert found[k] == ((f"h{k}.org/p{k % 7}", ("block", "allow")[k % 2]) if fits else (None, "allow"))
    assert found[-1] == ("same.org/x", "block")


def plain_search(rows, k):
    split = [plain_words(t) for _, t in rows]
    n, mean = len(rows), sum(map(len, split)) / len(rows)
    df = Counter(w for s in split for w in set(s))
    tfs = [Counter(s) for s in split]
    out = {}
    for (qid, text) in {r for r in rows if r[0] is not None and r[0] % 10 == 0}:
        scores = []
        for (doc_id, _), tf, s in zip(rows, tfs, split, strict=True):
            score = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(s) / mean))
                for w in set(plain_words(text)) & tf.keys()
            )
            if score > 0:
                scores.append((-round(score, 8), doc_id is not None, doc_id))
        if scores:
            out[(qid, text)] = [(s, d) for s, _, d in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


@pytest.mark.parametrize("shard", [10_000, 9])
def test_search_equals_scoring_all(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    keys = {r.k: r.text for r in docs.select(F.xxhash64("text").alias("k"), "text").collect()}
    found = {}
    for r in search.top_k(docs, F.col("doc_id") % 10 == 0, 5).orderBy("rank").collect():
        found.setdefault((r.query_id, keys[r.query_key]), []).append((-round(r.score, 8), r.doc_id))
    assert found == plain_search(rows, 5)


def test_search_of_nothing(no_docs):
    assert search.top_k(no_docs, F.col("doc_id") % 10 == 0).count() == 0


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(k, f"http://h{k % 3}.example.org/p{k}", f"<p>{k % 5}</p>", "c") for k in range(40)]
    rows += [(100, None, None, "c"), (101, "", "", "c"), (None, "http://n/", "<p>1</p>", "c"), (None, None, "only", "c"), rows[3], rows[3],
             (102, "http://x/\r\nWARC-Type: a b", "WARC/1.1\r\n\r\nü" * 50_000, "c")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, key string").repartition(3)


def test_warc_round_trip(spark, odd_pages):
    folder = warc.archive_folder(spark)
    entries = warc.write_archives(odd_pages, folder, archive_bytes=2000)
    assert entries.select("file").distinct().count() > 3
    shards = warc.write_index(entries, folder, block_entries=4)
    wanted = odd_pages.select(warc.url_key(F.col("url")).alias("key"), "page_id")
    found = warc.read_records(warc.lookup(wanted, shards, folder), folder).collect()
    rows = odd_pages.collect()
    best = {}
    for r in rows:
        best[r.html or ""] = max(best.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    want = Counter()
    for r in rows:
        payload, first = (r.html or "").encode(), best[r.html or ""]
        response = first == -1 or r.page_id == first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want[(r.page_id, len(payload), digest, "response" if response else "revisit", None if response else first)] += 1
    assert Counter(tuple(r) for r in found) == want


def test_index_finds_all_captures_of_a_key_and_no_others(spark, odd_pages):
    many = spark.range(300).select(
        F.col("id").alias("page_id"), F.expr("concat('http://a.org/', id % 7)").alias("url"), F.lit("x").alias("html")
    )
    folder = warc.archive_folder(spark)
    entries = warc.write_archives(many, folder)
    shards = warc.write_index(entries, folder, block_entries=5)
    wanted = spark.createDataFrame([("org,a)/3",), ("org,a)/9",), ("",), ("zz",)], "key string")
    found = warc.lookup(wanted, shards, folder, by_page=False).collect()
    assert sorted(r.page_id for r in found) == [k for k in range(300) if k % 7 == 3]
    assert warc.lookup(wanted, [], folder, by_page=False).count() == 0


def test_empty_archives(spark, odd_pages):
    folder = warc.archive_folder(spark)
    entries = warc.write_archives(odd_pages.limit(0), folder)
    assert warc.write_index(entries, folder) == []


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    problem, rows = check.compare(spark, check.connect(SF), SF, name, q.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem
    source = "pages" if name.split("_")[0] in ("op1", "op9", "op10") else "documents"
    if name.split("_")[0] == "op11":
        assert rows == q.table(spark, SF, "conversations").select("conv_id").distinct().count()
    elif name.split("_")[0] not in ("op5", "op7", "op12"):
        assert rows == q.table(spark, SF, source).count()


def test_pipeline_stages(spark, docs):
    """Every stage but the last keeps the columns, and each decision is the one of its operator."""
    sf = "/root/testdata/sf0.01"
    given = q.table(spark, sf, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    kept = steps["near_duplicates"](spark, given, sf)
    found = jaccard.classes(given)
    lows = {r.class_id for r in found.select("class_id").distinct().collect()}
    assert kept.schema == given.schema and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(lows)
    bad = {r.doc_id for r in q.op6_decontamination(spark, sf).where("contaminated").collect()}
    clean = steps["decontamination"](spark, given, sf)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in given.select("doc_id").collect()} - bad
    for name, query, drop in (("toxicity", q.op4_toxicity, 1), ("quality", q.op8_quality, 0)):
        gone = {r.doc_id for r in query(spark, sf).where(F.col("predicted") == drop).collect()}
        assert {r.doc_id for r in steps[name](spark, given, sf).select("doc_id").collect()} == {
            r.doc_id for r in given.select("doc_id").collect()
        } - gone
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 0, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= lows - bad


def test_near_duplicate_stage_keeps_one_of_equal_rows(spark, docs):
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.count() == jaccard.classes(docs).select("class_key").distinct().count()
    assert ROW_KEY not in kept.columns


def test_search_skips_blocks_and_stays_exact(spark):
    """Blocks whose bound is below the k-th best score of this shard or an earlier one are not scored."""
    rng = np.random.default_rng(3)
    topics = [[f"t{t}w{k}" for k in range(40)] for t in range(60)]
    texts = [" ".join(rng.choice(topics[k % 60], 30)) for k in range(2400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    (shard,) = search.build_index(rows).collect()

    def opened():
        return search.Shard(shard.asDict(), shard.words / shard.n, np.zeros(0, np.uint64))

    one = opened()
    for found in search.query_terms(rows.where("doc_id < 3")).collect():
        terms = np.sort(np.array(found.terms, np.int64).view(np.uint64))
        weights = np.ones(len(terms))
        score = one.top([], terms, weights, 10)[1]
        want = np.sort(opened().top([], terms, weights, 10**6)[1])[-10:]
        assert np.allclose(np.sort(score)[-10:], want)
        assert len(one.top([], terms, weights, 10, want[0] * 1.001)[0]) < 10
    assert 0 < one.scored < one.offered / 2


def test_search_opens_few_blocks_for_frequent_terms(spark):
    """Frequent terms are looked at only in blocks whose bound reaches the floor; equal texts score alike in all shards."""
    rng = np.random.default_rng(4)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(3000)]
    texts = [" ".join([*rng.choice(common, 3), *rng.choice(rare, 12)]) for _ in range(1500)]
    texts += texts[:40] * 3
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    (shard,) = search.build_index(rows).collect()
    terms = np.frombuffer(shard.terms, np.uint64)
    df = np.diff(np.frombuffer(shard.first, np.int64))
    often = terms[df > len(texts) / 32]
    assert len(often) == len(common)
    one = search.Shard(shard.asDict(), shard.words / shard.n, often)
    dense = search.Shard(shard.asDict(), shard.words / shard.n, often[:0])
    idf = dict(zip(terms.tolist(), np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)).tolist(), strict=True))
    wanted, all_terms, floors = [], [], []
    for found in search.query_terms(rows.where("doc_id < 40")).collect():
        own = np.sort(np.array(found.terms, np.int64).view(np.uint64))
        weights, common_ones = np.array([idf[t] for t in own.tolist()]), np.isin(own, often)
        pairs = list(zip(np.searchsorted(often, own[common_ones]).tolist(), weights[common_ones].tolist(), strict=True))
        wanted.append((pairs, own[~common_ones], weights[~common_ones]))
        docs, scores = dense.top([], own, weights, 10**6)
        floors.append(np.sort(scores)[-4])
        all_terms.append(dict(zip(docs.tolist(), scores.tolist(), strict=True)))
    for limits in (np.zeros(len(wanted)), np.array(floors) * (1 - 1e-9)):
        for (docs, scores), want in zip(one.top_each(wanted, 4, limits), all_terms, strict=True):
            best = sorted(want.values())[-4]
            assert set(docs.tolist()) == {d for d, s in want.items() if s > best * (1 - 1e-12)}
            assert np.allclose(scores, [want[d] for d in docs.tolist()])
            assert len(set(scores.tolist())) == 1  # the text and its three copies
    assert one.scored < one.offered / 5


def test_search_keeps_only_postings_that_are_added_up(spark):
    """Lists of frequent terms and of terms no query has are let go when a shard is opened; scores stay exact."""
    rng = np.random.default_rng(6)
    common, rare = [f"c{k}" for k in range(300)], [f"r{k}" for k in range(3000)]
    texts = [" ".join([*rng.choice(common, 60, replace=False), *rng.choice(rare, 6)]) for _ in range(900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    (shard,) = search.build_index(rows).collect()
    terms, df = np.frombuffer(shard.terms, np.uint64), np.diff(np.frombuffer(shard.first, np.int64))
    queries = [np.sort(np.array(r.terms, np.int64).view(np.uint64)) for r in search.query_terms(rows.where("doc_id < 20")).collect()]
    vocabulary = np.append(np.unique(np.concatenate(queries)), np.uint64(2**64 - 1))  # its last term is not in the shard
    often = vocabulary[np.isin(vocabulary, terms[df > len(texts) / 32])]
    assert len(often) > 250
    one = search.Shard(shard.asDict(), shard.words / shard.n, often, vocabulary)
    dense = search.Shard(shard.asDict(), shard.words / shard.n, often[:0])
    needed = df[np.isin(terms, vocabulary) & ~np.isin(terms, often)].sum()
    assert len(one.impact) == len(one.posted) == needed < len(dense.impact) / 20
    wanted, want = [], []
    for own in queries:
        own = np.append(own, vocabulary[-1])
        weights, frequent = 1 + rng.random(len(own)), np.isin(own, often)
        pairs = np.stack([np.searchsorted(often, own[frequent]), weights[frequent]], axis=1)
        wanted.append((pairs, np.searchsorted(vocabulary, own[~frequent]), weights[~frequent]))
        docs, scores = dense.top([], own, weights, 10**6)
        first = np.argsort(-scores)[:5]
        want.append(dict(zip(docs[first].tolist(), scores[first].tolist(), strict=True)))
    for (docs, scores), best in zip(one.top_each(wanted, 5, np.zeros(len(wanted))), want, strict=True):
        assert dict(zip(docs.tolist(), scores.tolist(), strict=True)) == pytest.approx(best)


def test_search_groups_queries_with_the_same_frequent_terms(monkeypatch):
    """Every query is in one group, and a group of one language needs the rows of that language only."""
    monkeypatch.setattr(search, "GROUP", 8)
    rng = np.random.default_rng(7)
    rows = [np.sort(rng.choice(20, 8, replace=False)) + 20 * (k % 4) for k in range(32)] + [np.zeros(0, np.int64)]
    order = search._grouped(rows, 80)
    assert sorted(order.tolist()) == list(range(33))
    for a in range(0, 32, 8):
        assert len({k % 4 for k in order[a : a + 8].tolist()}) == 1
    monkeypatch.setattr(search, "GROUPED", 10)
    assert sorted(search._grouped(rows, 80).tolist()) == list(range(33))
    assert len(search._grouped([], 0)) == 0


@pytest.mark.parametrize("held", [4_000_000, 3])
def test_document_frequencies_are_added_up_in_tasks(spark, docs, monkeypatch, held):
    monkeypatch.setattr(search, "SHARD_DOCS", 5)
    monkeypatch.setattr(search, "COUNTED_TERMS", held)
    index = search.build_index(docs)
    all_terms = np.full(1 << 18, -1, np.int64).view(np.uint64)
    found = search.document_frequencies(index, all_terms, index.count()).collect()
    want = Counter(w for r in docs.select("text").collect() for w in set(plain_words(r.text)))
    assert sorted(r.df for r in found) == sorted(want.values())


def test_search_floors_are_the_kth_best_scores(spark):
    rows = [(q, float(s)) for q in range(3) for s in range(q * 2 + 1)]
    found = spark.createDataFrame(rows, "query int, score double")
    assert search._floors(found, 4, 3).tolist() == [0.0, 0.0, 2.0, 0.0]


def test_search_works_out_postings_in_pieces():
    """Beside what a shard keeps (eight bytes a posting) little is held, and sums are the same however they are cut."""
    docs, lists = 4_000, 150
    posted = np.tile(np.arange(docs, dtype=np.uint32), lists)
    tfs = np.random.default_rng(3).integers(1, 9, len(posted)).astype(np.uint32)
    terms, first = np.arange(lists, dtype=np.uint64), np.arange(lists + 1, dtype=np.int64) * docs
    row = {"terms": terms, "first": first, "posted": posted, "tfs": tfs, "lengths": np.arange(1, docs + 1, dtype=np.uint32)}
    row = {c: v.tobytes() for c, v in row.items()}
    tracemalloc.start()
    shard = search.Shard(row, 900.0, terms[:0])
    built = tracemalloc.get_traced_memory()[1]
    weights = np.random.default_rng(4).random(lists)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found = shard._rare_share(terms, weights)
    added = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert built < 16 * len(posted) and added < 16 * len(posted)
    norm = search.K1 * (1 - search.B + search.B * np.arange(1, docs + 1) / 900.0)
    impact = tfs * (search.K1 + 1) / (tfs + norm[posted])
    at_once = np.bincount(posted, np.repeat(weights, docs) * impact, minlength=len(found))
    assert shard.impact.tolist() == impact.tolist() and found.tolist() == at_once.tolist()


def test_search_index_takes_the_shortest_numbers(spark):
    """A posting of a small shard takes two or three bytes (eight before); frequencies of any size stay whole."""
    texts = ["same word here", "same other", "same " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    (shard,) = search.build_index(rows).collect()
    assert (len(shard.posted), len(shard.tfs)) == (6, 2 * 6)
    many = rows.unionByName(spark.createDataFrame([(3, "same " * 70_000)], rows.schema)).coalesce(1)
    (shard,) = search.build_index(many).collect()
    assert (len(shard.posted), len(shard.tfs)) == (7, 4 * 7)
    found = search.top_k(many, F.col("doc_id") == 0).orderBy("rank").collect()
    want = plain_search([(r.doc_id, r.text) for r in many.collect()], 10)
    assert [(-round(r.score, 8), r.doc_id) for r in found] == want[0, texts[0]]
