"""Field, voting and block labeller: exact inference, held-out accuracy, awkward rows."""

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirrorledger.llm import htmltext, labelled, quality, toxicity
from mirrorledger.llm import queries as q
from mirrorledger.llm.wordbytes import Words

SF = "/root/testdata/sf0.1"


def plain_odds(emission, t):
    n = len(emission)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    before = np.array([1.0, 0.0])
    for k in range(n):
        v = (before @ t) * [1, np.exp(emission[k])]
        before = forward[k] = v / v.sum()
    for k in range(n - 2, -1, -1):
        v = t @ (backward[k + 1] * [1, np.exp(emission[k + 1])])
        backward[k] = v / v.sum()
    both = forward * backward
    return both[:, 1] / both[:, 0]


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    counts = np.array([0, 5, 64, 65, 1000, 1, 0, 300])
    emission, t = rng.normal(size=counts.sum()) * 2, np.array([[1, 0.05], [0.4, 0.6]])
    odds, _, _ = toxicity.marginals(emission, counts, t)
    at = 0
    for n in counts:
        assert np.allclose(odds[at : at + n], plain_odds(emission[at : at + n], t))
        at += n


@pytest.fixture(scope="module")
def models(spark):
    return q.toxicity_model(spark, SF), q.quality_model(spark, SF)


def held_out(spark, query, label, folds, out):
    labels = {r.doc_id: r[label] for r in q.table(spark, SF, "labels").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == q.table(spark, SF, "documents").count()
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1
    return [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_of_held_out_documents(spark):
    found = held_out(spark, q.op4_toxicity, "toxic", 4, 2)
    toxic = [p for p, y in found if y]
    clean = [p for p, y in found if not y]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_quality_of_held_out_documents(spark):
    found = held_out(spark, q.op8_quality, "quality", 3, 1)
    assert np.mean([p == y for p, y in found]) > 0.98


def test_scores_of_awkward_rows(spark, docs, no_docs, models):
    for module, model in zip((toxicity, quality), models, strict=True):
        rows = module.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        by_id = {}
        for r in rows:
            by_id.setdefault(r.doc_id, set()).add(r.score)
        assert len(by_id[0]) == 1  # repeated rows
        assert module.score(no_docs, model).count() == 0
    kept = toxicity.keep_clean(docs, models[0])
    assert kept.schema == docs.schema and kept.count() == docs.count()
    assert quality.keep_good(docs, models[1], 0.0).count() == docs.count()


def test_spans_are_byte_offsets(spark, models):
    text = "Êtes-vous that Idiot, pathetic moron and"
    rows = toxicity.score(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), models[0]).collect()
    assert {text.encode()[s.begin : s.end].decode().lower() for s in rows[0].spans} == {"idiot", "pathetic", "moron"}
    assert rows[0].score >= toxicity.THRESHOLD


def test_training_without_labels_or_with_one_class(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    one = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (None, 1, 0), (3, None, None)], none.schema)
    for labels in (none, one):
        assert toxicity.score(docs, toxicity.train(docs, labels)).where("score >= 0.3").count() == 0
        assert quality.score(docs, quality.train(docs, labels)).where("score < 0.5").count() == 0
    assert toxicity.score(no_docs, toxicity.train(no_docs, one)).count() == 0


def test_no_text_is_shuffled_before_the_choice(spark):
    """Labels are joined with digests: without broadcasting, the only exchange of texts is that of the chosen ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = labelled.labels_by_id(q.table(spark, SF, "labels"), "toxic")
        rows, _ = labelled.sample(q.table(spark, SF, "documents"), known, 10)
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", plan)
    assert len(dealt) > 3 and all("text#" in by for columns, by in dealt if "text#" in columns)


def test_chance_of_a_feature():
    found = toxicity.tail(np.array([4, 5, 0, 3, 20]), np.array([4, 6, 5, 3, 36]), 0.11)
    assert found[0] == pytest.approx(0.11**4) and found[1] == pytest.approx(6 * 0.11**5 * 0.89 + 0.11**6)
    assert found[2] == 1 and found[3] == pytest.approx(0.11**3) and found[4] < 1e-9


def test_equal_cosines_vote_in_order():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [1.0, 0.2, 0.3, 0.4, 0.5]])
    near = quality._nearest(cosine, 2)
    assert sorted(near[0]) == [0, 1] and sorted(near[1]) == [0, 4]


def test_texts_left_out_take_no_places_in_the_sample(spark):
    """Of 60 ids of each class the first 40 by the order of choice are long, without a document, or copies of one text."""
    ids = [r.id for r in spark.range(120).orderBy(F.xxhash64("id", F.lit(7))).collect()]
    labels, texts, left = [], [], {0: set(), 1: set()}
    for k, i in enumerate(ids):
        y, turn = k % 2, k // 2
        labels.append((i, y, y))
        text = f"text {i} {'bad' * y}"
        if turn < 20:
            text = "x" * 1001 + text
        elif turn < 30:
            continue
        elif turn < 40:
            text = f"copy {y}"
        if turn >= 20:
            left[y].add(text)
        texts += [(i, text)] * 2
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    for per_class in (20, 21, 100):
        rows, counts = labelled.sample(docs, labelled.labels_by_id(known, "toxic"), per_class, 1000)
        found = {0: set(), 1: set()}
        for r in rows.collect():
            found[r.label].add(r.text)
        assert counts == {0: 60, 1: 60}
        assert all(len(found[y]) == min(per_class, 21) and found[y] <= left[y] for y in (0, 1))
    assert toxicity.train(docs, known, 5, max_bytes=1000).weights is not None
    assert len(quality.train(docs, known, 5, max_bytes=1000).labels) == 10
    both = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, label int")
    same = spark.createDataFrame([(1, "same"), (2, "same")], "doc_id bigint, text string")
    assert [tuple(r) for r in labelled.sample(same, both, 5)[0].collect()] == [("same", 1)]


def test_pages_left_out_take_no_places_in_the_sample(spark, monkeypatch):
    ids = [r.id for r in spark.range(30).orderBy(F.xxhash64("id", F.lit(7))).collect()]
    rows = [(i, "<p>" + "x" * 2000 if k < 10 else "<p>copy" if k < 20 else f"<p>page {i}") for k, i in enumerate(ids)]
    pages = spark.createDataFrame([*rows, (None, "<p>no id"), (None, None)], "page_id bigint, html string")
    seen = []
    monkeypatch.setattr(htmltext, "fit", lambda vectors, labels: None)
    monkeypatch.setattr(htmltext, "_made", lambda texts, n: seen.append(texts) or [])
    htmltext.train(pages, 100, max_bytes=1000)
    assert sorted(seen[0]) == sorted(["copy", "no id", *(f"page {i}" for i in ids[20:])])
    htmltext.train(pages.where("page_id IS NOT NULL"), 8, max_bytes=1000)
    assert len(seen[1]) == 8


def test_voting_equals_all_cosines(models):
    model = models[1]
    texts = pa.array(["the and of that with this from", "WAS!! THE!! OF!! AND!!", "the the the the the the the"])
    points = model.latent(quality.raw_features(texts))
    want = []
    for p in points:
        cosine = model.vectors @ p
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = np.exp(quality.SHARPNESS * cosine[near])
        want.append((vote * model.labels[near]).sum() / vote.sum())
    assert np.allclose(model.scores(texts), want, atol=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(1);</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now today.</div>
<article><h1>A title &amp; more</h1><p><b>First  line of <i>te</i>xt here.<br><p>Second&nbsp;line, with 3 &lt; 4 and <a href="x">a link</a>.</p></article>
<footer>&copy; example &middot; All rights.</footer></body></html>"""


def test_blocks():
    found = [(b.text, b.path[-1]) for b in htmltext.blocks(PAGE)]
    assert found == [
        ("Home", "li"), ("News", "li"), ("Buy this now today.", "div ad"), ("A title & more", "h1"),
        ("First line of text here.", "p"), ("Second line, with 3 < 4 and a link.", "p"), ("© example · All rights.", "footer"),
    ]
    for broken in ("", "<", "<p", "a<b", "<!-- open", "<script>var", "<p>x</p", "</p></div>y", "<p>a<p>b", "x" * 100_000):
        htmltext.blocks(broken)
    assert [b.text for b in htmltext.blocks("<p>a<p>b<script>no")] == ["a", "b"]


BODY = "<article><p>text of it</p></article>"


@pytest.mark.parametrize(
    "head",
    [
        "<html><head><title>t</title><body>", "<head><meta charset=utf-8><link rel=x href=y><title>t</title><script>x</script>",
        "<HEAD><TITLE>t</TITLE><noscript><link href=y></noscript><style>p{}</style>\n", "<title>t</title></head>", "<head></head><body>",
        "<head><noscript><img src=x>", "<head><head><title>t</title><BODY class=b>",
    ],
)
def test_a_head_ends_without_its_end_tag(head):
    (found,) = htmltext.blocks(head + BODY)
    assert found.text == "text of it" and found.path[-2:] == ("article", "p") and "head" not in found.path
    assert [b.text for b in htmltext.blocks(head + "plain" + BODY)] == ["plain", "text of it"]


def test_formulas_and_fallback_content_are_judged():
    def texts(page):
        return [(b.text, b.path[-1]) for b in htmltext.blocks(page)]

    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>, so.") == [("Let x = 1 2, so.", "p")]
    for tag in ("noscript", "object", "canvas"):
        assert texts(f"<article><{tag}>in its <b>place</b></{tag}>, and on</article>") == [("in its place", tag), (", and on", "article")]
    assert texts("<svg><g><text>a <tspan>label</tspan></text></g></svg>") == [("a label", "text")]
    assert texts("<title-bar>shown</title-bar><script-note>too") == [("shown", "title-bar"), ("too", "script-note")]
    gone = "<textarea>a</textarea><select><option>b</select><iframe>c</iframe><template><p>d</template><style>e</style>"
    assert texts(gone + "<p>left") == [("left", "p")]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<p title=it's>Hello world. Don't drop this</p><p>More</p>", ["Hello world. Don't drop this", "More"]),
        ("<p title='d'oh'>kept text</p><p>it's next</p>", ["kept text", "it's next"]),
        ("<p a=b'c\"d>x</p><p a = 'e>f' =g \"h>y", ["x", "y"]), ("<p a= >x<p a>y<p a/b>z", ["x", "y", "z"]),
        ("<p>a<!-->b</p><p>c</p>", ["ab", "c"]), ("<p>a<!--->b</p><p>c</p>", ["ab", "c"]), ("<p>a<!-- x --!>b</p><p>c", ["ab", "c"]),
        ("<p>a<!-- > -- > <p> ---->b", ["ab"]), ("<article/>x<p>y</p></article>", ["x", "y"]), ("<a href=/x/>l</a> m", ["l m"]),
        ("<svg><g/><text/>t</svg><p>u", ["t", "u"]), ("<script>a</script x>b", ["b"]), ("<p>a<p b='c>d", ["a"]), ("<p>a<", ["a<"]),
    ],
)
def test_tags_and_comments_end_where_html_ends_them(page, texts):
    assert [b.text for b in htmltext.blocks(page)] == texts


def test_a_slash_opens_an_element_outside_drawings():
    found = htmltext.blocks("<article/>x<svg><g/><text>t</text><foreignObject><p/>u</foreignObject></svg></article>y")
    assert [(b.text, tuple(b.path)) for b in found] == [
        ("x", ("article",)), ("t", ("article", "svg", "text")), ("u", ("article", "svg", "foreignobject", "p")), ("y", ()),
    ]


@pytest.mark.parametrize("part", ["<div>t", "<b>", "</i>t", "<p>t", "<p a='", "<a ", "<!--", "<", "<b><p>t</i>"])
def test_a_very_long_page_takes_time_in_proportion(part):
    def seconds(n):
        begin = time.process_time()
        vectors = htmltext.Vectors().page(htmltext.blocks(part * n))
        return time.process_time() - begin, len(vectors)

    seconds(1000)
    (short, few), (long, many) = seconds(4000), seconds(32000)
    assert long < 24 * short + 0.5
    assert many == 8 * few or few <= 1


def test_a_path_is_judged_with_all_around_it():
    made = htmltext.Vectors().page(htmltext.blocks("<article><div class='x comments'><p>t</p></div><p>t</p></article>"))
    plain = [("article", "div x comments", "p"), ("article", "p")]
    assert (made == htmltext.Vectors().page([htmltext.Block("t", path, 0) for path in plain])).all()
    assert made[:, -htmltext.MEASURES : -htmltext.MEASURES + 2].tolist() == [[1, 1], [1, 0]]


def test_made_layouts_leave_tags_out():
    cases = list(htmltext.layouts(["Some words of prose to fill the pages with."], 200))
    assert any("</head>" not in page for page, _ in cases) and any("<body>" not in page for page, _ in cases)
    for page, kept in cases:
        found = [b.text for b in htmltext.blocks(page)]
        assert all(k in found for k in kept)
    assert all(any(f"<{tag}>" in page for page, _ in cases) for tag in ("math", "noscript"))


def test_article_text_of_a_page_without_head_end(spark):
    pages = q.table(spark, "/root/testdata/sf0.001", "pages")
    short = PAGE.replace("</head><body>", "").replace("</body></html>", "")
    rows = htmltext.extract(spark.createDataFrame([(1, "u", short)], "page_id bigint, url string, html string"), htmltext.train(pages)).collect()
    assert rows[0].text == "A title & more\n\nFirst line of text here.\n\nSecond line, with 3 < 4 and a link."


def test_gradient_of_the_recurrent_network():
    rng = np.random.default_rng(3)
    n = htmltext.HIDDEN
    model = htmltext.Model(
        rng.normal(0, 0.2, (2, htmltext.WIDTH, 4 * n)), rng.normal(0, 0.2, (2, n, 4 * n)), rng.normal(0, 0.2, (2, 4 * n)),
        rng.normal(0, 0.2, 2 * n + 1),
    )
    pages = [rng.normal(size=(k, htmltext.WIDTH)).astype(np.float32) for k in (3, 1, 5)]
    labels = [rng.integers(0, 2, len(p)).astype(float) for p in pages]

    def loss():
        p = np.concatenate(htmltext.probabilities(model, pages))
        y = np.concatenate(labels)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = htmltext._gradient(model, pages, labels)
    for name in ("wx", "wh", "bias", "out"):
        weights, g = getattr(model, name), getattr(grad, name)
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = weights[at]
        weights[at] = old + 1e-2
        up = loss()
        weights[at] = old - 1e-2
        down = loss()
        weights[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-5)


def test_article_text(spark):
    pages = q.table(spark, "/root/testdata/sf0.01", "pages")
    model = htmltext.train(pages)
    odd = spark.createDataFrame(
        [(1, "u", PAGE, 5), (2, None, None, 6), (None, "u", "", 7), (1, "u", PAGE, 5), (4, "u", "<p>x", 8)],
        "page_id bigint, url string, html string, text int",
    )
    rows = htmltext.extract(odd, model).collect()
    want = "A title & more\n\nFirst line of text here.\n\nSecond line, with 3 < 4 and a link."
    assert [r.text for r in rows if r.page_id == 1] == [want, want]
    assert [r.text for r in rows if r.page_id in (2, None)] == ["", ""]
    assert htmltext.extract(odd.limit(0), model).count() == 0
    htmltext.train(odd.limit(0))
    # All pages of the table mark their article, so the labeller can be held against the marks.
    for r, p in zip(htmltext.extract(pages, model).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        marked = [b.text for b in htmltext.blocks(p.html) if any(s.split()[0] == "article" for s in b.path)]
        assert r.text == "\n\n".join(marked)


def test_made_layouts_not_trained_on():
    rng = np.random.default_rng(0)
    texts = [" ".join("abcdefgh"[: rng.integers(1, 8)] for _ in range(rng.integers(3, 60))) + "." for _ in range(100)]
    cases = list(htmltext._made(texts, 700))
    vectors = htmltext.Vectors()
    pages, labels = [vectors.page(f) for f, _ in cases], [y.astype(np.float32) for _, y in cases]
    model = htmltext.fit(pages[:600], labels[:600])
    judged = np.concatenate(htmltext.probabilities(model, pages[600:])) >= 0.5
    assert (judged == (np.concatenate(labels[600:]) > 0.5)).mean() > 0.97


def told_apart(words, tags):
    """Pages of paragraphs that are alike but for one word in their middle, which alone says if they are article text."""
    rng = np.random.default_rng(4)
    pages, labels = [], []
    for _ in range(240):
        label, parts = rng.integers(0, 2, 8), []
        for y in label:
            text = [f"w{rng.integers(30)}" for _ in range(10)]
            text[rng.integers(2, 7)] = words[y]
            parts.append("<p>same four first words " + " ".join(text) + " last words.</p>")
        pages.append(htmltext.blocks(f"<{tags}>" + "".join(parts) + f"</{tags}>"))
        labels.append(label.astype(np.float32))
    vectors = htmltext.Vectors()
    vectors = [vectors.page(f) for f in pages]
    model = htmltext.fit(vectors[:200], labels[:200], epochs=20)
    return ((np.concatenate(htmltext.probabilities(model, vectors[200:])) >= 0.5) == (np.concatenate(labels[200:]) > 0.5)).mean()


def test_words_inside_a_block_count():
    assert told_apart(("advert", "report"), "div") > 0.9
    path = ("body", "div")
    long = ["start of a block", *["word " * 5000] * 2, "end of it"]
    a, b = (" ".join([*long[:2], middle, *long[2:]]) for middle in ("alpha", "omega"))
    found = htmltext.Vectors().page([htmltext.Block(a, path, 0), htmltext.Block(b, path, 0), htmltext.Block(a, path, 0)])
    found[:, -1] = 0  # the place
    assert (found[0] != found[1]).any() and (found[0] == found[2]).all()


def test_remembered_words_are_bounded(monkeypatch):
    texts = [" ".join(f"w{k * j}" for k in range(1, 40)) + " " + "x" * 100 for j in range(1, 9)]
    blocks = [htmltext.Block(t, ("p",), 0) for t in texts]
    want = htmltext.Vectors().page(blocks)
    monkeypatch.setattr(htmltext, "KNOWN_WORDS", 10)
    vectors = htmltext.Vectors()
    assert (vectors.page(blocks) == want).all() and len(vectors.slots) <= 10


def test_model_words_are_shared(models):
    words = Words(pa.array(["a b c", None]))
    scores, p = models[0].scores(words)
    assert len(scores) == 2 and len(p) == 3
