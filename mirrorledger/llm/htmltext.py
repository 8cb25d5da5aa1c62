"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between tags that are not inline. Each block gives a vector of hashed parts of its tag
path (tags, classes, ids), the hashed words of its whole text, those at its ends once more, and a few measures (length,
share of link text, place). A bidirectional LSTM in
numpy reads the blocks of the whole page in order, so a block is judged by what stands before and after it, and a
logistic output tells article text from the rest. Pages of a slice are run side by side.

It is trained by backpropagation on page layouts made by ``layouts`` (articles with menus, headers, footers, side columns,
notices, adverts, forms and comments, with semantic tags or with class names only), whose texts come from a bounded sample
of the pages' own blocks, and on the blocks of that sample whose semantic tags leave no doubt.

White space inside a block becomes one space; blocks are joined in page order by two line ends; character references are
decoded. A head ends where HTML ends it, also without its end tag: at text and at the first tag that can't stand in it.
Formulas (MathML) are part of the text around them, their tokens apart by blanks; texts of drawings and what stands in for scripts, objects and canvases
are blocks like others. Only titles, scripts, styles, templates, frames and the contents of form fields are never text.
Tags and comments end where HTML ends them: quotes count only where a value begins, ``<!-->`` and ``--!>`` end a comment,
a slash closes a tag in drawings and formulas only.
A null page, and one without article blocks, has an empty text; a block of probability 0.5 is article text. A page that
ends inside a tag, a quoted value, a comment or a script loses that unfinished part only. A page of any length is read whole,
in time and memory in proportion to it, however deep its tags. Repeated rows get equal rows; empty tables give empty results. Only ``page_id``,
``url`` and ``html`` are read, so other columns may have any name.
"""

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_TEXT_BYTES, chosen, texts_of
from .wordbytes import sliced

PATH_DIMS = 64
END_DIMS = 32
WORD_DIMS = 64
MEASURES = 8
WIDTH = PATH_DIMS + END_DIMS + WORD_DIMS + MEASURES
KNOWN_WORDS = 200_000
LONG_WORD = 64  # longer words are not remembered
FADE = np.float32(0.85)  # what each step farther out weighs less
HIDDEN = 16
SAMPLE_PAGES = 200
LAYOUTS = 600
EPOCHS = 8
BATCH = 32
STEP = 0.01

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr tspan textpath math maction merror mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none "
    "semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of a page.
HIDDEN_ELEMENTS = frozenset("script style template textarea select option title iframe".split())
#: Tags that leave a head open.
HEAD_ELEMENTS = frozenset("html head title base basefont bgsound link meta script style template noscript noframes".split())
_FORMULA_TOKENS = frozenset("mi mn mo ms mtext annotation annotation-xml".split())
_RAW = "script|style|template|textarea|title|iframe"
#: Quotes count only at the beginning of a value; the group holds the last value without them.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|([^\s>"'][^\s>]*+))?)?)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<({_RAW})(?![^\s/>])[^>]*(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_FOREIGN = frozenset({"svg", "math"})  # in them a slash closes a tag, elsewhere it says nothing
_BACK_IN_HTML = frozenset({"foreignobject", "desc"})
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_KEEPS = re.compile(r"\b(?:article|main)\b")
_DROPS = re.compile(
    r"\b(?:nav|header|footer|aside|form|button|menu|dialog|comments?|sidebar|cookie|notice|ads?|advert|sponsored|promo|banner|"
    r"newsletter|related|share|social|breadcrumb|widget|popup)\b"
)


@lru_cache(maxsize=20_000)
def _marks(step: str) -> tuple[bool, bool]:
    return bool(_KEEPS.search(step)), bool(_DROPS.search(step))


class Path(Sequence):
    """Tags with their class, id and role names, outermost first. Paths share their beginnings, so that they take no more
    room than the page's tags, however deep."""

    __slots__ = ("up", "step", "depth", "keeps", "drops", "vector")

    def __init__(self, up: "Path | None" = None, step: str = ""):
        self.up, self.step, self.vector = up, step, None
        self.depth, self.keeps, self.drops = 0, False, False
        if up is not None:
            keeps, drops = _marks(step)
            self.depth, self.keeps, self.drops = up.depth + 1, up.keeps or keeps, up.drops or drops

    def __len__(self) -> int:
        return self.depth

    def __getitem__(self, at):
        steps, node = [], self
        while node.up is not None:
            steps.append(node.step)
            node = node.up
        return tuple(reversed(steps))[at]


@dataclass
class Block:
    text: str
    path: Sequence[str]
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The page's texts in order, each with where it stands."""
    found: list[Block] = []
    # Of each open element: tag, path without inline tags, place of the innermost one that is not inline, foreign or not.
    stack: list[tuple[str, Path, int, bool]] = [("", Path(), 0, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = hidden = links = heads = at = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            found.append(Block(text, stack[-1][1], min(linked, len(text))))
        parts.clear()
        linked = 0

    def end_head() -> None:
        """Takes an open head, and what is open in it, off the stack."""
        if heads:
            cut(next(k for k, opening in enumerate(stack) if opening[0] == "head"))

    def cut(depth: int) -> None:
        """Closes the open elements from this place on."""
        for name, *_ in stack[depth:]:
            leave(name)
        del stack[depth:]

    def add(text: str) -> None:
        nonlocal linked
        if heads and text.strip():
            end_head()
        if not hidden and text:
            parts.append(text)
            linked += len(text) if links else 0

    def leave(tag: str) -> None:
        nonlocal hidden, links, heads
        opened[tag] -= 1
        hidden -= tag in HIDDEN_ELEMENTS
        links -= tag == "a"
        heads -= tag == "head"

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1] and m[1].lower() not in HEAD_ELEMENTS:
                end_head()
            continue
        tag = m[3].lower()
        if not m[2] and tag not in HEAD_ELEMENTS:
            end_head()
        if tag not in INLINE:
            close()
        elif tag == "br" or (tag in _FORMULA_TOKENS and not m[2]):
            parts.append(" ")
        foreign = tag in _FOREIGN or (stack[-1][3] and tag not in _BACK_IN_HTML)
        if m[2]:
            if opened[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
        elif tag not in VOID and not (foreign and m[4].endswith("/") and m.end(5) != m.end(4)):
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd"):  # end tags that pages leave out
                if stack[stack[-1][2]][0] == tag:
                    cut(stack[-1][2])
            path, block = stack[-1][1:3]
            if tag not in INLINE:
                names = " ".join(x for got in _NAMES.findall(m[4]) for x in got if x).lower()
                path, block = Path(path, f"{tag} {names}".strip()), len(stack)
            stack.append((tag, path, block, foreign))
            opened[tag] += 1
            hidden += tag in HIDDEN_ELEMENTS
            links += tag == "a"
            heads += tag == "head"
    add(page[at:])
    close()
    return found


def _slot(name: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode())
    return h % dims, 1.0 if h & 0x80000000 else -1.0


class _Slots(dict):
    """Slot of each word: below ``WORD_DIMS`` it counts up, from there on down. Cleared when full."""

    def __missing__(self, word: str) -> int:
        slot, sign = _slot(word, WORD_DIMS)
        slot += WORD_DIMS * (sign < 0)
        if len(word) <= LONG_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = slot
        return slot


class Vectors:
    """Vectors of blocks; hashes of names and words are remembered up to a bound."""

    def __init__(self):
        self.steps: dict[str, np.ndarray] = {}
        self.slots = _Slots()

    def step(self, step: str) -> np.ndarray:
        if step not in self.steps:
            if len(self.steps) > 20_000:
                self.steps.clear()
            v = np.zeros(PATH_DIMS, np.float32)
            for part in _PARTS.findall(step):
                slot, sign = _slot(part, PATH_DIMS)
                v[slot] += sign
            self.steps[step] = v
        return self.steps[step]

    def path(self, path: Path) -> np.ndarray:
        """The steps' vectors, each weighing less the farther out it is: the path around it, faded, plus the last step."""
        open_, node = [], path
        while node.vector is None and node.up is not None:
            open_.append(node)
            node = node.up
        outer = np.zeros(PATH_DIMS, np.float32) if node.vector is None else node.vector
        for node in reversed(open_):
            outer = node.vector = FADE * outer + self.step(node.step)
        return outer

    def words(self, words: list[str]) -> np.ndarray:
        """Signed counts of all words by slot, as a unit vector, so that long blocks weigh as much as short ones."""
        counts = np.bincount(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)), minlength=2 * WORD_DIMS)
        v = (counts[:WORD_DIMS] - counts[WORD_DIMS:]).astype(np.float32)
        return v / max(np.sqrt(v @ v), 1)

    def page(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), WIDTH), np.float32)
        for k, b in enumerate(found):
            path = b.path if isinstance(b.path, Path) else reduce(Path, b.path, Path())
            out[k, :PATH_DIMS] = self.path(path)
            words = b.text.lower().split()
            for word in words[:4] + words[-2:]:  # what a block says at its ends tells menus and notices from prose
                slot, sign = _slot(word, END_DIMS)
                out[k, PATH_DIMS + slot] += 0.3 * sign
            out[k, PATH_DIMS + END_DIMS : -MEASURES] = self.words(words)
            n = len(b.text)
            out[k, -MEASURES:] = (
                path.keeps,
                path.drops,
                path.depth / 10,
                np.log1p(n) / 5,
                b.linked / n,
                min(len(words), 50) / 50,
                b.text[-1] in ".!?…\"'”»",
                k / len(found),
            )
        return out


@dataclass
class Model:
    """Two LSTMs (forward, backward) and the output weights; gates in the order input, forget, output, candidate."""

    wx: np.ndarray  # 2 x WIDTH x 4 HIDDEN
    wh: np.ndarray  # 2 x HIDDEN x 4 HIDDEN
    bias: np.ndarray  # 2 x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pages as (time, page, feature), and which places are filled; backward pages begin with their last block."""
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    real = np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p[::-1] if backward else p
        real[: len(p), k] = True
    return x, real


def _run(model: Model, d: int, x: np.ndarray, real: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction. Pages end one by one: their state stays as it is."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c = np.zeros_like(h)
    states, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
    gates = x @ model.wx[d] + model.bias[d]
    for t in range(len(x)):
        z = gates[t] + h @ model.wh[d]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        tanh_c = np.tanh(new_c)
        if keep:
            trace.append((h, c, i, f, o, g, tanh_c))
        on = real[t][:, None]
        h, c = np.where(on, o * tanh_c, h), np.where(on, new_c, c)
        states[t] = h
    return states, trace


def _unroll(pages: list[np.ndarray], states: np.ndarray, backward: bool) -> list[np.ndarray]:
    return [states[: len(p), k][::-1] if backward else states[: len(p), k] for k, p in enumerate(pages)]


def probabilities(model: Model, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page the probability of each block. Pages of like length run together."""
    result: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    for a in range(0, len(order), 256):
        some = [pages[k] for k in order[a : a + 256]]
        both = [_unroll(some, _run(model, d, *_padded(some, d == 1), keep=False)[0], d == 1) for d in (0, 1)]
        for k, forward, backward in zip(order[a : a + 256], *both, strict=True):
            result[k] = _sigmoid(np.concatenate([forward, backward], axis=1) @ model.out[:-1] + model.out[-1])
    return result


def _gradient(model: Model, pages: list[np.ndarray], labels: list[np.ndarray]) -> Model:
    """Gradient of the mean cross-entropy of a batch, by backpropagation through time."""
    runs = [(_padded(pages, d == 1), d) for d in (0, 1)]
    found = [_run(model, d, x, real, True) for (x, real), d in runs]
    hidden = [_unroll(pages, states, d == 1) for (states, _), d in zip(found, (0, 1), strict=True)]
    both = [np.concatenate(pair, axis=1) for pair in zip(*hidden, strict=True)]
    total = sum(map(len, pages))
    miss = [(_sigmoid(v @ model.out[:-1] + model.out[-1]) - y) / total for v, y in zip(both, labels, strict=True)]
    flat, error = np.concatenate(both), np.concatenate(miss)
    grad = Model(*(np.zeros_like(w) for w in (model.wx, model.wh, model.bias)), np.append(flat.T @ error, error.sum()))
    for ((x, real), d), (_, trace) in zip(runs, found, strict=True):
        weight = model.out[:HIDDEN] if d == 0 else model.out[HIDDEN:-1]
        into = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for k, e in enumerate(miss):
            into[: len(e), k] = (e[::-1] if d else e)[:, None] * weight
        dh, dc = np.zeros(into.shape[1:], np.float32), np.zeros(into.shape[1:], np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tanh_c = trace[t]
            on = real[t][:, None]
            dh = dh + into[t]
            do, down = dh * tanh_c, dc + dh * o * (1 - tanh_c**2)
            dz = np.concatenate(
                [down * g * i * (1 - i), down * c * f * (1 - f), do * o * (1 - o), down * i * (1 - g**2)], axis=1
            ) * on
            grad.wx[d] += x[t].T @ dz
            grad.wh[d] += h.T @ dz
            grad.bias[d] += dz.sum(axis=0)
            dh, dc = np.where(on, dz @ model.wh[d].T, dh), np.where(on, down * f, dc)
    return grad


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> Model:
    """Adam from a fixed start."""
    rng = np.random.default_rng(1)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

    bias = np.zeros((2, 4 * HIDDEN), np.float32)
    bias[:, HIDDEN : 2 * HIDDEN] = 1
    model = Model(start(2, WIDTH, 4 * HIDDEN), start(2, HIDDEN, 4 * HIDDEN), bias, np.zeros(2 * HIDDEN + 1, np.float32))
    names = ("wx", "wh", "bias", "out")
    mean, square = ({n: np.zeros_like(getattr(model, n)) for n in names} for _ in range(2))
    filled = [k for k in range(len(pages)) if len(pages[k])]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(filled)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            grad = _gradient(model, [pages[k] for k in batch], [labels[k] for k in batch])
            step += 1
            for n in names:
                g = getattr(grad, n)
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * g * g
                move = mean[n] / (1 - 0.9**step) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)
                setattr(model, n, (getattr(model, n) - STEP * move).astype(np.float32))
    return model


def layouts(texts: list[str], n: int) -> Iterator[tuple[str, list[str]]]:
    """Made pages and their article's blocks. ``texts``: prose to fill them with."""
    rng, odd = np.random.default_rng(2), np.random.default_rng(4)
    texts = [t for t in texts if t] or ["text"]

    def pick(*choices: str) -> str:
        return choices[rng.integers(len(choices))]

    def prose(most: int = 400) -> str:
        return texts[rng.integers(len(texts))][: rng.integers(20, most)].strip() or "text"

    def short() -> str:
        return " ".join(prose(60).split()[: rng.integers(1, 5)])

    def wrap(tag: str, names: str, inner: str) -> str:
        return f'<{tag} {pick("class", "class", "id")}="{names}">{inner}</{tag}>' if names else f"<{tag}>{inner}</{tag}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.integers(3, 9)))
        return wrap(*pick_pair(("nav", ""), ("div", "menu"), ("div", "navigation"), ("ul", "nav"), ("div", "breadcrumb")), f"<ul>{items}</ul>")

    def pick_pair(*pairs: tuple[str, str]) -> tuple[str, str]:
        return pairs[rng.integers(len(pairs))]

    def side() -> str:
        kind = rng.integers(8)
        if kind == 0:
            return wrap(*pick_pair(("aside", ""), ("div", "sidebar"), ("div", "related"), ("section", "recommended posts")),
                        f"<h3>{short()}</h3>" + "".join(f"<p><a href='/y'>{short()}</a> {prose(80)}</p>" for _ in range(rng.integers(1, 4))))
        if kind == 1:
            return wrap("div", pick("ad", "ads", "advert", "banner ad", "sponsored", "promo"), prose(150))
        if kind == 2:
            return wrap("div", pick("cookie", "cookie notice", "notice", "alert", "consent", "gdpr popup"), f"<p>{prose(150)}</p><button>{short()}</button>")
        if kind == 3:
            return wrap("form", pick("", "subscribe", "newsletter", "search"), f"<label>{short()}</label><input type=text><p>{prose(80)}</p><button>{short()}</button>")
        if kind == 4:
            said = "".join(f'<div class="{pick("comment", "reply")}"><b>{short()}</b><p>{prose(200)}</p></div>' for _ in range(rng.integers(1, 5)))
            return wrap(*pick_pair(("section", "comments"), ("div", "comments"), ("div", "disqus thread comments"), ("ol", "comment list")), f"<h3>{short()}</h3>{said}")
        if kind == 5:
            return wrap("div", pick("share", "social", "tags", "author bio", "meta byline"), f"<a href='/z'>{short()}</a> {short()}")
        if kind == 6:
            return f"<!-- {short()} --><div class='widget'>{prose(60)}</div>"
        return f"<script>var t='</p>';{short()}</script><style>p{{margin:0}}</style>"

    def fallback() -> str:
        tag, text = ("noscript", "noscript", "object", "canvas")[odd.integers(4)], texts[odd.integers(len(texts))]
        return f"<{tag}><p>{entities.escape(text[: odd.integers(20, 150)])}</p></{tag}>" if odd.random() < 0.1 else ""

    for _ in range(n):
        kept: list[str] = []

        def keep(text: str, kept=kept) -> str:
            kept.append(_SPACE.sub(" ", text).strip())
            return entities.escape(text)

        body = f"<h1>{keep(short())}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.integers(1, 14)):
            kind, text = rng.random(), prose(pick_most(rng))
            if kind < 0.6:
                formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>" if odd.random() < 0.05 else ""
                opens = ("<p>", "<p title=it's>", "<!--><p>", "<!-- x --!><p/>")[int(odd.choice(4, p=(0.85, 0.05, 0.05, 0.05)))]
                body += f"{opens}{keep(text)}{formula}</p>"
                kept[-1] += " x = 2" if formula else ""
            elif kind < 0.75:
                body += f"<p><b>{keep(text)}<br><p>{keep(prose(300))}</p>"
            elif kind < 0.8:
                body += f"<h2>{keep(short())}</h2>"
            elif kind < 0.86:
                body += "<ul>" + "".join(f"<li>{keep(prose(90))}</li>" for _ in range(rng.integers(1, 4))) + "</ul>"
            elif kind < 0.9:
                body += f"<blockquote>{keep(text)}</blockquote>"
            elif kind < 0.94:
                body += f"<div>{keep(text)}</div>"
            elif kind < 0.97:
                body += side()
            else:
                body += f'<p><a href="/q">{keep(short())}</a></p>'
        tag, names = pick_pair(("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "entry content"), ("section", "article text"))
        article = wrap(tag, names, body)
        if rng.random() < 0.3:
            article = wrap("main", "", article) if rng.random() < 0.5 else wrap("div", pick("page", "wrapper", "container"), article)
        before = "".join(part() for part in (menu, side, side) if rng.random() < 0.6)
        if rng.random() < 0.4:
            before = wrap(*pick_pair(("header", ""), ("div", "header"), ("div", "top bar")), f"<p>{short()}</p>{before}") + (side() if rng.random() < 0.3 else "")
        after = "".join(side() for _ in range(rng.integers(0, 4)))
        if rng.random() < 0.8:
            after += wrap(*pick_pair(("footer", ""), ("footer", ""), ("div", "footer")), f"&copy; {short()} &middot; {prose(90)}" + (menu() if rng.random() < 0.2 else ""))
        # HTML lets the tags that end a head and begin and end a body be left out.
        opens, ends = (("</head><body>", "</body></html>"), ("<body>", "</body>"), ("", ""))[int(odd.choice(3, p=(0.6, 0.2, 0.2)))]
        page = f"<!DOCTYPE html><html><head><title>{short()}</title>{opens}{fallback()}{before}{article}{after}{fallback()}{ends}"
        yield page, kept


def pick_most(rng: np.random.Generator) -> int:
    return int((60, 200, 600)[rng.integers(3)])


def _made(texts: list[str], n: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    for page, kept in layouts(texts, n):
        found, left = blocks(page), 0
        label = np.zeros(len(found))
        for k, b in enumerate(found):
            if left < len(kept) and b.text == kept[left]:
                label[k] = 1
                left += 1
        yield found, label


def _marked(found: list[Block]) -> np.ndarray | None:
    """Labels by semantic tags, or None where a page has no article or main element."""
    keep = np.array([b.path.keeps and not b.path.drops for b in found], float)
    return keep if keep.any() else None


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, made: int = LAYOUTS, max_bytes: int = MAX_TEXT_BYTES) -> Model:
    """Fits on at most ``sample`` different pages of at most ``max_bytes`` each, chosen by a hash of their ids, and ``made``
    layouts filled with their texts."""
    rows = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    picked = chosen(rows, "page_id", "html", max_bytes).orderBy("__place", "__key").limit(sample)
    rows = texts_of(rows, "page_id", "html", picked).select("html").distinct()
    known = [blocks(h) for h in sorted(rows.toArrow().column("html").to_pylist())]
    texts = [b.text for found in known for b in found]
    cases = [(found, label) for found in known if (label := _marked(found)) is not None] + list(_made(texts, made))
    vectors = Vectors()
    return fit([vectors.page(found) for found, _ in cases], [label.astype(np.float32) for _, label in cases])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """One row per page: page_id, url, text."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for piece in sliced(batch, "html"):
                found = [blocks(h) for h in piece.column("html").to_pylist()]
                judged = probabilities(shared.value, [vectors.page(f) for f in found])
                texts = [
                    "\n\n".join(b.text for b, p in zip(f, ps, strict=True) if p >= 0.5)
                    for f, ps in zip(found, judged, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
