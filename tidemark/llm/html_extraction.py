"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has
a vector of its tag path (hashed tags, classes and ids of its ancestors), one of its
hashed words, and a few figures of its shape. A bidirectional LSTM in numpy reads the
page's blocks in order and labels each as main text or not, so every decision sees
the whole page. The blocks labelled main text are the result, one line each.

The labeller is trained when the operator runs. ``SYNTHETIC`` training pages with
known labels come from a seeded generator: most have no semantic markup, and their
containers carry other names or none. To them come up to ``FIT_PAGES`` of the given
pages that tell their article by semantic markup (chosen by hash of the id), as they
are and with that markup renamed and further notices, forms, sidebars and comments
put in. So pages without such markup are read like others, even if no page has any.
Training is seeded, so reruns agree.

Nulls and edges: null or empty html, or a page without text, gives an empty text; a
null url stays null. Elements whose text is no content (``HIDDEN_TAGS``) end with
their own end tag, with a container around them or with the next block-level tag
where HTML lets that tag end them; one that is closed in itself or never ended hides
nothing but its own line of markup. Other unclosed tags and comments run to the end
of the page. Nesting may be of any depth, in memory that grows with the blocks.
Repeated rows and null ids are labelled like any other. Pages are not shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk

#: Given pages the labeller is trained on at most, and most bytes of each that a training page may have.
FIT_PAGES, FIT_BYTES = 160, 1 << 16
#: Generated training pages.
SYNTHETIC = 320
PATH_CELLS, WORD_CELLS, SHAPE, HIDDEN = 96, 32, 8, 16
EPOCHS, BATCH, RATE, SEED = 10, 16, 0.01, 7
INPUT = PATH_CELLS + WORD_CELLS + SHAPE

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not parsed as markup and is no content.
RAW_TAGS = frozenset("script style title textarea iframe noframes xmp".split())
#: Elements whose text is no content.
HIDDEN_TAGS = frozenset("noscript template svg math object select option optgroup datalist button audio video canvas map".split())
#: Hidden elements that the start of a block-level element ends.
BROKEN_OUT = frozenset("svg math select option optgroup datalist".split())
BLOCK_TAGS = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table td th tr ul".split())
#: Opening one of these ends an open one of the set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
_BARRIERS = frozenset("div ul ol table article section td".split()) | HIDDEN_TAGS - {"option", "optgroup"}

MAIN = frozenset("article main".split())
OTHER = frozenset("nav header footer aside form menu dialog address".split())
#: Names that mark a container in class or id.
MAIN_NAMES = frozenset("content post entry article story main body text".split())
OTHER_NAMES = frozenset("ad ads advert advertisement banner promo sponsored menu nav navbar navigation header footer sidebar aside notice cookie alert popup comment comments reply replies share social related subscribe newsletter form login search breadcrumb breadcrumbs pagination widget copyright".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: What training pages tell of an element: 1 main text, 0 something else.
_TOLD = re.compile(r"\bdata-told=([01])")
_SPACE = re.compile(r"\s+")
_BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(BLOCK_TAGS))})\b", re.I)


class Block:
    """Text of a leaf and what leads to it.

    ``tag`` is the innermost element, ``cells`` the counts of hashed names on the path,
    ``depth`` its length, ``other`` and ``main`` how many of its steps are named so,
    ``links`` the characters inside links and ``told`` the label: 1, 0 or -1 (none).
    """

    __slots__ = ("tag", "text", "links", "cells", "depth", "other", "main", "told")

    def __init__(self, tag: str, text: str, links: int, cells: np.ndarray, depth: int, other: int, main: int, told: int) -> None:
        self.tag, self.text, self.links, self.cells = tag, text, links, cells
        self.depth, self.other, self.main, self.told = depth, other, main, told


@lru_cache(maxsize=4096)
def _cell(name: str) -> int:
    return crc32(name.encode()) % PATH_CELLS


class _Path:
    """The open elements, with figures kept as they open and close, so that a block costs the same at any depth."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, tuple[int, ...], int, int, bool, int]] = []
        self.open: Counter = Counter()
        self.cells = np.zeros(PATH_CELLS, np.int32)
        self.other = self.main = self.hidden = 0

    def push(self, tag: str, attributes: str) -> None:
        names = [x for got in _NAMES.findall(attributes) for part in got if part for x in re.split(r"[\s_-]+", part.lower()) if x] if "=" in attributes else []
        other = int(tag in OTHER or not OTHER_NAMES.isdisjoint(names))
        main = int(tag in MAIN or not MAIN_NAMES.isdisjoint(names))
        before = self.steps[-1][5] if self.steps else -1
        # semantic markup tells an article, and names tell what is none; a training page's own word goes before
        told = 0 if before == 0 or other else 1 if before == 1 or tag in MAIN else -1
        if m := _TOLD.search(attributes):
            told = int(m[1])
        cells = tuple(_cell(x) for x in (tag, *names))
        for c in cells:
            self.cells[c] += 1
        hidden = tag in HIDDEN_TAGS
        self.steps.append((tag, cells, other, main, hidden, told))
        self.open[tag] += 1
        self.other, self.main, self.hidden = self.other + other, self.main + main, self.hidden + hidden

    def pop(self) -> str:
        tag, cells, other, main, hidden, _ = self.steps.pop()
        for c in cells:
            self.cells[c] -= 1
        self.open[tag] -= 1
        self.other, self.main, self.hidden = self.other - other, self.main - main, self.hidden - hidden
        return tag

    def close(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def ends_before(self, tag: str) -> str | None:
        """The open element that the start of ``tag`` ends, if any."""
        ended = CLOSES.get(tag)
        if ended and any(self.open[t] for t in ended):
            for step in reversed(self.steps):
                if step[0] in ended:
                    return step[0]
                if step[0] in _BARRIERS:
                    break
        return None

    def break_out(self) -> None:
        """Ends the hidden elements that a block-level start ends, with all in them."""
        while self.hidden and any(self.open[t] for t in BROKEN_OUT):
            self.pop()

    def block(self, text: str, links: int) -> Block:
        return Block(self.steps[-1][0] if self.steps else "", text, links, self.cells.copy(), len(self.steps), self.other, self.main, self.steps[-1][5] if self.steps else -1)


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order, white space collapsed and character references decoded."""
    out: list[Block] = []
    path = _Path()
    text: list[str] = []
    links = inside = 0
    at, html = 0, html or ""
    last_end: dict[str, int] = {}

    def ended_later(tag: str) -> bool:
        """Whether an end tag of ``tag`` stands anywhere after the place reached."""
        if tag not in last_end:
            places = [m.start() for m in re.finditer(rf"</{tag}\b", html, re.I)]
            last_end[tag] = places[-1] if places else -1
        return last_end[tag] >= at

    def end() -> None:
        nonlocal links
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append(path.block(whole, links))
            text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not path.hidden:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if inside:
                links += len(plain)

    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                inside = 0 if m[1] else 1
            continue
        if m[1]:
            if path.open[tag]:
                # hidden elements that were not ended go with what is around them
                while path.hidden and path.steps[-1][0] != tag and tag not in HIDDEN_TAGS:
                    path.pop()
                if not path.hidden:
                    end()
                path.close(tag)
            continue
        if tag in RAW_TAGS:
            if ended_later(tag):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            elif not m[3].endswith("/"):
                # never ended: what is up to the next block-level tag is its own
                start = _BLOCK_START.search(html, at)
                at = start.start() if start else len(html)
            continue
        if tag in HIDDEN_TAGS:
            if m[3].endswith("/") or not ended_later(tag) and tag not in ("option", "optgroup"):
                continue
        else:
            if tag in BLOCK_TAGS:
                path.break_out()
            if not path.hidden:
                end()
                inside = 0
        before = path.ends_before(tag)
        if before:
            path.close(before)
        if tag not in VOID and not m[3].endswith("/"):
            path.push(tag, m[3])
    add(html[at:])
    end()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row for each block."""
    n = len(page)
    out = np.zeros((n, INPUT), np.float32)
    np.sqrt(np.stack([b.cells for b in page]), out=out[:, :PATH_CELLS])
    data = [b.text.lower().encode() for b in page]
    offsets = np.cumsum([0, *map(len, data)])
    w = wk.words(offsets, np.frombuffer(b"".join(data), np.uint8), 0, n)
    cells = (wk.word_hashes(w) % np.uint64(WORD_CELLS)).astype(np.int64)
    counts = np.bincount(w.doc * WORD_CELLS + cells, minlength=n * WORD_CELLS).reshape(n, WORD_CELLS)
    out[:, PATH_CELLS : PATH_CELLS + WORD_CELLS] = counts / np.maximum(w.counts, 1)[:, None]
    size = np.array([len(b.text) for b in page], np.float32)
    shape = [
        np.log1p(size) / 8,
        np.array([b.links for b in page]) / size,
        np.arange(n) / max(n - 1, 1),
        np.array([b.tag == "p" for b in page]),
        np.log1p([b.depth for b in page]) / 3,
        np.array([b.tag[:1] == "h" and b.tag[1:].isdigit() for b in page]),
        np.array([b.other > 0 for b in page]),
        np.array([b.main > 0 for b in page]),
    ]
    out[:, PATH_CELLS + WORD_CELLS :] = np.stack(shape, axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {}
        for side in "fb":
            self.w[f"x{side}"], self.w[f"h{side}"] = start(INPUT, 4 * HIDDEN), start(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w[f"b{side}"] = bias
        self.w["o"], self.w["c"] = start(2 * HIDDEN, 1), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, live: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of pages x steps; dead steps carry the state on."""
        n, steps, _ = x.shape
        pre = x @ self.w[f"x{side}"] + self.w[f"b{side}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, held = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = live[:, t, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep:
                held.append((t, i, f, o, g, c, h, s, on))
            c = np.where(on, new, c)
            h = np.where(on, o * s, h)
            out[:, t] = h
        return out, held

    def scores(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, live, side, False)[0] for side in "fb"], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["c"])[..., 0]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over labelled blocks (y of 0 or 1; -1: none) and its gradients."""
        runs = {side: self._run(x, live, side, True) for side in "fb"}
        both = np.concatenate([runs[side][0] for side in "fb"], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["c"])[..., 0]
        told = (live & (y >= 0)).astype(np.float32)
        many = max(told.sum(), 1)
        loss = float(-(told * np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum() / many)
        d = (told * (p - np.maximum(y, 0)) / many).astype(np.float32)[..., None]
        grads = {"o": (both * d).sum(axis=(0, 1))[:, None], "c": d.sum(axis=(0, 1))}
        d_both = d @ self.w["o"].T
        for k, side in enumerate("fb"):
            d_out = d_both[..., k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            grads[f"h{side}"] = np.zeros_like(self.w[f"h{side}"])
            for t, i, f, o, g, c, h, s, on in reversed(runs[side][1]):
                dh = dh + d_out[:, t]
                go = np.where(on, dh, 0)
                ds = np.where(on, dc, 0) + go * o * (1 - s * s)
                dz = np.concatenate([ds * g * i * (1 - i), ds * c * f * (1 - f), go * s * o * (1 - o), ds * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                grads[f"h{side}"] += h.T @ dz
                dh = dz @ self.w[f"h{side}"].T + np.where(on, 0, dh)
                dc = np.where(on, ds * f, dc)
            grads[f"x{side}"] = np.einsum("ntj,ntk->jk", x, dz_all, optimize=True)
            grads[f"b{side}"] = dz_all.sum(axis=(0, 1))
        return loss, grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> float:
        """Adam over batches of pages of like length; returns the last epoch's mean loss."""
        rng = np.random.default_rng(SEED)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        order, step, mean = sorted(range(len(pages)), key=lambda k: len(pages[k][0])), 0, 0.0
        batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for _ in range(epochs):
            losses = []
            for b in rng.permutation(len(batches)):
                x, live = padded([pages[k][0] for k in batches[b]])
                y = np.full(live.shape, -1, np.int64)
                for row, k in enumerate(batches[b]):
                    y[row, : len(pages[k][1])] = pages[k][1]
                loss, grads = self.gradients(x, live, y)
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses)) if losses else 0.0
        return mean


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max((len(p) for p in pages), default=0)
    x, live = np.zeros((len(pages), most, INPUT), np.float32), np.zeros((len(pages), most), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], live[k, : len(p)] = p, True
    return x, live


#: Names of containers of training pages; the first word is the tag, an empty second part has no class.
MAIN_AS = ("article", "main", "div content", "div post", "div entry-content", "div article-body", "div story", "section text", "div main-text", "div page", "td", "div", "div", "div", "section")
OTHER_AS = {
    "nav": ("nav", "div menu", "div navbar", "ul navigation", "div breadcrumbs", "div", "div top"),
    "header": ("header", "div header", "div site-header", "header masthead"),
    "footer": ("footer", "footer", "div footer", "div site-footer", "div copyright", "div"),
    "aside": ("aside", "div sidebar", "div related", "div widget", "div"),
    "notice": ("div notice", "div cookie", "div alert", "div banner", "section notice", "dialog"),
    "ad": ("div ad", "div ads", "div advert", "div promo", "div sponsored", "aside ad"),
    "form": ("form", "form search", "div newsletter", "form login"),
    "comments": ("section comments", "div comments", "div comment-list", "ol comments", "div replies"),
}
#: What such parts often say.
_SAID = {
    "notice": ("We use cookies to improve this site.", "Accept all cookies", "Your browser is out of date."),
    "footer": ("\u00a9 2024 All rights reserved.", "\u00a9 the site", "Copyright", "Terms of use", "Privacy policy"),
    "form": ("Sign in", "Subscribe to our newsletter", "Your e-mail address", "Search"),
    "comments": ("Reply", "Thanks for this post", "Great article!"),
    "ad": ("Advertisement", "Sponsored", "Buy now and save"),
    "header": ("Welcome", "Home"),
    "aside": ("Related", "Most read", "Popular posts"),
    "nav": ("Home", "About", "Contact", "Next", "News"),
}
_SYLLABLES = "an ter in ver de la th er on re ti ou he st el qu es ad mi no so ra be un ge ch ha li or ma".split()


class _Pages:
    """A seeded generator of training pages with known labels."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def one(self, of):
        return of[int(self.rng.integers(len(of)))]

    def many(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def words(self, low: int, high: int, shout: str = "") -> str:
        got = ["".join(self.one(_SYLLABLES) for _ in range(self.many(1, 4))) + (self.one(("", "", "", ",", ".")) if k % 3 else "") for k in range(self.many(low, high))]
        said = " ".join(x + shout for x in got)
        return (said.upper() if shout else said.capitalize()) + self.one((".", "", "."))

    def wrapped(self, named: str, inner: str, told: int | None = None) -> str:
        tag, *names = named.split()
        if names:
            name = f" {self.one(('class', 'class', 'id'))}=" + self.one(('"{}"', "'{}'")).format(" ".join(names))
        else:
            name = ""
        return f"<{tag}{name}{'' if told is None else f' data-told={told}'}>{inner}</{tag}>"

    def other(self, kind: str) -> str:
        """A part that is no main text; one without a name is told by its links, its place or what it says."""
        named = self.one(OTHER_AS[kind])
        bare = named == "div"
        link = kind == "nav" or bare and kind == "aside" or kind in ("aside", "footer") and self.chance(0.4)
        said = []
        for _ in range(self.many(1, 8) if link or kind in ("comments", "aside") else self.many(1, 2)):
            own = self.one(_SAID[kind]) if self.chance(0.5) or bare and kind == "footer" else self.words(1, 5 if link else 40)
            said.append(f'<a href="/{self.many(0, 999)}">{own}</a>' if link else own)
        how = self.many(0, 2) if not link else self.many(0, 3)
        if how == 0 and len(said) == 1:
            inner = said[0]
        elif how < 2:
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in said) + "</ul>"
        elif how == 2:
            inner = "".join(self.wrapped("div comment" if kind == "comments" and self.chance(0.5) else "p", x) for x in said)
        else:
            inner = " | ".join(said)
        return self.wrapped(named, inner, 0)

    def article(self) -> str:
        """Main text: headings, paragraphs of all lengths, lists, tables and loose lines."""
        shout = self.one(("", "", "", "!!", "###", "%%%"))
        most = self.one((4, 12, 40, 120))
        out = [self.wrapped(self.one(("h1", "h1", "h2")), self.words(1, 12, shout))] if self.chance(0.8) else []
        if self.chance(0.15):
            out.append("<br>".join(self.words(1, most, shout) for _ in range(self.many(1, 5))))
        for _ in range(self.one((1, 1, 2, 4, 8, 16))):
            kind, said = self.rng.random(), self.words(1, most, shout)
            if kind < 0.75:
                out.append(f"<p>{self.one(('', '', '<b>', '<em>x</em> '))}{said}{self.one(('</p>', '</p>', '<br>', ''))}")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 20)}" for _ in range(self.many(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(self.wrapped("h2", self.words(1, 8)))
            elif kind < 0.95:
                out.append(self.wrapped(self.one(("blockquote", "pre")), said))
            elif self.chance(0.5):
                out.append(f'<p><a href="/x">{self.words(1, 6)}</a> {said}</p>')
            else:
                out.append("<table><tr><td>" + self.words(1, 5) + "<td>" + self.words(1, 5) + "</table>")
            if self.chance(0.06):
                out.append(self.other(self.one(("ad", "notice", "form"))))
        return "".join(out)

    def page(self) -> str:
        named = self.one(MAIN_AS)
        main = self.wrapped(named, self.article(), 1)
        if named == "td":
            main = f"<table><tr>{main}</tr></table>"
        first = [self.other(k) for k in ("notice", "header", "nav", "ad", "aside", "form") if self.chance(0.4 if k != "nav" else 0.8)]
        last = [self.other(k) for k in ("ad", "aside", "form", "comments", "footer") if self.chance(0.3 if k != "footer" else 0.8)]
        inner = "".join([*first, main, *last])
        for _ in range(self.many(0, 2)):
            if self.chance(0.5):
                inner = self.wrapped(self.one(("div", "div wrapper", "div container", "div page", "div site")), inner)
        return f"<html><head><title>x</title></head><body>{inner}</body></html>"

    def changed(self, html: str) -> str:
        """A given page with its article's markup renamed and other parts put in."""
        tag, *names = self.one([x for x in MAIN_AS if x != "td"]).split()
        start = f"<{tag} " + (f'class="{" ".join(names)}" ' if names else "") + "data-told=1"
        html = re.sub(r"<(?:article|main)\b", start, html, flags=re.I)
        html = re.sub(r"</(?:article|main)\b", f"</{tag}", html, flags=re.I)
        for kind in self.rng.permutation(sorted(OTHER_AS)):
            if self.chance(0.25):
                late = kind in ("footer", "comments", "aside")
                html = re.sub(r"(?=</body>)" if late else r"(?<=<body>)", lambda _: self.other(kind), html, count=1, flags=re.I)
        if self.chance(0.2):
            html = re.sub(r"</p>", lambda m: m[0] + self.other(self.one(("ad", "notice", "form"))), html, count=1, flags=re.I)
        return html


def training_pages(htmls: list[str], synthetic: int = SYNTHETIC) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of generated pages and of ``htmls``, each as it is and twice changed."""
    made, out = _Pages(SEED), []
    pages = [made.page() for _ in range(synthetic)]
    for html in htmls:
        pages += [html, made.changed(html), made.changed(html)]
    for html in pages:
        page = blocks(html)
        labels = np.array([b.told for b in page])
        if len(labels) and labels.max() == 1:
            out.append((features(page), labels))
    return out


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Labeller:
    """The labeller trained on generated pages and on ``fit_pages`` pages of ``id, html`` that tell their article, those of least hash (all, if there are fewer; equal rows count once)."""
    known = pages.where((F.octet_length("html") <= FIT_BYTES) & F.col("html").rlike(r"(?i)<(?:article|main)\b"))
    # the hashes are ordered without the pages, so that a task sends hashes only and the sample alone comes to the driver
    known = known.select("html", F.xxhash64("id", "html").alias("hash"))
    hashes = [r[0] for r in known.select("hash").distinct().orderBy("hash").limit(fit_pages).collect()]
    sample = known.where(F.col("hash") <= hashes[-1]).groupBy("hash").agg(F.first("html").alias("html")).orderBy("hash").select("html").collect() if hashes else []
    out = Labeller()
    out.train(training_pages([r[0] for r in sample]))
    return out


_OUT = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = model.value
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                pages = [blocks(h) for h in part.column("html").to_pylist()]
                # a page without any element has nothing to be told apart by: all its text stays, unless most of it is links
                bare = [all(b.depth == 0 and 2 * b.links <= len(b.text) for b in page) for page in pages]
                texts = ["\n".join(b.text for b in page) if plain else "" for page, plain in zip(pages, bare)]
                order = sorted((k for k in range(len(pages)) if not bare[k]), key=lambda k: len(pages[k]))
                at = 0
                while at < len(order):
                    # pages of like length, of at most so many steps in all
                    end = at + 1
                    while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= 8192:
                        end += 1
                    own = order[at:end]
                    scores = labeller.scores(*padded([features(pages[k]) for k in own]))
                    for row, k in enumerate(own):
                        texts[k] = "\n".join(b.text for b, s in zip(pages[k], scores[row]) if s >= 0.5)
                    at = end
                yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string())], schema=_OUT)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; other columns are not read."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    model = rows.sparkSession.sparkContext.broadcast(fit(rows, fit_pages))
    out = rows.mapInArrow(_extract(model), "id long, url string, text string")
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
