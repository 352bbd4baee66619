"""Main text of web pages: a recurrent labeller over the page's text blocks.

A page is read into its blocks, the pieces of text between block-level tags, each with the path of
open tags (names, ids and classes). A bidirectional LSTM in numpy reads one vector a block - hashed
path, hashed words, numbers of the block and of what holds it - over the whole page and labels every block;
blocks labelled as main text are joined in page order. Scripts, styles, templates, comments and markup are no
text; what formulas, objects and drawings hold is text like any other.

The labeller is trained here, on made-up pages whose labels are known by construction (a fixed
number of pages and a fixed seed), once per driver process. On half of them parts have no names, names of the
page's own or one for all, many have no telling tags either or are laid out as tables, so that it learns to
tell by links, lengths and places what no name says.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

# Fixed values of the HTML standard, by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags whose content is no text of the page. The last of them are ordinary tags where they are not closed.
RAW_TAGS = frozenset("script style template iframe textarea noembed noframes".split())
TO_THE_END = frozenset("script style".split())
CLOSES_P = BLOCK_TAGS - frozenset("body head html title option optgroup caption td th tr tbody thead tfoot button".split())
#: A tag that ends an open one of the same list.
SIBLINGS = {t: group for group in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for t in group}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}

# A tag ends at its sign, before the next tag or with the page.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")

#: Tags that hold parts of a page.
BOXES = frozenset("article aside body details dialog div dl fieldset footer form header main nav ol section td th ul".split())

PATHS, WORDS, NUMBERS = 192, 16, 16
WIDTH = PATHS + WORDS + NUMBERS
#: Made-up pages that the labeller is trained on.
PAGES = 3000
#: Blocks of a page that are labelled at a time; longer pages go in segments that hand on their state.
SEGMENT = 8192


@dataclass(slots=True)
class Block:
    text: str
    places: bytes  # of the path's tokens, a bit each: 1 where there is one
    depth: int  # tokens of the path
    linked: int  # characters of the text inside links
    box: int  # number of the innermost tag of BOXES around it
    outer: int  # and of the next one


@lru_cache(maxsize=200_000)
def _place(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=20_000)
def _tokens(name: str, attributes: str) -> tuple[int, ...]:
    """Places of a tag's tokens: its name, its classes and ids, and both together."""
    found = [name]
    for m in _NAMES.finditer(attributes):
        found += [f"{name}.{t}" for t in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if t]
        found += [f".{t}" for t in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if t]
    return tuple(_place(t, PATHS) for t in found)


class _Path:
    """The open tags, with the places of all their tokens counted, so that a block costs the same at any depth."""

    def __init__(self):
        self.open: list[tuple[str, tuple[int, ...]]] = []
        self.at: dict[str, list[int]] = {}  # where each name is open
        self.counts = np.zeros(PATHS, np.int64)
        self.depth = 0
        self.boxes, self.made = [0, 0], 0  # the first two stand for the page

    def last(self, *names: str) -> int:
        """Where the innermost of the names is open, -1 if none is."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, name: str, tokens: tuple[int, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, tokens))
        self.depth += len(tokens)
        if name in BOXES:
            self.made += 1
            self.boxes.append(self.made)
        for t in tokens:
            self.counts[t] += 1

    def close(self, at: int) -> None:
        """Close the tag at a place and all inside it."""
        while len(self.open) > at:
            name, tokens = self.open.pop()
            self.at[name].pop()
            if name in BOXES:
                self.boxes.pop()
            self.depth -= len(tokens)
            for t in tokens:
                self.counts[t] -= 1


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, white space inside a block as one space; tolerates missing end tags."""
    page = page or ""
    out: list[Block] = []
    path = _Path()
    held: list[str] = []
    linked = 0
    unclosed: set[str] = set()  # raw tags that no end tag follows any more

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, np.packbits(path.counts > 0).tobytes(), path.depth, linked, path.boxes[-1], path.boxes[-2]))
            held = []
        linked = 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            held.append(text)
            if path.at.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW_TAGS and not m[1] and not m[3].endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end or name in TO_THE_END:
                at = end.end() if end else len(page)
                continue
            unclosed.add(name)
        block = name in BLOCK_TAGS
        if block:
            flush()
        elif name == "br":
            held.append(" ")
        if m[1]:
            if (i := path.last(name)) >= 0:
                path.close(i)
            continue
        if name in CLOSES_P and (i := path.last("p")) >= 0:
            path.close(i)
        if name in SIBLINGS and (i := path.last(*SIBLINGS[name])) > path.last(*HOLDS[name]):
            path.close(i)
        if name not in VOID_TAGS:
            path.push(name, _tokens(name, m[3]))
    flush()
    return out


def _surroundings(page: list[Block]) -> np.ndarray:
    """Eight numbers a block, of what holds it and of what holds that: share of the page, links, mean block, and whether the block before is in it."""
    chars, linked = np.array([len(b.text) for b in page], float), np.array([b.linked for b in page], float)
    out = []
    for numbers in (np.array([b.box for b in page]), np.array([b.outer for b in page])):
        _, own = np.unique(numbers, return_inverse=True)
        total, count = np.bincount(own, chars)[own], np.bincount(own)[own]
        before = np.concatenate([[False], own[1:] == own[:-1]])
        out += [total / chars.sum(), np.minimum(1, np.bincount(own, linked)[own] / total), np.log1p(total / count) / 8, before]
    return np.stack(out, axis=1).astype(np.float32)


def vectors(page: list[Block], around: np.ndarray | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
    """One row a block from ``first`` to ``last``: hashed path, hashed words, numbers of the block and its surroundings in the page."""
    around = _surroundings(page) if around is None and page else around
    some = page[first:last]
    x = np.zeros((len(some), WIDTH), np.float32)
    for i, b in enumerate(some):
        x[i, :PATHS] = np.unpackbits(np.frombuffer(b.places, np.uint8))
        w = b.text.split()
        counts = np.bincount([_place(t, WORDS) for t in w], minlength=WORDS)
        x[i, PATHS : PATHS + WORDS] = counts / len(w) if w else 0
        n = len(b.text)
        x[i, PATHS + WORDS : WIDTH - 8] = (np.log1p(n) / 8, np.log1p(len(w)) / 6, min(1, b.linked / n), b.text[-1] in ".!?\"'”»", sum(b.text.count(c) for c in ".,;") / (len(w) + 1), (first + i) / len(page), min(4, b.depth / 16), 1)
    if some:
        x[:, WIDTH - 8 :] = around[first : first + len(some)]
    return x


class Labeller:
    """Bidirectional LSTM with one logistic output a block."""

    def __init__(self, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        s = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"wx{d}": s(WIDTH, 4 * hidden), f"wh{d}": s(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p |= {"wo": s(2 * hidden, 1), "wx": s(WIDTH, 1), "bo": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """x: (pages, blocks, WIDTH). Padding leaves the state as it is; the last state comes back."""
        n, t, _ = x.shape
        k = self.hidden
        h, c = state or (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
        out, trace = np.zeros((n, t, k), np.float32), []
        gates = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = gates[:, i] + h @ self.p[f"wh{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * k], -30, 30)))
            g = np.tanh(a[:, 3 * k :])
            m = mask[:, i : i + 1]
            c2 = s[:, k : 2 * k] * c + s[:, :k] * g
            tc = np.tanh(c2)
            h2 = s[:, 2 * k :] * tc
            if keep:
                trace.append((i, h, c, s, g, tc, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[:, i] = h
        return out, trace, (h, c)

    def _output(self, x: np.ndarray, f: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([f, b], axis=2)
        z = (both @ self.p["wo"] + x @ self.p["wx"] + self.p["bo"])[:, :, 0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), both

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf, _ = self._run(x, mask, "f", keep)
        b, tb, _ = self._run(x, mask, "b", keep)
        p, both = self._output(x, f, b)
        return p, both, {"f": tf, "b": tb}

    def _label_long(self, page: list[Block]) -> np.ndarray:
        """A page in segments: from the end first, keeping the state before each, then from the start with both directions' states."""
        around, cuts = _surroundings(page), range(0, len(page), SEGMENT)
        part = lambda lo: vectors(page, around, lo, lo + SEGMENT)[None]
        mask = np.ones((1, SEGMENT), np.float32)
        behind, state = {}, None
        for lo in reversed(cuts):
            behind[lo] = state
            state = self._run(x := part(lo), mask[:, : x.shape[1]], "b", False, state)[2]
        out, state = np.zeros(len(page), bool), None
        for lo in cuts:
            x = part(lo)
            own = mask[:, : x.shape[1]]
            f, _, state = self._run(x, own, "f", False, state)
            out[lo : lo + x.shape[1]] = self._output(x, f, self._run(x, own, "b", False, behind[lo])[0])[0][0] >= 0.5
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, traces = self.forward(x, mask, True)
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)
        flat = lambda v: v.reshape(-1, v.shape[-1])
        g = {"wo": flat(both).T @ dz.reshape(-1, 1), "wx": flat(x).T @ dz.reshape(-1, 1), "bo": np.array([dz.sum()], np.float32)}
        dboth = dz[:, :, None] * self.p["wo"][:, 0]
        k = self.hidden
        for d, part in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dwh = np.zeros_like(self.p[f"wh{d}"])
            da_all = np.zeros((*part.shape[:2], 4 * k), np.float32)
            for i, h, c, s, gg, tc, m in reversed(traces[d]):
                dh = dh + part[:, i]
                live, o = dh * m, s[:, 2 * k :]
                dc2 = dc * m + live * o * (1 - tc * tc)
                da = np.concatenate([dc2 * gg, dc2 * c, live * tc, dc2 * s[:, :k]], axis=1)
                da[:, : 3 * k] *= s * (1 - s)
                da[:, 3 * k :] *= 1 - gg * gg
                dwh += h.T @ da
                da_all[:, i] = da
                dh = dh * (1 - m) + da @ self.p[f"wh{d}"].T
                dc = dc * (1 - m) + dc2 * s[:, k : 2 * k]
            g |= {f"wh{d}": dwh, f"wx{d}": flat(x).T @ flat(da_all), f"b{d}": da_all.sum((0, 1))}
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = 10, batch: int = 12, rate: float = 0.02) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        rng, step = np.random.default_rng(5), 0
        order = np.argsort([len(x) for x, _ in pages], kind="stable")  # pages of like length together
        for done in range(passes):
            now = rate * (1 - 0.9 * done / passes)
            for at in batch * rng.permutation(-(-len(order) // batch)):
                some = [pages[i] for i in order[at : at + batch]]
                x, mask = pad([s[0] for s in some])
                y = np.zeros(mask.shape, np.float32)
                for i, s in enumerate(some):
                    y[i, : len(s[1])] = s[1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """True for the blocks of main text. Pages of like length go through together, a bounded amount at a time."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order and len(pages[order[-1]]) > SEGMENT:
            i = order.pop()
            out[i] = self._label_long(pages[i])
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and (end - at + 1) * len(pages[order[end]]) <= 8192:
                end += 1
            some = order[at:end]
            x, mask = pad([vectors(pages[i]) for i in some])
            p, _, _ = self.forward(x, mask)
            for row, i in enumerate(some):
                out[i] = p[row, : len(pages[i])] >= 0.5
            at = end
        return out


def pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask = np.zeros((len(xs), t, WIDTH), np.float32), np.zeros((len(xs), t), np.float32)
    for i, r in enumerate(xs):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


# --- made-up pages ---------------------------------------------------------------------------

_SYLLABLES = "an ba ci do el fu ga hi ja ko la mi no or pa qui ra se ti un va we xi yo za é ö ñ ch th".split()


class _Maker:
    """Pages with known labels: blocks of the main article hold the mark, and no others do."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.known = ["".join(_SYLLABLES[i] for i in self.r.integers(len(_SYLLABLES), size=int(self.r.integers(1, 4)))) for _ in range(4000)]

    def one(self, *options):
        """One of the options; what a function makes is made only if it is the one."""
        own = options[int(self.r.integers(len(options)))]
        return own() if callable(own) else own

    def maybe(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, lo: int, hi: int) -> str:
        n = int(self.r.integers(lo, hi + 1))
        w = [self.known[i] for i in self.r.integers(len(self.known), size=n)]
        style = self.r.random()
        if style < 0.08:
            w = [x.upper() + "!!" for x in w]
        elif style < 0.16:
            mark = self.one("***", "$$$", "%%%", "&amp;&amp;", "###")
            w = [x + mark for x in w]
        elif style < 0.2:
            w = [w[0]] * n
        w[0] = w[0].capitalize()
        for i in range(5, n, 9):
            w[i] += self.one(",", ".", ";", "")
        return " ".join(w) + self.one(".", ".", "", "!")

    def style(self) -> None:
        """How this page names its parts: as usual, not at all, by words of its own or all alike; and whether by tags that say what they are."""
        self.naming = self.one("usual", "usual", "usual", "none", "own", "own", "alike")
        self.telling = self.naming == "usual" or self.maybe(0.4)
        self.names: dict[str, str] = {}

    def tag(self, name: str) -> str:
        return name if self.telling else "div"

    def named(self, tag: str, *names: str) -> str:
        """The tag with one of the names as class or id, and at times another that says nothing."""
        own = self.one("class", "class", "id")
        tag = tag if self.telling or tag not in ("section", "aside") else "div"
        if self.naming == "none":
            return f"<{tag}>"
        if self.naming != "usual":
            if names[0] not in self.names:
                self.names[names[0]] = "box" if self.naming == "alike" else self.one("", "x-", "l-", "zq-") + self.known[int(self.r.integers(4000))]
            return f'<{tag} class="{self.names[names[0]]}">'
        extra = self.one("", "", " " + self.one("wrap", "block", "clearfix", "row", "widget"))
        return f'<{tag} {own}="{self.one(*names)}{extra}">'

    def link_list(self, lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a>' + self.one("</li>", "</li>", "") for i in range(int(self.r.integers(lo, hi)))) + "</ul>"

    def menu(self) -> str:
        if self.telling and self.maybe(0.6):
            return "<nav>" + self.link_list(3, 9) + "</nav>"
        return self.named("div", "nav", "menu", "navbar", "navigation", "breadcrumb", "topmenu", "navegacion", "menue", "migas") + self.one(self.link_list(2, 8), " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(4))) + "</div>"

    def header(self) -> str:
        inside = self.one(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 9)}</p>", f'<a href="/">{self.words(1, 3)}</a>', "") + (self.menu() if self.maybe(0.4) else "")
        return "<header>" + inside + "</header>" if self.telling and self.maybe(0.6) else self.named("div", "header", "masthead", "site-header", "banner", "topbar", "kopf", "cabecera", "entete") + inside + "</div>"

    def footer(self) -> str:
        inside = f"&copy; {self.words(1, 4)} &middot; {self.words(3, 12)}" if self.maybe(0.6) else f"<p>{self.words(3, 15)}</p>" + (self.link_list(2, 5) if self.maybe(0.4) else "")
        return "<footer>" + inside + self.one("</footer>", "</footer>", "</footer>", "") if self.telling and self.maybe(0.7) else self.named("div", "footer", "site-footer", "bottom", "copyright", "colophon", "fuss", "pie", "pied") + inside + "</div>"

    def side(self) -> str:
        inside = self.one(f"<h3>{self.words(1, 3)}</h3>", "") + self.one(self.link_list(2, 6), f"<p>{self.words(5, 30)}</p>", f"{self.words(3, 12)}")
        return "<aside>" + inside + "</aside>" if self.telling and self.maybe(0.5) else self.named("div", "sidebar", "side", "related", "widget-area", "rail", "aside", "recommended", "share", "social", "tags", "promo-links", "barra", "lateral", "seitenleiste") + inside + "</div>"

    def advert(self) -> str:
        inside = self.one(self.words(3, 14), f"<p>{self.words(3, 20)}</p>", f'<a href="#">{self.words(2, 8)}</a>')
        tag = self.one("div", "div", "section", "p", "aside")
        tag = tag if self.naming == "usual" or self.telling and tag != "p" else "div"  # a bare paragraph would be no advert to anyone
        return ("<!-- ad -->" if self.maybe(0.5) else "") + self.named(tag, "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adsbox", "ad-slot", "werbung", "anuncio", "publicidad", "pub") + inside + f"</{tag}>"

    def notice(self) -> str:
        inside = self.one(f"<p>{self.words(5, 30)}</p>", self.words(5, 25)) + (f"<button>{self.words(1, 2)}</button>" if self.maybe(0.5) else "")
        return self.named("div", "cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "newsletter", "popup", "modal", "subscribe", "paywall", "warning", "disclaimer", "aviso", "hinweis") + inside + "</div>"

    def form(self) -> str:
        return f'<form action="/">{self.one("<label>" + self.words(1, 3) + "</label>", "<p>" + self.words(3, 12) + "</p>", self.words(1, 4))}<input name="q"><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        each = self.one(self.tag("article"), "div", "li", "p")
        inside = "".join(self.named(each, "comment", "comment-body", "reply", "response", "kommentar", "comentario") + self.one(self.words(4, 50), f"<p>{self.words(4, 50)}</p>" if each != "p" else self.words(4, 40), f"<b>{self.words(1, 2)}</b> {self.words(4, 40)}") + f"</{each}>" for _ in range(int(self.r.integers(1, 5))))
        tag = self.one(self.tag("section"), "div", "ol" if each == "li" else "div")
        return self.named(tag, "comments", "comment-list", "discussion", "responses", "disqus", "comments-area", "kommentare", "comentarios") + (f"<h2>{self.words(1, 3)}</h2>" if tag != "ol" else "") + inside + f"</{tag}>"

    def main_block(self, plain: str = "p", shortest: int = 1) -> str:
        m = self.MARK
        kind = self.r.random()
        inline = lambda a, b: m + self.one(
            lambda: self.words(a, b),
            lambda: f"{self.words(2, 8)} <b>{self.words(1, 4)}</b> {self.words(a, b)}",
            lambda: f'{self.words(a, b)} <a href="/x">{self.words(1, 3)}</a> {self.words(1, 6)}',
            lambda: f"<b>{self.words(a, b)}<br>",
            lambda: f"<em>{self.words(a, b)}</em>",
            lambda: f"{self.words(a, b)}<br>{self.words(1, 9)}",
            lambda: f"{self.words(a, b)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {self.words(1, 5)}",
        )
        if kind < 0.72:
            return f"<{plain}>{inline(shortest, self.one(70, 70, 70, 70, shortest + 2))}{f'</{plain}>' if plain != 'p' else self.one('</p>', '</p>', '')}"
        if kind < 0.8:
            h = self.one("h2", "h3", "h4")
            return f"<{h}>{m}{self.words(1, 8)}</{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{inline(1, 20)}</li>" for _ in range(int(self.r.integers(1, 5)))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{self.one(inline(4, 40), '<p>' + inline(4, 40) + '</p>')}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 6)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.97:
            return f"<pre>{m}{self.words(3, 30)}</pre>"
        return f"<figure><img src='x'><figcaption>{m}{self.words(2, 15)}</figcaption></figure>"

    def article(self, bare: bool) -> str:
        m = self.MARK
        plain = self.one("p", "p", "div") if bare else "p"
        parts = [self.main_block(plain, 8 if bare else 1) for _ in range(int(self.r.integers(2 if bare else 1, self.one(16, 16, 16, 50))))]
        head = f"<h1>{m}{self.words(1, 12)}</h1>" if self.maybe(0.85) else ""
        if not bare and self.naming == "usual":
            for extra, p in ((self.advert, 0.15), (self.side, 0.08), (self.notice, 0.06)):
                if self.maybe(p):
                    parts.insert(int(self.r.integers(len(parts) + 1)), extra())
        if self.maybe(0.1):
            head = f"<header>{head}</header>" if head and self.maybe(0.3) else head
        inside = head + "".join(parts)
        if bare:
            tag = self.one("", "div", "section", "div")
            name = self.one("", f' class="{self.one(*"abcdefgh")}{int(self.r.integers(100))}"', f' id="{self.known[int(self.r.integers(4000))]}"')
            return f"<{tag}{name}>{inside}</{tag}>" if tag else inside
        for _ in range(int(self.r.integers(3)) if self.maybe(0.3) else 0):
            inside = self.named("div", self.one("wrap", "inner", "row")) + inside + "</div>"
        kind = self.r.random() if self.telling else 1.0
        if kind < 0.5:
            return f"<article>{inside}</article>"
        if kind < 0.62:
            return f"<main>{inside}</main>"
        if kind < 0.7:
            return f"<main><article>{inside}</article></main>"
        tag = self.one("div", "div", self.tag("section"))
        names = self.one("content", "post", "entry-content", "article", "article-body", "story", "main", "post-body", "text", "main-content", "contenido", "inhalt", "artikel", "contenu", "texte", "cuerpo", "beitrag")
        return self.named(tag, names) + inside + f"</{tag}>"

    def table(self, before: list[str], article: str, after: list[str]) -> str:
        """The parts as cells of a table: what comes before and after beside the article or in rows of its own."""
        cell = lambda parts: f"<td{self.one('', ' valign=top', ' width=150')}>{''.join(parts)}</td>"
        left, right = int(self.r.integers(len(before) + 1)), int(self.r.integers(len(after) + 1))
        rows = [cell([b]) for b in before[:left]]
        rows.append((cell(before[left:]) if before[left:] else "") + cell([article]) + (cell(after[:right]) if after[:right] else ""))
        rows += [cell([a]) for a in after[right:]]
        return "<table border=0>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    def page(self) -> str:
        self.style()
        if self.maybe(0.04):  # nothing but text
            return "".join(f"{self.one('', '<p>', '<div>')}{self.MARK}{self.words(8, 90)}{self.one('', '<p>')}" for _ in range(int(self.r.integers(1, 4))))
        before = [f() for f, p in ((self.header, 0.45), (self.menu, 0.7), (self.notice, 0.25), (self.form, 0.2), (self.advert, 0.5), (self.side, 0.2)) if self.maybe(p)]
        after = [f() for f, p in ((self.side, 0.35), (self.comments, 0.35), (self.advert, 0.3), (self.form, 0.15), (self.notice, 0.15), (self.footer, 0.85)) if self.maybe(p)]
        article = self.article(self.maybe(0.25 if self.naming == "usual" else 0.08)) if self.maybe(0.97) else ""
        laid = self.naming != "usual" and self.maybe(0.2)
        body = self.table(before, article, after) if laid else "".join([*before, article, *after])
        for _ in range(int(self.r.integers(1, 3)) if self.maybe(0.3) else 0):
            body = self.named("div", self.one("page", "wrapper", "container", "site")) + body + "</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 10)}</title><style>p{{}}</style></head><body>{body}" + self.one("</body></html>", "</body></html>", "")


def made_up(count: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Pages' blocks without the mark, and which of them are main text."""
    maker, out = _Maker(seed), []
    for _ in range(count):
        page = blocks(maker.page())
        y = np.array([_Maker.MARK in b.text for b in page], np.float32)
        page = [Block(" ".join(b.text.replace(_Maker.MARK, "").split()) or "-", b.places, b.depth, b.linked, b.box, b.outer) for b in page]
        if page:
            out.append((page, y))
    return out


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    """Trained on made-up pages; the same every time."""
    model = Labeller()
    model.train([(vectors(p), y) for p, y in made_up(PAGES, 17)])
    return model


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    read = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, own in zip(page, main) if own) for page, main in zip(read, model.label(read))]


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row with ``text`` and ``n_chars``.

    Null or empty html, and pages without main text, have an empty text. Nothing is cut off; repeated
    rows stay, and equal pages have equal texts; an empty table gives an empty result. Pages may be of any length: what is held
    beyond the page and its blocks does not grow with it.
    """
    sent = pages.sparkSession.sparkContext.broadcast(labeller())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[str] = []
            for at in range(0, len(s), 512):
                out += extract(s.iloc[at : at + 512].tolist(), sent.value)
            yield pd.Series(out, dtype=object)

    rows = need(pages, [*keep, "html"]).select(*keep, text("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
