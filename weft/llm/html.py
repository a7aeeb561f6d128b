"""HTML extraction: a recurrent labeller of leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, each with its path of tags, the class and id words on that path, and its
own words. Every block's vector joins three sums of learned vectors (path, class
and id words, hashed words) with a few numbers; a bidirectional LSTM in numpy
reads a page's whole sequence in both directions and labels every block as
article or not. The article's blocks, character references decoded and white
space made single, are joined in page order.

The labeller is trained where it is used, on pages made from a seeded rule of
many layouts (``training_pages``), so it needs no labelled table; its weights
have a fixed size and are broadcast. Scripts, styles, comments, heads and markup
are no text and never reach it.

Null and empty pages have the text ''; an empty table gives an empty result. Broken
markup is read as far as it goes: a tag that never ends is dropped, an unclosed
script takes the rest of the page. Repeated rows give equal texts; pages of any
length and depth are labelled whole, in time that follows their length. The html
column goes and those with the results' names are replaced; all others are kept and
never read, so their names cannot clash.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from weft.llm.batches import bound, frugal, slices

# The element groups of the HTML standard that matter here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title iframe svg object canvas audio video math".split())
CLOSED_BY_SLASH = frozenset("svg math".split())
CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*(?:>|$)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"\w+")

#: Rows of the learned tables, the lengths of their vectors, and the LSTM's state in each direction.
ROWS, PATH, NAMED, WORDS, HIDDEN = 1024, 16, 16, 8, 16
NUMBERS = 8
WIDTH = PATH + NAMED + WORDS + NUMBERS


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # hashed tags on the path
    named: tuple[int, ...]  # hashed class and id words on the path
    linked: float  # share of the text's characters within links
    tag: str
    depth: int


def _slot(kind: str, word: str) -> int:
    return crc32(f"{kind}:{word}".encode("utf-8", "surrogatepass")) % ROWS


class Place(NamedTuple):
    """An element by its path from the root; slots are few, so their sets stay small at any depth."""

    path: frozenset[int]
    named: frozenset[int]
    tag: str
    two: str
    depth: int

    def child(self, tag: str, names: tuple[int, ...]) -> "Place":
        two = f"{self.tag}>{tag}" if self.depth else tag
        own = _slot("p", tag)
        return Place(self.path if own in self.path else self.path | {own}, self.named.union(names) if names else self.named, tag, two, self.depth + 1)

    def features(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        return tuple(sorted(self.path | {_slot("leaf", self.tag), _slot("two", self.two)})), tuple(sorted(self.named))


def blocks(page: str | None) -> list[Block]:
    """A page's leaf blocks in order, in time that follows its length."""
    out: list[Block] = []
    stack: list[int] = [0]  # places of the open elements
    places, known = [Place(frozenset(), frozenset(), "", "", 0)], {}
    features: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
    held: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            at = stack[-1]
            if at not in features:
                features[at] = places[at].features()
            out.append(Block(text, *features[at], min(1.0, linked / len(text)), places[at].tag, places[at].depth))
        parts, linked = [], 0

    def take(raw: str) -> None:
        nonlocal linked
        text = unescape(raw)
        parts.append(text)
        if links:
            linked += len(text.strip())

    def leave() -> str:
        name = places[stack.pop()].tag
        held[name] -= 1
        return name

    page, at = page or "", 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if name in SKIPPED and not closing:
            if name == "head":
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                if end:
                    at = end.start()
            elif not (name in CLOSED_BY_SLASH and m[3].endswith("/")):
                end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
                at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if held[name]:
                while leave() != name:
                    pass
            links = 0
            continue
        above = places[stack[-1]].tag
        if above == "p" or name in CLOSED_BY_SELF and above == name:  # a block-level element ends a paragraph
            leave()
        names = [w.lower() for x in _NAMES.findall(m[3]) for w in _PARTS.findall(x[0] or x[1] or x[2])] if m[3] else []
        key = stack[-1], name, tuple(_slot("n", w) for w in names)
        if key not in known:
            known[key] = len(places)
            places.append(places[stack[-1]].child(*key[1:]))
        stack.append(known[key])
        held[name] += 1
    flush()
    return out


# --- vectors and the network


class Sparse(NamedTuple):
    """All blocks of some pages: positions in the learned tables with their owners, and the numbers."""

    path: np.ndarray
    path_of: np.ndarray
    named: np.ndarray
    named_of: np.ndarray
    words: np.ndarray
    words_of: np.ndarray
    numbers: np.ndarray


class WordSlots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = slot = _slot("w", word)
        return slot


def sparse(pages: list[list[Block]], slots: WordSlots) -> Sparse:
    every = [b for p in pages for b in p]
    words = [[slots[w] for w in _WORD.findall(b.text.lower())] for b in every]
    numbers = np.zeros((len(every), NUMBERS))
    k = 0
    for p in pages:
        for i, b in enumerate(p):
            n = len(words[k])
            marks = sum(map(b.text.count, ".,;:!?"))
            numbers[k] = (
                np.log1p(n) / 4, np.log1p(len(b.text)) / 6, b.linked, marks / (n + 1), b.tag in ("h1", "h2", "h3"),
                min(b.depth, 20) / 10, i / len(p), (len(p) - i) / len(p),
            )
            k += 1
    flat = lambda xs: (np.array([x for y in xs for x in y], np.int64), np.repeat(np.arange(len(xs)), [len(y) for y in xs]))
    return Sparse(*flat([b.path for b in every]), *flat([b.named for b in every]), *flat(words), numbers)


def _means(table: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int, mean: bool) -> np.ndarray:
    out = np.zeros((n, table.shape[1]))
    np.add.at(out, owner, table[at]) if len(at) < 64 else _sums(out, table[at], owner)
    return out / np.maximum(1, np.bincount(owner, minlength=n))[:, None] if mean else out


def _sums(out: np.ndarray, rows: np.ndarray, owner: np.ndarray) -> None:
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out[owner[starts]] = np.add.reduceat(rows, starts)


def vectors(w: dict, s: Sparse) -> np.ndarray:
    n = len(s.numbers)
    return np.concatenate([_means(w["path"], s.path, s.path_of, n, False), _means(w["named"], s.named, s.named_of, n, False), _means(w["words"], s.words, s.words_of, n, True), s.numbers], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Outputs (time, pages, HIDDEN) over x (time, pages, WIDTH)."""
    steps, m, _ = x.shape
    h, c = np.zeros((m, HIDDEN)), np.zeros((m, HIDDEN))
    inner = x @ w + b
    out = np.empty((steps, m, HIDDEN))
    for t in range(steps):
        z = inner[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out


def _lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list, dout: np.ndarray) -> tuple:
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN), np.zeros_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in reversed(range(len(x))):
        h, before, i, f, o, g, tc = keep[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w.T
        dh, dc = dz @ u.T, dc * f
    return dw, du, db, dx


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each (time, page) read forwards and backwards, and which are real."""
    steps = int(lengths.max())
    t = np.arange(steps)[:, None]
    first = (np.cumsum(lengths) - lengths)[None, :]
    real = t < lengths[None, :]
    ahead = np.where(real, first + t, 0)
    back = np.where(real, first + lengths[None, :] - 1 - t, 0)
    return ahead, back, real


def label(w: dict, pages: list[list[Block]], slots: WordSlots) -> list[np.ndarray]:
    """For every page the probability of each block to belong to the article."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # pages of like length together, of bounded sum
        own = order[at : at + 64]
        while len(own) > 1 and len(own) * len(pages[own[-1]]) > 20_000:
            own = own[: len(own) // 2]
        at += len(own)
        lengths = np.array([len(pages[i]) for i in own])
        x = vectors(w, sparse([pages[i] for i in own], slots))
        ahead, back, real = _grid(lengths)
        hf, hb = _lstm(x[ahead], w["wf"], w["uf"], w["bf"]), _lstm(x[back], w["wb"], w["ub"], w["bb"])
        h = np.zeros((len(x), 2 * HIDDEN))
        h[ahead[real], :HIDDEN], h[back[real], HIDDEN:] = hf[real], hb[real]
        p = _sigmoid(np.concatenate([h, x], axis=1) @ w["out"] + w["bias"])
        for i, part in zip(own, np.split(p, np.cumsum(lengths)[:-1])):
            out[i] = part
    return out


# --- training

# Names that page layouts use, and words that boilerplate holds.
_MAIN = "article main content post entry story body text article-body post-content entry-content story-text main-content page-content".split()
_SIDE = {
    "menu": ("nav", "menu navigation navbar nav topnav main-menu breadcrumbs breadcrumb"),
    "header": ("header", "header masthead site-header topbar banner top"),
    "footer": ("footer", "footer site-footer bottom colophon page-footer copyright"),
    "sidebar": ("aside", "sidebar side related rail widget secondary right-column"),
    "notice": ("div", "cookie cookies consent notice alert gdpr newsletter subscribe popup"),
    "advert": ("div", "ad ads advert advertisement sponsored promo banner-ad ad-slot"),
    "comments": ("section", "comments comment-list comment reply discussion responses disqus"),
    "form": ("form", "search login contact-form signup form"),
    "share": ("div", "share social sharing tags author-box recommended"),
}
_STOCK = "home about contact login search menu copyright rights reserved cookies privacy terms subscribe newsletter share comments reply advertisement sponsored".split()


def training_pages(n: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages with, for each leaf block, whether it belongs to the article."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfghklmnprstvzé" for b in ("a", "e", "i", "o", "u", "an", "er", "on", "ß", "ció")]

    def text(lo: int, hi: int, stock: float = 0.0) -> str:
        n = int(lo * (hi / lo) ** rng.random())
        ws = [rng.choice(_STOCK) if rng.random() < stock else "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
        ws[0] = ws[0].capitalize()
        return " ".join(w + ("," if rng.random() < 0.06 else "") for w in ws) + rng.choice([".", ".", ".", "", "!", "?"])

    def link(s: str) -> str:
        return f'<a href="/{rng.randint(0, 999)}">{s}</a>'

    def opened(tag: str, names: str = "") -> str:
        return f'<{tag} {rng.choice(["class", "id"])}="{names}">' if names else f"<{tag}>"

    def side(kind: str, made: list, flags: list, clear: bool) -> None:
        tag, names = _SIDE[kind]
        tag = tag if rng.random() < 0.7 or not clear else "div"
        name = rng.choice(names.split()) if tag == "div" or rng.random() < 0.5 else ""
        made.append(opened(tag, name))
        style = rng.random()
        if kind in ("menu", "share") or style < 0.25:
            items = rng.randint(2, 9)
            made.append("<ul>" + "".join(f"<li>{link(text(1, 3, 0.4))}</li>" for _ in range(items)) + "</ul>")
            flags += [False] * items
        elif kind == "comments":
            for _ in range(rng.randint(1, 6)):
                made.append(f"<div class=\"{rng.choice(['comment', 'comment-body', 'reply', 'c'])}\"><p>{text(2, 60, 0.03)}</p></div>")
                flags.append(False)
        elif kind == "form":
            made.append(f"<label>{text(1, 4, 0.3)}</label><input><button>{text(1, 2, 0.4)}</button>")
            flags += [False, False]
        elif style < 0.6:
            made.append(text(2, 30, 0.15))
            flags.append(False)
        else:
            for _ in range(rng.randint(1, 3)):
                made.append(f"<{rng.choice(['p', 'div', 'h3'])}>{text(1, 25, 0.15)}")
                made.append(f"</{made[-1][1 : made[-1].index('>')]}>")
                flags.append(False)
        made.append(f"</{tag}>")

    def body(made: list, flags: list) -> None:
        if rng.random() < 0.85:
            tag = rng.choice(["h1", "h1", "h2"])
            made.append(f"<{tag}>{text(1, 12)}</{tag}>")
            flags.append(True)
        for _ in range(int(rng.choice([1, 2, 4, 8, 14, 24]) * (0.5 + rng.random()))):
            kind = rng.random()
            words = text(1, rng.choice([4, 40, 160, 400]), 0.3 if rng.random() < 0.04 else 0.0)
            if rng.random() < 0.15:
                words = f"<b>{words}" + rng.choice(["</b>", ""]) + rng.choice(["", "<br>"])
            elif rng.random() < 0.12:
                words += " " + link(text(1, 4)) + " " + text(1, 12)
            if kind < 0.75:
                made.append(f"<p>{words}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.83:
                made.append(f"<ul><li>{words}</li></ul>")
            elif kind < 0.9:
                made.append(f"<{rng.choice(['h2', 'h3'])}>{text(1, 8)}")
                made.append(f"</{made[-1][1:3]}>")
            elif kind < 0.95:
                made.append(f"<blockquote><p>{words}</p></blockquote>")
            else:
                made.append(f"<div>{words}</div>")
            flags.append(True)
            if rng.random() < 0.04:
                side(rng.choice(["advert", "share", "sidebar", "form", "notice"]), made, flags, False)

    pages = []
    while len(pages) < n:
        made, flags = ["<html><body>"], []
        wrapped = rng.random() < 0.5
        if wrapped:
            made.append(opened("div", rng.choice(["wrapper", "page", "container", "site", "layout"])))
        for kind in rng.sample(["header", "menu", "notice", "advert", "form"], rng.randint(0, 3)):
            side(kind, made, flags, True)
        first_side = rng.random() < 0.2
        if first_side:
            side("sidebar", made, flags, True)
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        name = rng.choice(_MAIN) if tag in ("div", "section") or rng.random() < 0.4 else ""
        made.append(opened(tag, name))
        body(made, flags)
        inside = rng.random() < 0.2
        if inside:
            side(rng.choice(["comments", "share", "sidebar", "form"]), made, flags, True)
        cut = rng.random() < 0.1
        if not cut:
            made.append(f"</{tag}>")
            for kind in rng.sample(["comments", "sidebar", "advert", "form", "share", "notice"], rng.randint(0, 3)):
                side(kind, made, flags, True)
            if rng.random() < 0.8:
                side("footer", made, flags, True)
        page = "".join(made)
        if len(blocks(page)) == len(flags):
            pages.append((page, flags))
    return pages


@cache
def train(pages: int = 1_500, epochs: int = 8, seed: int = 5) -> dict[str, np.ndarray]:
    """The network's weights; the same for the same arguments, and made once in a session."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s=0.1: rng.standard_normal(shape) * s
    w = {"path": draw(ROWS, PATH), "named": draw(ROWS, NAMED, s=0.02), "words": draw(ROWS, WORDS, s=0.02), "out": draw(2 * HIDDEN + WIDTH), "bias": np.zeros(1)}
    for d in "fb":
        w |= {"w" + d: draw(WIDTH, 4 * HIDDEN, s=WIDTH**-0.5), "u" + d: draw(HIDDEN, 4 * HIDDEN, s=HIDDEN**-0.5), "b" + d: np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
    made = [(blocks(p), np.array(f, float)) for p, f in training_pages(pages, seed)]
    made.sort(key=lambda x: len(x[0]))
    slots = WordSlots()
    groups = []
    for at in range(0, len(made), 32):
        part = made[at : at + 32]
        lengths = np.array([len(b) for b, _ in part])
        groups.append((lengths, sparse([b for b, _ in part], slots), np.concatenate([f for _, f in part])))
    first, second, step = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(3))
    count = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for g in rng.permutation(len(groups)):
            grads = _gradients(w, *groups[g])
            count += 1
            for k, d in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                step[k] = first[k] / (1 - 0.9**count) / (np.sqrt(second[k] / (1 - 0.99**count)) + 1e-8)
                w[k] = w[k] - rate * step[k]
    return w


def _gradients(w: dict, lengths: np.ndarray, s: Sparse, y: np.ndarray) -> dict[str, np.ndarray]:
    x = vectors(w, s)
    n = len(x)
    ahead, back, real = _grid(lengths)
    xf, xb, kf, kb = x[ahead], x[back], [], []
    hf, hb = _lstm(xf, w["wf"], w["uf"], w["bf"], kf), _lstm(xb, w["wb"], w["ub"], w["bb"], kb)
    h = np.zeros((n, 2 * HIDDEN))
    h[ahead[real], :HIDDEN], h[back[real], HIDDEN:] = hf[real], hb[real]
    full = np.concatenate([h, x], axis=1)
    d = (_sigmoid(full @ w["out"] + w["bias"]) - y) / n
    dfull = d[:, None] * w["out"][None, :]
    dhf, dhb = (np.where(real[..., None], dfull[g][..., a : a + HIDDEN], 0) for g, a in ((ahead, 0), (back, HIDDEN)))
    wf, uf, bf, dxf = _lstm_back(xf, w["wf"], w["uf"], kf, dhf)
    wb, ub, bb, dxb = _lstm_back(xb, w["wb"], w["ub"], kb, dhb)
    dx = dfull[:, 2 * HIDDEN :].copy()
    dx[ahead[real]] += dxf[real]
    dx[back[real]] += dxb[real]
    grads = {"out": full.T @ d, "bias": np.array([d.sum()]), "wf": wf, "uf": uf, "bf": bf, "wb": wb, "ub": ub, "bb": bb}
    parts = np.split(dx, np.cumsum([PATH, NAMED, WORDS]), axis=1)
    counts = np.maximum(1, np.bincount(s.words_of, minlength=n))[:, None]
    for k, at, owner, part in (("path", s.path, s.path_of, parts[0]), ("named", s.named, s.named_of, parts[1]), ("words", s.words, s.words_of, parts[2] / counts)):
        grads[k] = np.stack([np.bincount(at, part[owner, j], minlength=ROWS) for j in range(part.shape[1])], axis=1)
    return grads


# --- over DataFrames


def extract(pages: DataFrame, weights: dict[str, np.ndarray], html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without the markup, with the article's text and n_chars, its code points; all other columns are kept."""
    bound(pages.sparkSession)
    kept = pages.drop(name, "n_chars") if name != html_col else pages.drop("n_chars")
    where = kept.columns.index(html_col)
    held = pages.sparkSession.sparkContext.broadcast(weights)
    others = [i for i in range(len(kept.columns)) if i != where]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = WordSlots()
        for whole in batches:
            for part in slices(whole, where):
                made = [blocks(p) for p in part.column(where).to_pylist()]
                texts = [" ".join(b.text for b, p in zip(page, ps) if p >= 0.5) for page, ps in zip(made, label(held.value, made, slots))]
                rest = part.select(others)
                yield rest.append_column(name, pa.array(texts, pa.string())).append_column("n_chars", pa.array(list(map(len, texts)), pa.int64()))

    fields = [f for f in kept.schema.fields if f.name != html_col]
    return kept.mapInArrow(frugal(run), StructType(fields).add(name, StringType()).add("n_chars", LongType()))
