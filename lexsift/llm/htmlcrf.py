"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

Features are the tags and names of the elements around a block and its text; the
labels are article and rest.  The field is trained by gradient ascent on labelled
pages that ``labelled_page`` composes (the tables have none), and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .htmlblocks import Block, Node, leaf_blocks

#: Labelled pages that the field is trained on (a fixed number), steps, step size and weight decay.
TRAINING_PAGES, STEPS, RATE, DECAY = 1200, 200, 0.2, 3e-5

_GROUPS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead topbar topline logo branding site",
    "foot": "footer copyright colophon legal imprint bottom",
    "side": "sidebar side rail widget aside related recommended recommendations popular trending teaser teasers latest secondary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp affiliate commercial",
    "reader": "comment comments commentlist reply replies disqus discussion respond reader readers feedback",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription signup paywall toast disclaimer warning message",
    "form": "form search login signin register input field contact",
    "share": "share sharing social follow toolbar buttons",
    "main": "content article post entry story main maincontent articlebody body text prose hentry",
}
_GROUP_OF = {w: g for g, words in _GROUPS.items() for w in words.split()}
_TAGS = "article main section nav header footer aside form table ul ol li figure menu dialog blockquote pre td p h1 h2 h3 h4 div dl figcaption select details button noscript".split()
_FEATURES = [
    "bias",
    *(f"in {t}" for t in _TAGS),
    *(f"is {t}" for t in [*_TAGS, "body", "dd", "dt", "td", "th", "option", "legend", "label", "other"]),
    *(f"near {g}" for g in _GROUPS),
    *(f"far {g}" for g in _GROUPS),
    *(f"own {g}" for g in _GROUPS),
    *(f"words {k}" for k in range(6)),
    *(f"links {k}" for k in range(4)),
    "stop", "marks", "copyright", "capitals", "digits", "title", "early", "late", "article no other", "article header", "hidden", "hidden in article",
]
_AT = {name: i for i, name in enumerate(dict.fromkeys(_FEATURES))}
_DIGITS = re.compile(r"\d")
_OUTER = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "select"))
#: An element with the page's largest article in it, or without one this share of the page's text, stands around the page's parts: it tells nothing of one.  Elements up to NEAR above a block are near.
AROUND, NEAR = 0.6, 2


def _context(node: Node, page_chars: int) -> frozenset[int]:
    """Indexes of the features that the elements around a block give it."""
    if node.context is None:
        found, inside, other, article, hidden = set(), False, False, False, False
        n, depth = node, 0
        while n is not None:
            hidden |= n.hidden
            inside |= n.tag in ("article", "main")
            article |= n.tag == "article"
            around = n is not node and (n.holds or n.chars > AROUND * page_chars and n.tag not in ("article", "main"))
            if n.tag in _TAGS and (not around or n.tag in ("article", "main")):
                found.add(f"in {n.tag}")
            if not around and n.tag not in ("html", "body"):
                groups = _groups(n)
                other |= n.tag in _OUTER or bool(groups - {"main"})
                found |= {f"{'near' if depth <= NEAR else 'far'} {g}" for g in groups}
                if n is node:
                    found |= {f"own {g}" for g in groups}
            n, depth = n.above, depth + 1
        if inside and not other:
            found.add("article no other")
        if article and "in header" in found:
            found.add("article header")
        if hidden:
            found |= {"hidden", "hidden in article"} if inside else {"hidden"}
        found.add(f"is {node.tag}" if f"is {node.tag}" in _AT else "is other")
        node.context = frozenset(_AT[x] for x in found)
    return node.context


def features(block: Block, at: float, page_chars: int) -> list[int]:
    """Indexes of a block's features; ``at``: its place in the page from 0 to 1."""
    text = block.text
    out = ["bias"]
    if block.names:
        groups = {_GROUP_OF[w] for w in block.names if w in _GROUP_OF}
        out += [f"own {g}" for g in groups] + [f"near {g}" for g in groups]
    n = text.count(" ") + 1
    out.append(f"words {0 if n <= 2 else 1 if n <= 5 else 2 if n <= 10 else 3 if n <= 20 else 4 if n <= 50 else 5}")
    share = block.link_chars / len(text)
    out.append(f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
    out += [name for name, holds in (
        ("stop", text[-1] in ".!?…。！？:;\"'”»)"), ("marks", "," in text or ". " in text), ("copyright", "©" in text), ("capitals", text.isupper()),
        ("digits", len(_DIGITS.findall(text)) > len(text) / 4), ("title", block.is_title), ("early", at < 0.1), ("late", at > 0.9),
    ) if holds]
    return sorted({_AT[x] for x in out} | _context(block.node, page_chars))


def _groups(node: Node) -> set[str]:
    return {_GROUP_OF[w] for w in node.names if w in _GROUP_OF}


def _mark_holders(blocks: list[Block], page_chars: int) -> bool:
    """Whether there is a largest article; marks the elements around it.

    It is the largest of the article and main elements, else of the elements named like one;
    those that stand in something else, unless this stands around the page, come last.
    """
    best: list[Node | None] = [None, None, None]
    seen: set[int] = set()
    for block in blocks:
        n: Node | None = block.node
        while n is not None and id(n) not in seen:
            seen.add(id(n))
            groups = _groups(n)
            if n.tag not in ("html", "body") and groups <= {"main"} and (n.tag in ("article", "main") or groups and n.tag not in _OUTER):
                kind, up = 0 if n.tag in ("article", "main") else 1, n.above
                while up is not None:
                    if up.tag not in ("html", "body", "") and up.chars <= AROUND * page_chars and (up.tag in _OUTER or _groups(up) - {"main"}):
                        kind = 2 if n.chars > page_chars / 2 else 3
                    up = up.above
                if kind < 3 and (best[kind] is None or n.chars >= best[kind].chars):
                    best[kind] = n
            n = n.above
    n = found = best[0] or best[1] or best[2]
    while n is not None and n.above is not None:
        n = n.above
        n.holds = True
    return found is not None


def page_features(blocks: list[Block]) -> list[list[int]]:
    # Where an article is known, shares of the text tell nothing more.
    chars = sum(len(b.text) for b in blocks)
    chars = 1 << 60 if _mark_holders(blocks, chars) else chars
    return [features(b, i / len(blocks), chars) for i, b in enumerate(blocks)]


@dataclass
class Field:
    """Weights of features by label, of transitions, and of the first and last label."""

    unary: np.ndarray
    pair: np.ndarray
    ends: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels of a sequence (1: article), by Viterbi."""
        if not rows:
            return []
        scores = [self.unary[r].sum(axis=0) for r in rows]
        p = self.pair.tolist()
        a, b = (scores[0] + self.ends[0]).tolist()
        back = []
        for s in scores[1:]:
            s0, s1 = s.tolist()
            to0 = (a + p[0][0], b + p[1][0])
            to1 = (a + p[0][1], b + p[1][1])
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            a, b = max(to0) + s0, max(to1) + s1
        y = int(b + self.ends[1][1] > a + self.ends[1][0])
        labels = [y]
        for step in reversed(back):
            y = int(step[y])
            labels.append(y)
        return labels[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS) -> Field:
    """Fits the field to (features, labels) of pages by Adam on the conditional log likelihood."""
    longest, k = max(len(y) for _, y in pages), len(_AT)
    n = len(pages)
    rows_of: list[list[int]] = []
    y = np.zeros((longest, n), dtype=np.int64)
    size = np.array([len(labels) for _, labels in pages])
    for i, (rows, labels) in enumerate(pages):
        rows_of += rows
        y[: len(labels), i] = labels
    live = np.arange(longest)[:, None] < size
    page, place = np.nonzero(live.T)  # the blocks one after the other
    flat, one = np.zeros((len(rows_of), k), dtype=np.float32), np.eye(2)[y] * live[..., None]
    for j, r in enumerate(rows_of):
        flat[j, r] = 1
    last = size - 1
    cols = np.arange(n)
    gold_pair = np.einsum("tna,tnb->ab", one[:-1], one[1:])
    gold = [flat.T @ one[place, page].astype(np.float32), gold_pair, np.stack([one[0].sum(axis=0), one[last, cols].sum(axis=0)])]
    w = [np.zeros((k, 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        score = np.zeros((longest, n, 2))
        score[place, page] = flat @ w[0].astype(np.float32)
        ahead = np.zeros((longest, n, 2))
        ahead[0] = score[0] + w[2][0]
        for t in range(1, longest):
            ahead[t] = score[t] + np.logaddexp(ahead[t - 1][:, :1] + w[1][0], ahead[t - 1][:, 1:] + w[1][1])
        behind = np.zeros((longest, n, 2))
        for t in range(longest - 1, -1, -1):
            behind[t] = w[2][1]
            if t + 1 < longest:
                after = score[t + 1] + behind[t + 1]
                rest = np.logaddexp(after[:, :1] + w[1][:, 0], after[:, 1:] + w[1][:, 1])
                behind[t] = np.where((t == last)[:, None], behind[t], rest)
        log_z = np.logaddexp.reduce(ahead[last, cols] + w[2][1], axis=1)
        marginal = np.exp(ahead + behind - log_z[None, :, None]) * live[..., None]
        pairs = np.exp(ahead[:-1, :, :, None] + w[1][None, None] + (score + behind)[1:, :, None, :] - log_z[None, :, None, None]) * live[1:, :, None, None]
        expected = [flat.T @ marginal[place, page].astype(np.float32), pairs.sum(axis=(0, 1)), np.stack([marginal[0].sum(axis=0), marginal[last, cols].sum(axis=0)])]
        for j in range(3):
            g = (gold[j] - expected[j]) / n - DECAY * w[j] * 10
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            w[j] = w[j] + RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Field(*w)


def _prose(rng: random.Random, low: int, high: int, stop: bool = True) -> str:
    syllables = "an en in on er re le la de ti to ra mo se un che ver ge ou ai co ma st al pro bel ñu éo zu sch".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    for i in range(len(words) - 1):
        if rng.random() < 0.1:
            words[i] += rng.choice(",;.")
    text = " ".join(words).capitalize()
    if rng.random() < 0.05:
        text = text.upper()
    return text + rng.choice([".", ".", ".", "!", "?"]) if stop else text


def _links(rng: random.Random, low: int, high: int, words: int = 2) -> str:
    items = [f'<a href="/{k}">{_prose(rng, 1, words, False)}</a>' for k in range(rng.randint(low, high))]
    return rng.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "<p>" + " | ".join(items) + "</p>"])()


def _rest(rng: random.Random, kind: str) -> str:
    """One piece of a page that is not its article."""
    word = rng.choice(_GROUPS[kind].split())
    name = rng.choice([word, f"{word}-{rng.choice(['box', 'wrap', 'inner', 'area', 'top'])}", f"page-{word}", f"{word} {rng.choice(['wide', 'col', 'clearfix', 'js'])}"])
    attr = rng.choice([f'class="{name}"', f'id="{name}"', f"class='{name}'", f'class={word}'])
    prose = lambda low, high: "".join(f"<p>{_prose(rng, low, high)}</p>" for _ in range(rng.randint(1, 3)))
    if kind == "menu":
        return rng.choice(["<nav>{}</nav>", f"<nav {attr}>{{}}</nav>", f"<div {attr}>{{}}</div>", '<div role="navigation">{}</div>', "<menu>{}</menu>"]).format(_links(rng, 3, 9))
    if kind == "head":
        inside = rng.choice([f"<a href='/'>{_prose(rng, 1, 3, False)}</a>", f"<p>{_prose(rng, 2, 9)}</p>", f"<h1>{_prose(rng, 1, 3, False)}</h1><p>{_prose(rng, 3, 8, False)}</p>", _links(rng, 2, 6)])
        return rng.choice(["<header>{}</header>", f"<header {attr}>{{}}</header>", f"<div {attr}>{{}}</div>"]).format(inside)
    if kind == "foot":
        inside = rng.choice([f"&copy; {_prose(rng, 1, 4, False)} &middot; {_prose(rng, 1, 5, False)}", _links(rng, 2, 7), f"<p>&copy; 20{rng.randint(10, 30)} {_prose(rng, 2, 6)}</p>", prose(4, 30)])
        return rng.choice(["<footer>{}</footer>", f"<footer {attr}>{{}}</footer>", f"<div {attr}>{{}}</div>"]).format(inside)
    if kind == "side":
        card = lambda: f"<article><h3><a href='/t'>{_prose(rng, 2, 7, False)}</a></h3><p>{_prose(rng, 4, 15)}</p></article>"
        inside = rng.choice([f"<h3>{_prose(rng, 1, 3, False)}</h3>{_links(rng, 3, 6, 7)}", prose(5, 30), f"<h3>{_prose(rng, 1, 3, False)}</h3>{card()}{card()}", f"<h2>{_prose(rng, 1, 4, False)}</h2>{prose(4, 25)}"])
        return rng.choice(["<aside>{}</aside>", f"<aside {attr}>{{}}</aside>", f"<div {attr}>{{}}</div>", f"<section {attr}>{{}}</section>"]).format(inside)
    if kind == "ad":
        inside = rng.choice([_prose(rng, 3, 12), _prose(rng, 1, 5, False), f"<a href='x'>{_prose(rng, 2, 8)}</a>", prose(4, 20)])
        return rng.choice([f"<div {attr}>{{}}</div>", f"<div {attr}>{{}}</div>" if "<p>" in inside else f"<p {attr}>{{}}</p>", f"<section {attr}>{{}}</section>", f"<aside {attr}>{{}}</aside>"]).format(inside)
    if kind == "reader":
        one = lambda: f"<div class='comment'><b>{_prose(rng, 1, 2, False)}</b><p>{_prose(rng, 3, 40)}</p></div>"
        item = rng.choice([one, lambda: f"<li><p>{_prose(rng, 3, 40)}</p></li>", lambda: f"<p>{_prose(rng, 3, 40)}</p>", lambda: f"<article class='comment'><p>{_prose(rng, 3, 40)}</p></article>"])
        return rng.choice([f"<section {attr}>{{}}</section>", f"<div {attr}>{{}}</div>", f"<ol {attr}>{{}}</ol>"]).format(f"<h3>{_prose(rng, 1, 2, False)}</h3>" * rng.randint(0, 1) + "".join(item() for _ in range(rng.randint(1, 6))))
    if kind == "notice":
        return rng.choice([f"<div {attr}>{{}}</div>", f"<section {attr}>{{}}</section>", f"<dialog {attr}>{{}}</dialog>", f"<p {attr}>{{}}</p>", '<div role="alert">{}</div>', "<noscript>{}</noscript>", "<div hidden>{}</div>", "<div style='display: none'><p>{}</p></div>", f"<div {attr} aria-hidden='true'>{{}}</div>"]).format(_prose(rng, 4, 30) + f" <a href='#'>{_prose(rng, 1, 1, False)}</a>" * rng.randint(0, 1))
    if kind == "form":
        return rng.choice(["<form>{}</form>", f"<form {attr}>{{}}</form>", f"<div {attr}><form>{{}}</form></div>"]).format(f"<label>{_prose(rng, 1, 6, False)}</label><input type='text'><button>{_prose(rng, 1, 2, False)}</button>" + f"<p>{_prose(rng, 4, 15)}</p>" * rng.randint(0, 1))
    return f"<div {attr}>{_links(rng, 2, 5, 1)}</div>"  # share


def _looks(rng: random.Random) -> str:
    """Class names that say what a page has or how it looks."""
    words = [w for g in _GROUPS.values() for w in g.split()]
    return " ".join(rng.choice([f"has-{w}", f"{w}-enabled", f"no-{w}", f"with-{w}", f"{w}-left", "page", "home", "post", "hentry", f"single-{w}", "js"]) for w in rng.choices(words, k=rng.randint(1, 4)))


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its leaf blocks: pieces of the article carry a mark that the labels are read from."""
    title = _prose(rng, 2, 9, rng.random() < 0.5)
    words = rng.choice([(5, 20), (15, 80), (1, 12), (30, 160)])
    mark = "\x01"

    def paragraph() -> str:
        text = mark + _prose(rng, *words, rng.random() < 0.9)
        r = rng.random()
        if r < 0.62:
            return f"<p>{text}</p>"
        if r < 0.70:
            return f"<p><b>{text}<br><p>{mark}{_prose(rng, *words)}</p>"
        if r < 0.76:
            return f"<h2>{mark}{_prose(rng, 1, 6, False)}</h2><p>{text}</p>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{mark}{_prose(rng, 1, 15, rng.random() < 0.5)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.86:
            return f"<blockquote><p>{text}</p></blockquote>"
        if r < 0.90:
            return f"<p>{text} <a href='/x'>{_prose(rng, 1, 4, False)}</a> {_prose(rng, 2, 10)}</p>"
        if r < 0.93:
            return f"<figure><img src='x.png'><figcaption>{mark}{_prose(rng, 2, 9)}</figcaption></figure>"
        if r < 0.95:
            return f"<pre>{text}</pre>"
        if r < 0.955:
            return f"<p hidden>{text}</p>"
        if r < 0.96:
            return f"<details><summary>{mark}{_prose(rng, 1, 5, False)}</summary><p>{text}</p></details>"
        return f"<table><tr><td>{mark}{_prose(rng, 1, 4, False)}</td><td>{mark}{_prose(rng, 1, 4, False)}</td></tr></table>" if r < 0.98 else f"<div>{text}</div>"

    parts = [paragraph() for _ in range(rng.randint(1, 12))]
    for kind in ("ad", "ad", "side", "share", "notice", "form", "reader"):
        if rng.random() < 0.2:
            parts.insert(rng.randint(0, len(parts)), _rest(rng, kind))
    if rng.random() < 0.15:
        parts.append(_rest(rng, "reader"))
    heading = f"<h1>{mark}{title}</h1>" if rng.random() < 0.85 else ""
    if heading and rng.random() < 0.3:
        heading = f"<header{rng.choice(['', ' class=entry-header', ' class="post-head top"'])}>{heading}</header>"
    name = rng.choice(["content", "post", "entry-content", "story", "article-body", "main", "post-content text"])
    wrap = rng.choice(["<article>{}</article>"] * 4 + [f"<article class='{name}'>{{}}</article>", f"<main><article>{{}}</article></main>", "<main>{}</main>", f"<div class='{name}'>{{}}</div>", f"<div id='{name}'>{{}}</div>", f"<section class='{name}'>{{}}</section>", f"<div><div class='{name}'><div>{{}}</div></div></div>", "<div>{}</div>", f"<table><tr><td class='{name}'>{{}}</td></tr></table>"])
    kinds = ["menu", "head", "ad", "notice", "form", "side", "share"]
    before = [_rest(rng, k) for k in rng.sample(kinds, rng.randint(0, 4))]
    after = [_rest(rng, k) for k in rng.sample(["side", "reader", "foot", "ad", "form", "menu", "notice", "share"], rng.randint(0, 4))]
    alone = rng.random() < 0.1
    if alone:  # perhaps of one block
        before, after, heading, parts = [], [], heading * (rng.random() < 0.5), parts[: rng.randint(1, 2)]
    article = wrap.format(heading + "".join(parts))
    if rng.random() < 0.25:  # the article's element is named for what stands beside it
        article = article.replace("<article>", f'<article class="{_looks(rng)}">', 1)
    inside = f"{''.join(before)}<!-- x -->{article}{''.join(after)}" + _rest(rng, "foot") * (rng.random() < 0.6) * (not alone)
    if not alone and rng.random() < 0.08:  # laid out by a table
        cell = lambda kind: f"<td class={rng.choice(_GROUPS[kind].split())}>" + rng.choice([_links(rng, 2, 6), _prose(rng, 2, 9, False), f"&copy; {_prose(rng, 1, 4, False)}"])
        inside = f"<table><tr>{cell('head')}<tr>{cell(rng.choice(['menu', 'side', 'ad']))}<td class={rng.choice(['content', 'main', 'text'])}>{heading}{''.join(parts)}<tr>{cell('foot')}</table>"
    for _ in range(rng.choice([0, 0, 1, 2])):  # elements around all, named for anything that the page has
        word = rng.choice([w for g in _GROUPS.values() for w in g.split()])
        name = rng.choice(["page", "wrapper", "site", "container", f"page {word}", f"{word} wrap", _looks(rng)])
        inside = rng.choice([f'<div class="{name}">{{}}</div>', f'<div id="{name.split()[0]}">{{}}</div>', f'<form class="{name}" method="post">{{}}</form>', f"<form>{{}}</form>", f'<section class="{name}">{{}}</section>', "<table><tr><td>{}</td></tr></table>"]).format(inside)
    body = rng.choice(["<body>", f'<body class="{_looks(rng)}">', f"<body class='{_looks(rng)} {rng.choice(list(_GROUP_OF))}' id={rng.choice(list(_GROUP_OF))}>"])
    page = f"<!DOCTYPE html><html><head><title>{title}{rng.choice(["", " - " + _prose(rng, 1, 3, False)])}</title><style>p{{}}</style></head>{body}{inside}" + "</body></html>" * (rng.random() < 0.9)
    # The mark would disturb the features, so the labels are read from one reading of the page and the features from another.
    labels = [int(mark in b.text) for b in leaf_blocks(page)]
    return page.replace(mark, ""), labels


@functools.cache
def trained_field(pages: int = TRAINING_PAGES, seed: int = 7) -> Field:
    """The field fitted to ``pages`` composed pages; the same each time."""
    rng, rows = random.Random(seed), []
    while len(rows) < pages:
        page, labels = labelled_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels) and labels:
            rows.append((page_features(blocks), labels))
    return train(rows)


def main_text(field: Field, page: str | None) -> str:
    """The article's blocks joined by line feeds; empty if there is none."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(page_features(blocks))) if y)


def extract_main_text(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page (page_id, url, html).

    A null or empty page, and one without an article, has an empty text.  Broken
    markup is read as far as it goes.  Rows that repeat each get a row; an empty table
    gives an empty result.  Other columns are ignored.
    """
    field = trained_field(training_pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(field, x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op8_crf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
