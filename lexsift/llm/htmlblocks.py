"""A page's leaf blocks: runs of text within one block-level element, with where they stand in the tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values of HTML: elements that break blocks, that have no end tag, and whose content is a program, a form's value or another document instead of the page's text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noframes noembed".split())
#: An opening tag closes these if they are open, looking up to the nearest of ``_SCOPE``.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl select table article section aside nav header footer main form fieldset div body td th dialog details figure".split())
_NO_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption", "frameset", "dt", "dd", "li", "noscript"}
_TABLE = frozenset("table tr td th tbody thead tfoot body html".split())

# Attributes as the HTML tokenizer reads them: a quote opens a value only right after the equals sign.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)?+"""
_TAG = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)""", re.S)
_ATTRIBUTES = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s"'>][^\s>]*+))?+)?+""")
#: Elements that may be open at once.
DEPTH = 512
_NAMING = frozenset("class id role aria-label itemprop".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A name with one of these says how the element looks or what else the page has, not what it is.
_MODIFIERS = frozenset("has have with without no not is are enabled disabled left right layout single hide show on off open closed allow allowed can single full active default style theme template type format status column columns col grid row".split())


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    names: frozenset[str]
    above: Node | None
    hidden: bool
    chars: int = 0  # of the text in it
    holds: bool = False  # the page's largest article stands in it (set by who knows)
    context: frozenset[int] | None = None  # kept by who asks for it


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    link_chars: int
    names: frozenset[str]  # of an inline element that the block begins with
    is_title: bool = False


def _title(page: str) -> str:
    m = re.search(r"<title[^>]*>(.*?)(?:</title|\Z)", page, re.I | re.S)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def _named(attributes: str) -> tuple[frozenset[str], bool]:
    """The words of an element's names, and whether it is hidden.  Words next to a modifier don't count."""
    found: set[str] = set()
    hidden = False
    for name, *values in _ATTRIBUTES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in _NAMING:
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                if not words & _MODIFIERS:
                    found |= words
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return frozenset(found), hidden


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, without empty ones; character references decoded, white space made one space.

    Elements that are nested deeper than DEPTH stand side by side, as in browsers.
    """
    page = page or ""
    blocks: list[Block] = []
    stack = [Node("", frozenset(), None, False)]
    buffer: list[str] = []
    links = 0  # open <a>
    link_chars = 0
    inline: frozenset[str] = frozenset()
    title = _title(page)

    def flush() -> None:
        nonlocal link_chars, inline
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text and not any(n.tag == "head" for n in stack):
                blocks.append(Block(text, stack[-1], link_chars, inline, text == title))
            buffer.clear()
        link_chars, inline = 0, frozenset()

    def close(tags: frozenset[str] | set[str], scope: frozenset[str]) -> None:
        """Closes the nearest open element of ``tags``, and what is open in it."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    at = 0
    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            buffer.append(piece)
            if links:
                link_chars += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                close({tag}, frozenset(("td", "th")) if tag not in _TABLE else frozenset())
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            buffer.append(" ")
            continue
        if tag == "a":
            links += 1
        elif tag in BLOCKS:
            if tag in _NO_P:
                close({"p"}, _SCOPE)
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPE - {"td", "th"} if tag in ("td", "th", "tr", "tbody", "tfoot") else _SCOPE)
            if tag == "body":
                close({"head"}, frozenset())
            flush()
            if tag != "hr":
                names, hidden = _named(m[3]) if m[3] else (frozenset(), False)
                if len(stack) > DEPTH:
                    stack.pop()
                stack.append(Node(tag, names, stack[-1], hidden))
                links = 0
        elif tag in ("br", "img", "input", "button"):
            buffer.append(" ")
        elif m[3] and not inline and not "".join(buffer).strip():  # an inline element with a name of its own marks the block
            inline = _named(m[3])[0]
    flush()
    for block in blocks:
        n: Node | None = block.node
        while n is not None:
            n.chars += len(block.text)
            n = n.above
    return blocks
