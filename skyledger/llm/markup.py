"""Blocks of text of an HTML page, with where in the page they stand."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

# Fixed values of the HTML standard: elements without content, with raw text, and those that start a new line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split())

#: Elements, roles and words of class or id that stand for something other than the article.
SIDE_TAGS = frozenset("nav footer aside form dialog menu button select head".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie"
    " cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall"
    " popup promo promotion promoted recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription tags teaser toolbar tracking widget widgets".split())


#: A class such as no-sidebar or with-sidebar says how a wrapper is laid out, not what it is.
LAYOUT_WORDS = frozenset("no non not without with has have".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # elements with their classes, from the root
    side: bool  # in an element that stands for something else
    main: bool  # in an article or main element


@dataclass
class Element:
    tag: str
    name: str
    hard: bool  # side by its tag, role or being hidden, or inside such an element
    soft: bool  # side by a word of its class or id, or inside such an element
    inner: bool  # the same, from the innermost article or main on
    main: bool


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _open(tag: str, raw: str, parent: Element | None) -> Element:
    own = attributes(raw)
    label = f"{own.get('class', '')} {own.get('id', '')}".lower()
    words = {w for name in label.split() if (ws := _WORD.findall(name)) and ws[0] not in LAYOUT_WORDS for w in ws}
    starts = tag in ("article", "main") or own.get("role") == "main"
    main = bool(parent and parent.main) or starts
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    hard = (bool(parent and parent.hard) or hidden or tag in SIDE_TAGS or own.get("role", "").lower() in SIDE_ROLES
            or not main and tag == "header")
    said = (bool(words & SIDE_WORDS) and tag not in ("html", "body", "main")
            or not main and "header" in words and tag not in ("html", "body"))
    soft = bool(parent and parent.soft) or said
    inner = not starts and (bool(parent and parent.inner) or said)
    return Element(tag, tag + "".join(f".{w}" for w in sorted(own.get("class", "").lower().split())), hard, soft, inner, main)


def blocks(page: str) -> list[Block]:
    """All blocks in page order: white space is one space, character references are decoded, scripts and styles are left out.

    Words of a class or id do not make a page empty: where all articles, or all blocks, are side by such words, those of the
    wrappers and of the articles themselves do not count.
    """
    found: list[Block] = []
    tops: list[Element | None] = []
    stack: list[Element] = []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                top = stack[-1] if stack else None
                found.append(Block(text, tuple(e.name for e in stack), bool(top and (top.hard or top.soft)), bool(top and top.main)))
                tops.append(top)

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            pieces.append(html.unescape(page[at:]))
            break
        if token.start() > at:
            pieces.append(html.unescape(page[at:token.start()]))
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if any(e.tag == tag for e in stack):
                if tag in BLOCK:
                    flush()
                while stack.pop().tag != tag:
                    pass
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not token[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag in BLOCK:
            flush()
            # A paragraph ends where a block starts, a list item or cell where the next one does.
            closes = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        stack.append(_open(tag, token[3], stack[-1] if stack else None))
    flush()
    if any(b.main for b in found):
        if all(b.side for b in found if b.main):
            for b, e in zip(found, tops):
                if b.main:
                    b.side = e.hard or e.inner
    elif all(b.side for b in found):
        for b, e in zip(found, tops):
            b.side = e.hard
    return found


def title(page: str) -> str:
    found = re.search(r"<title\b[^>]*>(.*?)</title\s*>", page, re.I | re.S)
    return " ".join(html.unescape(found[1]).split()) if found else ""


def links(page: str) -> list[str]:
    """Targets of the page's links, in page order."""
    return [own["href"] for t in _TOKEN.finditer(page) if t[2] and not t[1] and t[2].lower() == "a" and "href" in (own := attributes(t[3]))]
