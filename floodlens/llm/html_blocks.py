"""Leaf blocks of a page: its pieces of running text with the elements that enclose them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Element names of HTML by how they take part in a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup "
    "time tt u var".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CLOSES = {  # a start tag ends an open element of these kinds, up to the nearest container
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CONTAINERS = frozenset("article aside body div dl fieldset footer form header html main nav ol section table ul".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # what a head may hold
CLOSED_HOLDERS = frozenset("svg math select option".split())  # a block of text ends these
FLOW = CONTAINERS | frozenset("address blockquote center dd details dialog dt figure h1 h2 h3 h4 h5 h6 hr li p pre td th tr".split())
MAIN = frozenset("body main article".split())  # these end every silent element but a template

# Words that class names are often joined from.
NAME_WORDS = (
    "advert article banner breadcrumb comment consent content cookie discussion entry feedback footer header masthead navigation newsletter "
    "pagination popup promo recommend related reply response respond share sidebar social sponsor story subscribe widget".split())

# A value is quoted as a whole or ends at white space; quotes elsewhere are ordinary characters.
_VALUE = r"\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>\"'][^\s>]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*+(?:{_VALUE})?)*+)(?:>|$)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+))", re.I | re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WHITE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # names of the enclosing elements, outermost first
    names: frozenset[str]  # parts of their class, id and role
    near: frozenset[str]  # the same of the innermost that has any
    link_chars: int


def _names(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = (v for _, a, b, c in _NAMED.findall(attributes) for v in (a or b or c,))
    parts = {p.lower() for v in found for p in _PART.findall(v) if not p.isdigit()}
    # Of words written as one, those that are known; the plural counts as the word itself.
    return frozenset(parts | {w for p in parts for w in NAME_WORDS if p != w and p != w + "s" and (p.startswith(w) or p.endswith((w, w + "s")))})


class _LastEnd:
    """Where the last end tag of a name begins in a page, -1 if it has none."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, {}

    def of(self, name: str) -> int:
        if name not in self.found:
            self.found[name] = max((m.start() for m in re.finditer(rf"</{name}(?![a-zA-Z0-9:-])", self.page, re.I)), default=-1)
        return self.found[name]


def blocks(page: str | None) -> Iterator[Block]:
    """The blocks of a page in order. Unclosed and misplaced tags are forgiven; references are decoded; white space inside a
    block is one space. Text of scripts, styles, comments, heads and form controls belongs to no block."""
    if not page:
        return
    stack: list[tuple[str, frozenset[str]]] = []
    last_end = _LastEnd(page)
    parts: list[str] = []
    link_chars = 0
    links = silent = 0

    def flush() -> Iterator[Block]:
        nonlocal link_chars
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                outer = [s for s in stack if s[0] not in INLINE]
                near = next((s[1] for s in reversed(outer) if s[1]), frozenset())
                yield Block(text, tuple(s[0] for s in outer), frozenset().union(*(s[1] for s in outer)), near, link_chars)
            parts.clear()
        link_chars = 0

    def pop_to(at: int) -> None:
        nonlocal links, silent
        for name, _ in stack[at:]:
            links -= name == "a"
            silent -= name in SILENT
        del stack[at:]

    at, end = 0, len(page)
    while at < end:
        tag = _TOKEN.search(page, at)
        text = page[at:tag.start() if tag else end]
        if silent and stack and stack[-1][0] == "head" and text.strip():
            pop_to(len(stack) - 1)  # a head holds no text
        if text and not silent:
            parts.append(text)
            link_chars += len(text) if links else 0
        if not tag:
            break
        at = max(tag.end(), at + 1)
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                yield from flush()
            continue
        if tag[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name in INLINE and place >= 0 and any(s[0] in CONTAINERS for s in stack[place:]):
                place = -1
            if name not in INLINE:
                yield from flush()
            if place >= 0:
                pop_to(place)
            continue
        if silent:
            for i, (holder, _) in enumerate(stack):
                over = name not in HEAD if holder == "head" else name in FLOW if holder in CLOSED_HOLDERS else name in MAIN and holder in SILENT and holder != "template"
                if over:
                    pop_to(i)
                    break
        if name not in INLINE:
            yield from flush()
            ends = CLOSES.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in ends:
                    pop_to(i)
                elif stack[i][0] in CONTAINERS and stack[i][0] not in ("tr",):
                    break
        if tag[3].rstrip().endswith("/") and name in SILENT:
            continue
        if name in SILENT and name not in RAW and name not in CLOSED_HOLDERS and name != "head" and last_end.of(name) < at:
            if name != "button":
                continue  # never closed: what follows is not its content
            name = "option"  # its label goes on to the next block
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        stack.append((name, _names(tag[3])))
        links += name == "a"
        silent += name in SILENT
    yield from flush()
