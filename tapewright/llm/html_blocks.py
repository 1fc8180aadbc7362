"""Leaf blocks of an HTML page: their text and the path of tags above them.

One pass over the page with one regular expression; nothing is looked at twice, so a
page of any length takes linear time. Tags that HTML closes by itself are closed, stray
end tags are ignored, a page that breaks off ends there.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Fixed values, from the HTML standard.
RAW = frozenset("script style noscript template title textarea iframe svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small "
                   "span strike strong sub sup time tt u var label".split())
# A start tag of the key closes an open element of the value.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                     "ol p pre section table ul figure details".split())
# Where looking for an element to close ends.
SCOPES = frozenset("table ul ol dl article section aside nav form main body div td th".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\s(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[^\W_]+")


class Block(NamedTuple):
    path: tuple[str, ...]   # tags and marks ('.word') of the elements above, outermost first
    text: str
    linked: int             # characters inside links


def _marks(tag: str) -> tuple[str, ...]:
    found = []
    for m in MARKS.finditer(tag):
        found += ["." + w for w in PART.findall((m.group(2) or m.group(3) or m.group(4) or "").lower())]
    return tuple(found)


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []   # (tag, path pieces)
    links = 0
    parts: list[tuple[str, bool]] = []

    def close():
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(p) for p, a in parts if a)
                out.append(Block(tuple(x for _, pieces in stack for x in pieces), text, min(linked, len(text))))
            parts.clear()

    def pop_to(tags, stop=SCOPES):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    page = page or ""
    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            parts.append((token, links > 0))
            continue
        name = NAME.match(token)
        if name is None or not token.endswith(">"):
            continue                      # a comment, a declaration, or a tag that breaks off
        tag = name.group(1).lower()
        ends = token[1] == "/"
        if tag in RAW:
            if not ends and not token.endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            links = 0 if ends else 1
        elif tag == "br" or tag == "wbr":
            parts.append((" " if tag == "br" else "", False))
        elif tag in INLINE:
            continue
        elif ends:
            close()
            if any(t == tag for t, _ in stack):
                pop_to({tag}, stop=())
                links = 0
        else:
            close()
            if tag in CLOSES_P:
                pop_to({"p"}, stop=SCOPES)
            if tag in CLOSES:
                pop_to(CLOSES[tag], stop=SCOPES - {"td", "th"})
            if tag not in VOID and not token.endswith("/>"):
                stack.append((tag, (tag, *_marks(token))))
    close()
    return out
