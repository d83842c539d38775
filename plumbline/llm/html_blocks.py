"""Leaf blocks of HTML pages with the elements they stand in."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')|=)*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
TOKEN = re.compile(r"[a-z]+")
# Elements whose content is not text of the page.
HIDDEN = frozenset("script style template noscript iframe".split())
RAW = frozenset("textarea title".split())
# Drawings and formulas stand in a line of text, with elements of their own; those of a page that cannot be in them end them.
FOREIGN = frozenset("svg math".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr li main menu "
    "nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Inside a block; everything else begins and ends one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var br wbr img picture source".split())
CLOSES_P = "p"
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html select".split())


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # ancestors, outermost first
    names: frozenset[str]  # words of their classes, ids and roles
    linked: int  # characters inside links
    label: str | None = None  # data-label of the nearest ancestor that has one


def blocks(page: str | None) -> list[Block]:
    """The non-empty blocks in page order: references decoded, white space inside a block turned into single spaces.

    Unclosed and stray tags are taken as browsers take them in the cases that matter here: a paragraph ends where a block
    begins, list items and cells end at the next one, an end tag closes what is open inside its element. A null or empty page
    has no blocks.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str | None]] = []
    parts: list[str] = []
    linked, at, size = 0, 0, len(page)
    where: list[tuple] = []

    def add(raw: str) -> None:
        nonlocal linked
        if not parts:
            where[:] = stack
        parts.append(raw)
        if any(t == "a" for t, _, _ in stack):
            linked += len(raw.split()) and len(" ".join(unescape(raw).split()))

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(
                    text, tuple(t for t, _, _ in where), frozenset().union(*(n for _, n, _ in where)), min(linked, len(text)),
                    next((x for _, _, x in reversed(where) if x is not None), None)))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        m = TAG.match(page, start)
        if not m:
            add(page[at:start + 1])
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        empty = attributes.endswith("/")
        inside = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in FOREIGN), -1)
        if tag in HIDDEN:
            if not end and not (inside >= 0 and empty):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if tag in FOREIGN or inside >= 0 and not end and tag not in BREAKS:
            if end:
                close(tag)
            elif not empty and tag not in VOID:
                stack.append((tag, frozenset(), None))
            continue
        if inside >= 0:
            if not end:
                del stack[inside:]
            elif any(t == tag for t, _, _ in stack[inside:]):
                close(tag)
                continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                if tag == "br":
                    parts and parts.append(" ")
            elif end:
                close(tag)
            else:
                stack.append((tag, frozenset(), None))
            continue
        flush()
        if end:
            close(tag)
            continue
        if any(t == CLOSES_P for t, _, _ in stack):
            close(CLOSES_P)
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SCOPES:
                    break
                if stack[i][0] in SIBLINGS[tag]:
                    del stack[i:]
                    break
        names, label = frozenset(), None
        if attributes and "=" in attributes:
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            names = frozenset(TOKEN.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
            label = found.get("data-label")
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stack.append((tag, names, label))
            add(page[at:stop.start() if stop else size])
            flush()
            stack.pop()
            at = stop.end() if stop else size
            continue
        if tag not in VOID and not empty:
            stack.append((tag, names, label))
    flush()
    return out
