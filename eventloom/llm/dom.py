"""A page as a tree of block elements and the runs of text in them.

The reader is lenient, as browsers are: end tags may be missing or out of place, a block ends an open
paragraph, an item ends the one before it. Inline elements are no nodes; only links leave a trace, the
number of characters they hold.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of HTML: elements whose contents are no text, and elements that stand for a block.
SKIPPED = ("script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select")
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr "
    "ul caption".split())
#: What a new element ends, and the elements up to which an open one is looked for.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"),
}
SCOPES = {
    "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
    "tbody": ("table",), "thead": ("table",), "tfoot": ("table",),
}

_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SKIPPED}


@dataclass
class Page:
    """Nodes in page order, a parent before its children, and runs of text (node, text)."""

    tags: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _words(attributes: str) -> tuple[str, ...]:
    """The words in class, id and role, lower-cased, without repeats."""
    found = [w.lower() for m in _NAMED.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")]
    return tuple(dict.fromkeys(found))


def read_page(source: str) -> Page:
    """The tree of a page. Node 0 is the page itself; a text run has no white space around it and single spaces inside."""
    page = Page(["#page"], [()], [-1])
    stack, at, end = [0], 0, len(source)
    parts: list[str] = []
    linked, in_link = 0, False
    is_open: Counter = Counter()
    seen: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.runs.append((stack[-1], text))
                page.linked.append(min(linked, len(text)))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    def close_to(tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of some names, if one lies inside the scope."""
        if not any(is_open[tag] for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[i]]
            if tag in tags:
                is_open.subtract(page.tags[node] for node in stack[i:])
                del stack[i:]
                return
            if tag in scope:
                return

    while at < end:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        found = _TAG.match(source, start) or _OPEN_TAG.match(source, start)
        if start > at:
            add(source[at:start])
        if not found:
            add("<")
            at = start + 1
            continue
        if found[0] == "<!--":
            close = source.find("-->", start + 4)
            at = end if close < 0 else close + 3
            continue
        at = found.end()
        if found.re is _TAG and found[2] is None:
            continue
        closing, tag = bool(found[1]), found[2].lower()
        if tag in _END and not closing and not found[3].endswith("/"):
            close = _END[tag].search(source, at)
            at = close.end() if close else end
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            flush()
            if closing:
                close_to((tag,))
                in_link = False
                continue
            if tag in ("html", "body"):
                if tag in seen:
                    continue
                seen.add(tag)
            if page.tags[stack[-1]] == "p":  # a paragraph holds no block
                close_to(("p",))
            if tag in ENDS:
                close_to(ENDS[tag], SCOPES[tag])
            page.tags.append(tag)
            page.names.append(_words(found[3]))
            page.parents.append(stack[-1])
            stack.append(len(page.tags) - 1)
            is_open[tag] += 1
        elif tag in ("br", "hr"):
            if tag == "hr":
                flush()
            parts.append(" ")
    flush()
    return page
