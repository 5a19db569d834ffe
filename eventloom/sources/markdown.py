"""HTML to Markdown, for text that is read by a model: structure without attributes.

Elements are rendered when they end, innermost first, from the text of what they hold; an open element
is one entry of a list, so nesting of any depth costs no recursion. Missing and misplaced end tags are
taken as browsers take them: a block ends a paragraph, an item the one before it, the end of the page all.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
_LISTS = ("ul", "ol")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html "
    "legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()) | set(_HEADINGS)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style title noscript textarea iframe svg".split())
#: What a new element ends, and the elements up to which it is looked for.
_ENDS = {
    "li": (("li",), _LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_BULLETS = "*+-"
_SPACE = re.compile(r"[ \t\r\n\f]+")


class _Element:
    __slots__ = ("tag", "attrs", "parts", "count", "cells")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.count = 0  # items of a list, rows of a table
        self.cells: list[str] = []


def _apart(text: str) -> tuple[str, str, str]:
    """Leading space, text and trailing space: marks stand next to letters."""
    bare = text.strip()
    return (" " if text[:1].isspace() else "", bare, " " if text[-1:].isspace() else "")


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", {})]
        self.silent = 0
        self.open: dict[str, int] = {}

    # --- events ------------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
            return
        if self.silent:
            return
        if tag == "br":
            self.stack[-1].parts.append("  \n")
            return
        if tag in _BLOCKS:
            self.close_open(("p", *_HEADINGS), ("td", "th", "li", "blockquote", "div") if tag != "p" else ("td", "th"))
        if tag == "hr":
            self.stack[-1].parts.append("\n\n---\n\n")
        if tag in _VOID:
            return
        if tag in _ENDS:
            self.close_open(*_ENDS[tag])
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(_Element(tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif not self.silent and tag not in _VOID:
            self.close_open((tag,))

    def handle_data(self, data):
        if self.silent:
            return
        parts = self.stack[-1].parts
        if self.open.get("pre"):
            parts.append(data)
            return
        text = _SPACE.sub(" ", data)
        if not self.open.get("code"):
            text = text.replace("*", r"\*").replace("_", r"\_")
        self.append(parts, text)

    @staticmethod
    def append(parts: list[str], text: str) -> None:
        """Add text; one space is enough where two meet, and none at the beginning of a line."""
        if text.startswith(" ") and parts and parts[-1].endswith(("\n", " ")):
            text = text[1:]
        if text:
            parts.append(text)

    # --- elements ----------------------------------------------------------------------------

    def close_open(self, tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """End the innermost open element of some names, and all in it, unless one of `scope` lies in between."""
        if not any(self.open.get(tag) for tag in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.end(i)
                return
            if self.stack[i].tag in scope:
                return

    def finish(self) -> str:
        """What was written, once all that is still open has ended."""
        self.close()
        self.end(1)
        return "".join(self.stack[0].parts)

    def end(self, depth: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            self.open[element.tag] -= 1
            text = self.render(element, "".join(element.parts), self.stack[-1])
            self.append(self.stack[-1].parts, text)

    def within(self, *tags: str) -> bool:
        return any(self.open.get(tag) for tag in tags)

    def nearest(self, *tags: str) -> _Element | None:
        return next((e for e in reversed(self.stack) if e.tag in tags), None)

    def render(self, element: _Element, text: str, parent: _Element) -> str:
        tag, bare = element.tag, text.strip()
        if tag in _HEADINGS:
            line = _SPACE.sub(" ", bare)
            return f"\n\n{_HEADINGS[tag]}{line}\n\n" if line else ""
        if tag in _MARKS:
            before, inner, after = _apart(text)
            mark = _MARKS[tag]
            return f"{before}{mark}{inner}{mark}{after}" if inner and not self.within("pre") else text
        if tag == "a":
            return self.link(element, text)
        if tag == "li":
            return self.item(bare, parent)
        if tag in _LISTS:
            inside = self.within("li")
            return (f"\n{text.rstrip()}" if inside else f"\n\n{text.rstrip()}\n\n") if bare else ""
        if tag == "blockquote":
            lines = re.sub(r"\n{3,}", "\n\n", bare).split("\n")
            return "\n\n" + "\n".join(f"> {line}".rstrip() for line in lines) + "\n\n" if bare else ""
        if tag == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n" if bare else ""
        if tag in ("td", "th"):
            row = self.nearest("tr")
            cell = _SPACE.sub(" ", bare).replace("|", r"\|")
            if row is None:
                return f" {cell} "
            row.cells.append(cell)
            return ""
        if tag == "tr":
            return self.row(element, bare)
        if tag == "table":
            return f"\n\n{bare}\n\n" if bare else ""
        if tag in ("thead", "tbody", "tfoot"):
            return text
        if tag in _BLOCKS:
            return f"\n\n{bare}\n\n" if bare else "\n\n" if text else ""
        return text

    def link(self, element: _Element, text: str) -> str:
        before, inner, after = _apart(text)
        href, title = element.attrs.get("href"), element.attrs.get("title")
        if not inner or not href:
            return text
        inner = _SPACE.sub(" ", inner)
        if inner.replace(r"\_", "_") == href and not title:
            return f"{before}<{href}>{after}"
        shown = f' "{title}"'.replace("\n", " ") if title else ""
        return f"{before}[{inner}]({href}{shown}){after}"

    def item(self, text: str, parent: _Element) -> str:
        if parent.tag == "ol":
            first = parent.attrs.get("start") or "1"
            bullet = f"{(int(first) if first.isdecimal() else 1) + parent.count}. "
        else:
            bullet = _BULLETS[max(0, self.open.get("ul", 0) - 1) % len(_BULLETS)] + " "
        parent.count += 1
        inner = re.sub(r"\n{3,}", "\n\n", text).replace("\n", "\n" + " " * len(bullet))
        return f"{bullet}{inner}\n" if text else ""

    def row(self, element: _Element, text: str) -> str:
        if not element.cells:
            return f"{text}\n" if text else ""
        table = self.nearest("table")
        line = f"| {' | '.join(element.cells)} |\n"
        stray = f"{text}\n" if text else ""  # what a broken row holds beside its cells
        if table is not None:
            table.count += 1
            if table.count == 1:
                line += f"| {' | '.join('---' for _ in element.cells)} |\n"
        return stray + line


def to_markdown(html: str) -> str:
    """Markdown of a page or part of one, blank lines collapsed, without images."""
    writer = _Writer()
    writer.feed(html)
    text = re.sub(r"(?m)^[ \t]+$", "", writer.finish())
    return re.sub(r"\n{3,}", "\n\n", text).strip()
