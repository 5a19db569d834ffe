"""A small element tree over the standard library's HTML parser.

Used inside `mapInPandas` only, for pages whose cards nest too freely for patterns.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}


class Element:
    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def _inside(self):
        """All nodes and texts below, in page order; a stack instead of calls, for pages of any depth."""
        todo = [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
                continue
            yield child
            if isinstance(child, Element):
                todo.append(iter(child.children))

    def walk(self):
        return (child for child in self._inside() if isinstance(child, Element))

    def all(self, tag=None, cls=None, **attrs):
        """Descendants by tag, class (any of several) and attributes, in page order."""
        classes = {cls} if isinstance(cls, str) else set(cls or ())
        for node in self.walk():
            if tag and node.tag != tag:
                continue
            if classes and not classes & set((node.attrs.get("class") or "").split()):
                continue
            if all(node.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items()):
                yield node

    def first(self, *args, **kwargs):
        return next(self.all(*args, **kwargs), None)

    def strings(self):
        return (child for child in self._inside() if not isinstance(child, Element))

    def text(self, separator="", strip=False):
        parts = self.strings()
        if strip:
            parts = (p for p in (s.strip() for s in parts) if p)
        return separator.join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root")

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "option", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = Element(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html):
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
