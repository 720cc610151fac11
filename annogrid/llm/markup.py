"""A small forgiving HTML tree: what the page extraction and the archive derivatives read."""

from __future__ import annotations

import html
import re

#: Elements without content, whose text isn't markup, and that end a paragraph or stand as blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key ends open elements named in the value, up to the nearest element of the scope.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "body": (("head",), ()),
}
_TOKEN = re.compile(
    r"""<(?:!--(?:>|->|(?P<comment>.*?)(?:--!?>|\Z))|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*+)>|(?P<bad>/?[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|(?P<other>[!?/])[^>]*+(?:>|\Z))""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "raw", "parent", "children", "digest")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.parent, self.children, self.digest = tag, raw, parent, [], b""

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(self.raw):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        return found


def parse(page: str) -> Node:
    """The tree of a page: elements and texts (character references decoded) in order; comments and doctypes are left out."""
    root = Node("#root", "", None)
    at, open_node, lower = 0, root, None
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            open_node.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        name, ends = m["name"], m["end"]
        if name is None and m["bad"] and page[at - 1] == ">":  # a quote that never ends: a tag without its attributes
            name, ends = m["bad"].lstrip("/"), m["bad"][0] == "/"
        if not name:
            continue
        name = name.lower()
        if ends:
            node = open_node
            while node is not root and node.tag != name:
                node = node.parent
            if node is not root:
                open_node = node.parent
            continue
        if name in CLOSES:
            closed, scope = CLOSES[name]
            node = open_node
            while node is not root and node.tag not in scope:
                if node.tag in closed:
                    open_node = node.parent
                node = node.parent
        elif name not in INLINE and name not in VOID and name not in RAW:
            node = open_node
            while node is not root and (node.tag in INLINE or node.tag == "p"):
                if node.tag == "p":
                    open_node = node.parent
                node = node.parent
        child = Node(name, m["attrs"] or "", open_node)
        open_node.children.append(child)
        if name in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
            end = len(page) if end < 0 else end
            if end > at:
                child.children.append(page[at:end] if name != "title" and name != "textarea" else html.unescape(page[at:end]))
            at = end
        elif name not in VOID and not (child.raw.endswith("/") and name in ("svg", "path")):
            open_node = child


def walk(root: Node):
    """All elements in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.children) if type(x) is not str)


def text_of(root: Node, dropped) -> list[str]:
    """The blocks of text below an element in page order, without elements for which dropped(node) holds."""
    blocks, line = [], []

    def flush() -> None:
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            blocks.append(words)

    stack: list = [root]
    while stack:
        x = stack.pop()
        if type(x) is str:
            line.append(x)
        elif x is None:
            flush()
        elif x is root or not dropped(x):
            if x.tag == "br":
                line.append("\n")
            elif x.tag in INLINE:
                stack.extend(reversed(x.children))
            elif x.tag not in VOID or x.tag == "hr":
                flush()
                stack.append(None)
                stack.extend(reversed(x.children))
    flush()
    return blocks
