"""HTML trees inside a task: a tolerant builder on the standard tokenizer, selectors, and markup out.

Everything that needs a tree runs per page within an Arrow batch; pages are independent, so Spark only
deals them out. Open elements are closed as HTML implies (paragraphs by blocks, list items and table
parts by their like); formatting that such a close cuts off is not opened again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

from turnloom.functions import rules

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset({"script", "style"})
HEAD = frozenset({"title", "meta", "link", "base", "script", "style", "noscript"})
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag closes the open element of these names, unless one of the walls is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Where parts of a table belong: a start tag closes what is open within the nearest of these elements.
ROOMS = {"td": {"tr", "tbody", "thead", "tfoot", "table"}, "th": {"tr", "tbody", "thead", "tfoot", "table"}, "tr": {"tbody", "thead", "tfoot", "table"}} | {
    tag: {"table"} for tag in ("tbody", "thead", "tfoot", "caption", "colgroup")
}
SPACE = re.compile("[" + rules.SPACE_CLASS.encode().decode("unicode_escape") + "]+")
#: The same one by one, for what strips characters.
SPACES = "".join(c for c in map(chr, range(0x10000)) if SPACE.match(c))


#: Characters that Python splits at and browsers do not count as white space.
_ODD = re.compile("[\x1c-\x1f]")


def collapse(text: str | None) -> str:
    if text and text.isascii() and not _ODD.search(text):
        return " ".join(text.split())
    return SPACE.sub(" ", text or "").strip(" ")


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def raw_text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def text(self) -> str:
        return collapse(self.raw_text())

    def up(self) -> Iterator[Node]:
        """The node and all above it."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def contains(self, other: Node) -> bool:
        return any(node is self for node in other.up())

    def closest(self, selector: str) -> Node | None:
        return next((n for n in self.up() if n.matches(selector)), None)

    def matches(self, selector: str) -> bool:
        # without attributes only a tag can match
        if not self.attrs and self.tag not in tags_of(selector):
            return False
        return any(_matches(self, chain) for chain in parse_selector(selector))

    def all(self, selector: str) -> list[Node]:
        chains, tags = parse_selector(selector), tags_of(selector)
        return [n for n in self.walk() if (n.attrs or n.tag in tags) and any(_matches(n, c) for c in chains)]

    def first(self, selector: str) -> Node | None:
        chains, tags = parse_selector(selector), tags_of(selector)
        return next((n for n in self.walk() if (n.attrs or n.tag in tags) and any(_matches(n, c) for c in chains)), None)

    def copy(self) -> Node:
        made = Node(self.tag, dict(self.attrs))
        todo = [(self, made)]
        while todo:
            old, new = todo.pop()
            for child in old.children:
                if isinstance(child, Node):
                    twin = Node(child.tag, dict(child.attrs), new)
                    todo.append((child, twin))
                    child = twin
                new.children.append(child)
        return made

    def replace(self, new: list) -> None:
        """Puts new children in the node's place."""
        above = self.parent
        if above is None:
            return
        at = next(i for i, c in enumerate(above.children) if c is self)
        above.children[at : at + 1] = new
        for child in new:
            if isinstance(child, Node):
                child.parent = above
        self.parent = None

    def html(self) -> str:
        """The markup inside."""
        parts, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                parts.append(item[0])
            elif isinstance(item, str):
                parts.append(_escape(item))
            else:
                parts.append(item.open_tag())
                if item.tag in RAW:
                    parts.append(item.raw_text() + f"</{item.tag}>")
                elif item.tag not in VOID:
                    stack.append((f"</{item.tag}>",))
                    stack.extend(reversed(item.children))
        return "".join(parts)

    def open_tag(self) -> str:
        attrs = "".join(f' {k}="{_escape(v).replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>"


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


class _Builder(HTMLParser):
    def __init__(self, fragment: bool):
        super().__init__(convert_charrefs=True)
        self.root = Node("div" if fragment else "html")
        self.fragment = fragment
        if fragment:
            self.open = [self.root]
        else:
            self.head, self.body = Node("head", parent=self.root), Node("body", parent=self.root)
            self.root.children = [self.head, self.body]
            self.open = [self.root, self.head]

    def _leave_head(self) -> None:
        if not self.fragment and self.open[1] is self.head:
            self.open = [self.root, self.body]

    def _close(self, names, walls) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return self._close(names, walls)
            if self.open[i].tag in walls or self.open[i].tag == "template":
                return

    def _make_room(self, tag) -> None:
        """Within a table, goes back to where the part belongs; cells outside of a row get one."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "template":
                return
            if self.open[i].tag == "table":
                break
        else:
            return
        while self.open[-1].tag not in ROOMS[tag]:
            self.open.pop()
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            row = Node("tr", parent=self.open[-1])
            self.open[-1].children.append(row)
            self.open.append(row)

    def _foreign(self) -> bool:
        """Within svg or math, where tags can close themselves."""
        return next((n.tag for n in reversed(self.open) if n.tag in ("svg", "math", "foreignobject")), "") in ("svg", "math")

    def handle_starttag(self, tag, attrs):
        named = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        if not self.fragment and tag in ("html", "head", "body"):
            node = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in named.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self._leave_head()
            return
        if tag not in HEAD:
            self._leave_head()
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "button", "table", "caption"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ROOMS:
            self._make_room(tag)
        node = Node(tag, named, self.open[-1])
        self.open[-1].children.append(node)
        # a form between the parts of a table is empty: what follows belongs to the table
        if tag not in VOID and not (tag == "form" and self.open[-1].tag in ROOMS["td"]):
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag in ("path", "svg", "circle", "rect", "line", "mspace", "mprescripts", "none") or self._foreign()):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "head":
            self._leave_head()
        if tag in VOID or tag in ("html", "head", "body"):
            if tag == "br":
                self.handle_starttag("br", [])
            return
        first = 1 if self.fragment else 2
        for i in range(len(self.open) - 1, first - 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag == "template" or self.open[i].tag in ("td", "th", "table", "button") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                break
        if tag == "p":
            self.handle_starttag("p", [])
            self.open.pop()

    def parse_html_declaration(self, i):
        """``<![`` is a comment up to the next ``>``, or to the end; in svg and math CDATA is text."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        cdata = self.rawdata.startswith("<![CDATA[", i) and self._foreign()
        end = self.rawdata.find("]]>" if cdata else ">", i + 3)
        stop = len(self.rawdata) if end < 0 else end
        if cdata and stop > i + 9:
            self.handle_data(self.rawdata[i + 9 : stop])
        return stop if end < 0 else end + (3 if cdata else 1)

    def handle_data(self, data):
        if not self.fragment and self.open[1] is self.head and len(self.open) == 2:
            if not data.strip():
                return
            self._leave_head()
        into = self.open[-1].children
        if into and isinstance(into[-1], str):
            into[-1] += data
        else:
            into.append(data)


def parse(html: str | None) -> Node:
    """A document: html with head and body. Null is an empty document."""
    builder = _Builder(False)
    builder.feed(html or "")
    builder.close()
    return builder.root


def parse_fragment(html: str | None) -> Node:
    """A div with what the markup holds."""
    builder = _Builder(True)
    builder.feed(html or "")
    builder.close()
    return builder.root


def body(document: Node) -> Node:
    return next(n for n in document.children if isinstance(n, Node) and n.tag == "body")


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([\^*$~]?=)["']?([^"'\]]*)["']?)?\]|(\*)""")


@lru_cache(maxsize=512)
def parse_selector(selector: str) -> tuple:
    """Chains of (combinator, conditions), last part first."""
    chains = []
    for one in re.split(r",(?![^\[]*\])", selector):
        parts, link = [], " "
        for token in re.findall(r"""(?:[^\s>\[]|\[[^\]]*\])+|>""", one.strip()):
            if token == ">":
                link = ">"
                continue
            tests = tuple((m[0].lower(), m[1], m[2], m[3], m[4], m[5]) for m in _SIMPLE.findall(token))
            parts.append((link, tests))
            link = " "
        chains.append(tuple(reversed(parts)))
    return tuple(chains)


class _AnyTag:
    def __contains__(self, tag: str) -> bool:
        return True


@lru_cache(maxsize=512)
def tags_of(selector: str):
    """The tags that a selector names for the node itself; any tag, if one of its chains takes any."""
    found = set()
    for chain in parse_selector(selector):
        tests = chain[0][1]
        if not tests or all(t[0] == t[1] == t[2] == t[3] == "" for t in tests):
            return _AnyTag()
        found |= {t[0] for t in tests if t[0]}
    return frozenset(found)


def _fits(node: Node, tests: tuple) -> bool:
    for tag, cls, ident, name, op, value in tests:
        if tag:
            if node.tag != tag:
                return False
        elif cls:
            if cls not in node.get("class").split():
                return False
        elif ident:
            if node.get("id") != ident:
                return False
        elif name:
            if name not in node.attrs:
                return False
            have = node.attrs[name]
            if op == "=" and have != value or op == "^=" and not have.startswith(value) or op == "*=" and value not in have or op == "$=" and not have.endswith(value) or op == "~=" and value not in have.split():
                return False
    return True


def _matches(node: Node, chain: tuple) -> bool:
    if not _fits(node, chain[0][1]):
        return False
    for (link, _), rest in zip(chain, (chain[i:] for i in range(1, len(chain)))):
        if link == ">":
            return node.parent is not None and _matches(node.parent, rest)
        return any(_matches(above, rest) for above in list(node.up())[1:])
    return True
