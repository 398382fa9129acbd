"""Markup that is safe to print: an allow-list of tags, http links, and math as MathML or TeX.

One walk over a tree writes the safe markup; the tree itself is not changed. For every element a policy
says whether it is kept, opened (only what it holds is kept) or dropped with all that it holds.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnloom.functions import rules
from turnloom.functions.dom import VOID, Node, collapse, parse_fragment

MATH = "tl-math"
KEPT, OPENED, DROPPED = "kept", "opened", "dropped"

#: What becomes of an element outside of math; tags that are not listed are opened.
POLICY = dict.fromkeys(rules.ALLOWED_TAGS - {"span"}, KEPT) | dict.fromkeys(rules.PICTURE_TAGS, DROPPED)
#: What becomes of an element inside of MathML.
MATH_POLICY = dict.fromkeys(rules.MATHML_TAGS, KEPT) | dict.fromkeys(rules.MATH_SOURCE_TAGS, DROPPED)

_TEX = re.compile(rules.TEX_MARK)
_SAFE_LINK = re.compile(rules.SAFE_LINK, re.I)


def escape(text: str | None) -> str:
    return entities.escape(text or "").replace("&#x27;", "&#39;")


def remove_noise(root: Node, selector: str = rules.NOISE_NODES) -> Node:
    """Takes the elements that match out of a tree, all in one pass over each list of children."""
    gone = {id(n) for n in root.all(selector)}
    if gone:
        for node in (root, *root.walk()):
            node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
    return root


def _attributes(pairs: dict[str, str]) -> str:
    return "".join(f' {k}="{_text(v).replace(chr(34), "&quot;")}"' for k, v in pairs.items())


def _text(value: str) -> str:
    return value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def _link(attrs: dict[str, str]) -> dict[str, str]:
    """What stays of a link's attributes: a safe address, opened apart. A rel or target that stands after
    the address takes ours away again."""
    kept: dict[str, str] = {}
    for name, value in attrs.items():
        if name != "href":
            kept.pop(name, None)
        elif _SAFE_LINK.match(value):
            kept |= {"href": value, "rel": "noopener noreferrer", "target": "_blank"}
    return kept


def _is_math(node: Node) -> bool:
    return node.tag in ("div", "span") and MATH in node.get("class").split()


def _decide(node: Node, inside: str) -> tuple[str, dict[str, str]]:
    """An element's fate and the attributes that stay. inside: '' or where in math it stands."""
    if _is_math(node):
        return KEPT, {k: v for k, v in node.attrs.items() if k in ("class", "role", "data-tex")}
    if inside == "mathml" or (inside and node.tag in rules.MATHML_TAGS):
        return MATH_POLICY.get(node.tag, OPENED), {k: v for k, v in node.attrs.items() if k.lower() in rules.MATHML_ATTRIBUTES}
    return POLICY.get(node.tag, OPENED), _link(node.attrs) if node.tag == "a" else {}


def _tex(node: Node) -> str:
    """A formula's TeX: as annotated, as a script holds it, as an attribute, or as its label looks."""
    noted = (n.raw_text().strip() for s in rules.TEX_NODES if (n := node.first(s)) is not None)
    named = (node.get(a).strip() for a in rules.TEX_ATTRIBUTES)
    label = node.get("aria-label").strip()
    return next(filter(None, (*noted, *named)), label if _TEX.search(label) else "")


def _formula(node: Node) -> str:
    """The wrapper of a formula with its MathML, or with its TeX as text; '' where it has neither."""
    math, tex = node if node.tag == "math" else node.first("math"), _tex(node)
    if math is None and not tex:
        return ""
    display = (node.get("display") or (math.get("display") if math is not None else "")).lower()
    names = {c.lower() for c in node.get("class").split()}
    block = display in ("block", "true") or node.tag == "div" or not names.isdisjoint(rules.BLOCK_MATH_CLASSES)
    tag, form = ("div", "block") if block else ("span", "inline")
    outside = {"class": f"{MATH} {MATH}-{'display' if block else 'inline'}", "role": "math"}
    if math is None:
        return f"<{tag}{_attributes(outside | {'data-tex': tex})}>{_text(tex)}</{tag}>"
    own = {k: v for k, v in (math.attrs | {"xmlns": "http://www.w3.org/1998/Math/MathML", "display": form}).items() if k.lower() in rules.MATHML_ATTRIBUTES}
    return f"<{tag}{_attributes(outside)}><math{_attributes(own)}>{_written(math.children, 'mathml')}</math></{tag}>"


def _written(nodes: list, inside: str = "") -> str:
    """Safe markup of nodes. inside: '' outside of math, 'formula' within what looks like a formula but
    holds none, 'wrapper' within a wrapper that was there before, 'mathml' within MathML."""
    parts: list[str] = []
    stack: list = [(n, inside) for n in reversed(nodes)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, tuple):
            parts.append(node[0])
            continue
        if isinstance(node, str):
            parts.append(_text(node))
            continue
        if not inside and not _is_math(node) and node.matches(rules.MATH_NODES):
            made = _formula(node)
            if made:
                parts.append(made)
                continue
            inside = "formula"
        if inside != "mathml" and node.matches(rules.NOISE_NODES):
            continue
        fate, attrs = _decide(node, "" if inside == "formula" else inside)
        if fate == DROPPED:
            continue
        if fate == KEPT:
            parts.append(f"<{node.tag}{_attributes(attrs)}>")
            if node.tag in VOID:
                continue
            stack.append(((f"</{node.tag}>",), inside))
        below = "wrapper" if _is_math(node) else inside
        stack.extend((n, below) for n in reversed(node.children))
    return "".join(parts)


def sanitize(source: Node | str | None, fallback: str = "") -> str:
    """The markup of a node, or of markup, made safe; without any content, the fallback text."""
    made = _written([source] if isinstance(source, Node) else parse_fragment(source).children)
    for empty in rules.EMPTY_BLOCKS:
        made = re.sub(empty, "", made, flags=re.I)
    return made.strip() or (f"<p>{escape(fallback)}</p>" if fallback else "")


def message(role: str, source: Node | str, thought: str = "") -> dict[str, str]:
    """A message of a node or of markup: its safe markup, and the text of that."""
    raw = re.sub(r"<[^>]+>", " ", source) if isinstance(source, str) else source.text()
    made = sanitize(source, raw)
    return {"role": role, "html": made, "text": collapse(parse_fragment(made).raw_text() or raw), "thought": thought}


@F.pandas_udf(StringType())
def sanitize_html(html: pd.Series, fallback: pd.Series) -> pd.Series:
    """Column form of ``sanitize``."""
    return pd.Series([sanitize(h, f or "") for h, f in zip(html, fallback)])
