import random

import pytest

from turnloom.functions.dom import Node, body, parse
from turnloom.llm import html

PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<h1>T</h1>one <b>two</b>\n three<br>four<br><br>five", "T\n\none two three\nfour\n\nfive"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li><p>d</p></ul>x", "- a\n- b\n  - c\n\n- d\n\nx"),
    ("<ol start=9><li>a</li><li>b<br>c</li><li value=3>d</ol>", "9. a\n10. b\n    c\n3. d"),
    ("<table><caption>C</caption><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer<td>2</table>", "C\nname    n\nx       10\nlonger  2"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>d</table>after", "a  b\n   c\nd\n\nafter"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>z</table>", "in  ner  z"),
    ("<pre>  x\n\n    y\n</pre>z", "  x\n\n    y\n\nz"),
    ("<script>var t='</p>'</script><style>p{}</style><p hidden>h</p><p style='display: none'>n<b>o</b></p><input type=hidden value=v><template>t</template>seen<!-- no -->", "seen"),
    ("<title>no</title><nav><a href=x>Home</a> <a>About</a></nav><p>A&nbsp;&amp; B</p>", "Home About\n\nA\xa0& B"),
    ("<p><b>x<br><p>y</p>", "x\n\ny"),
    ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote><img alt='pic'>", "t\nd\n\nq\n\npic"),
    ("<ul><li><ul><li>deep</ul></ul>", "- - deep"),
    ("日本<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本\n\n日本   x\nabcde  y"),
    (None, ""), ("", ""), ("<div></div>  ", ""), ("just text", "just text"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_layout(page, want):
    assert html.extract_text(page) == want


def visible(node):
    """Brute force: all text that is not within something hidden, without white space and marks."""
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif "hidden" not in child.attrs and child.get("style") != "display:none":
            yield from visible(child)


def test_no_text_is_lost_or_made_up():
    rng = random.Random(8)
    tags = ["p", "div", "b", "li", "ul", "ol", "table", "tr", "td", "th", "h2", "pre", "span", "blockquote", "i", "tbody"]
    for _ in range(400):
        parts, n = [], 0
        for _ in range(rng.randrange(30)):
            r = rng.random()
            if r < 0.4:
                parts.append(f"<{rng.choice(tags)}{rng.choice(['', '', ' hidden', ' style=display:none'])}>")
            elif r < 0.6:
                parts.append(f"</{rng.choice(tags)}>")
            else:
                parts.append(f" w{n}x ")
                n += 1
        page = "".join(parts)
        want = {w for t in visible(body(parse(page))) for w in t.split()}
        got = [w for w in html.extract_text(page).split() if w.startswith("w")]
        assert len(got) == len(set(got)) and set(got) == want, page


def test_deep_pages():
    page = "<div>" * 5000 + "x" + "<ul><li>" * 300 + "y"
    assert html.extract_text(page).split()[0] == "x"
    assert html.extract_text("<table><tr><td>" * 50 + "z").strip().endswith("z")
    assert isinstance(parse(page), Node)


def test_frame(spark):
    rows = [(1, "<p>a<p>b", "x"), (1, "<p>a<p>b", "y"), (None, None, None), (2, "<p>" + "long " * 200_000, "")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.n_chars, r.n_lines) for r in html.extract(df).collect()), key=str)
    assert got == sorted([(1, 4, 3), (1, 4, 3), (None, 0, 0), (2, 999_999, 1)], key=str)
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<table><tr><form><td>Name<td>Price</form></tr></table>", "Name  Price"),
        ("<table><form><tr><td>a<td>b<tr><td>c<td>d</form></table>e", "a  b\nc  d\n\ne"),
        ("<table><tr>text<td>x</td></tr><tr>more<td>y</td></tr></table>", "text more\nx\ny"),
        ("<table><tr><div>out</div><td>x</td></tr></table>", "out\nx"),
        ("<table><tr><div><td>x<td>y</table>", "x  y"),
        ("<table><tbody>text<tr><td>x</tr></tbody></table>", "text\nx"),
        ("<table><tbody><td>x</td><td>y</td></tbody></table>", "x  y"),
        ("<table><td>x<tr><td>y</table>", "x\ny"),
        ("<table><colgroup><col><col><tr><td>x<td>y</table>", "x  y"),
        ("<table><caption>C<tr><td>x</table>", "C\nx"),
        ("<table><tr><td>a<template><tr><td>no</td></tr></template>b</table>", "ab"),
        ("<p>a</p><svg><title>no</title><defs/><desc>no</desc><g/><text>b</text><text>c <tspan>d</tspan></text><text display=none>no</text></svg><desc>e</desc>", "a\n\nb\nc d\ne"),
    ],
)
def test_text_outside_of_cells(page, want):
    assert html.extract_text(page) == want


def test_tables_lose_no_text():
    """Every word of a page is in the text, whatever parts of tables stand around it."""
    rng = random.Random(5)
    tags = ["table", "table", "tr", "tr", "td", "td", "th", "tbody", "thead", "form", "div", "b", "caption", "colgroup", "p", "svg", "text"]
    for _ in range(1500):
        parts, n = ["<table>"], 0
        for _ in range(rng.randrange(25)):
            r = rng.random()
            parts.append(f"<{rng.choice(tags)}>" if r < 0.45 else f"</{rng.choice(tags)}>" if r < 0.6 else f" w{n}x ")
            n += r >= 0.6
        page = "".join(parts)
        got = html.extract_text(page).split()
        assert sorted(w for w in got if w.startswith("w")) == sorted(f"w{i}x" for i in range(n)), page


WIDE = "word " * 13 + "end"  # 68 columns


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div style='visibility:hidden'>no<p style='Visibility : visible'>yes<b style='visibility:collapse'>no</b></div>", "yes"),
        ("<p style='background:url(display-none);display:none'>no</p><p style='display:none;display:block'>a<p style='display:none!important;display:block'>no", "a"),
        ("<p style='content: visibility hidden'>a</p><p class='display:none'>b", "a\n\nb"),
        ("<table style=visibility:hidden><tr><td>no<td style=visibility:visible>yes</table>", "yes"),
        ("<div style=visibility:hidden><table><tr><td>no<table style=visibility:visible><tr><td>in</table></table></div>", "in"),
        ("<ul><li style=visibility:hidden>no<li>b</ul>", "- b"),
        (f"<table><tr><td>{WIDE}<td>x<tr><td>y<td>z</table>", "word " * 11 + "word  x\nword end\ny" + " " * 60 + "z"),
        (f"<table><tr><td>{'l' * 70}<td>x<tr><td>y<td>z</table>", "l" * 70 + "\n   x\ny  z"),
        ("<table><tr><td><table><tr><td><table><tr><td>a<td>b<tr><td>cc<td>d</table></table><td>e</table>", "a   b  e\ncc  d"),
        ("<table><tr><td><pre>a\n  b</pre><td>c</table>", "a    c\n  b"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=99999999>a<td>b<tr><td rowspan=' 2x'>c<td>d<tr><td>e</table>", "a     b\nc  d\n   e"),
    ],
)
def test_visibility_and_cells(page, want):
    assert html.extract_text(page) == want


def test_layout_of_made_pages():
    """Pages written from blocks, lists and tables whose layout is known without a tree."""
    rng = random.Random(3)
    words = lambda most: " ".join(rng.choice(["ab", "c", "def", "日本", "x&y"]) for _ in range(rng.randrange(1, most)))
    safe = lambda t: t.replace("&", "&amp;")
    columns = lambda t: sum(2 if c in "日本" else 1 for c in t)

    def items(depth):
        ordered, at, lines, markup = rng.random() < 0.5, rng.randrange(1, 12), [], ""
        tag = f"ol start={at}" if ordered else "ul"
        for _ in range(rng.randrange(1, 4)):
            mark, text = f"{at}. " if ordered else "- ", words(6)
            lines.append(mark + text)
            markup += f"<li>{safe(text)}"
            if depth < 3 and rng.random() < 0.3:
                inner, inside = items(depth + 1)
                lines += [" " * len(mark) + line for line in inner]
                markup += inside
            at += 1
        return lines, f"<{tag}>{markup}</{tag[:2]}>"

    def table():
        rows = [[words(4) if rng.random() < 0.9 else "" for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        used = sorted({k for row in rows for k, text in enumerate(row) if text})
        wide = {k: max(columns(row[k]) for row in rows if len(row) > k) for k in used}
        lines = ["  ".join((row[k] if k < len(row) else "") + " " * (wide[k] - columns(row[k] if k < len(row) else "")) for k in used).rstrip() for row in rows]
        return [line for line in lines if line], "<table>" + "".join("<tr>" + "".join(f"<td>{safe(c)}</td>" for c in row) + "</tr>" for row in rows) + "</table>"

    for _ in range(300):
        want, page = [], ""
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                text = words(8)
                lines, markup = [text], f"<p>{safe(text)}</p>"
            else:
                lines, markup = items(0) if kind < 0.7 else table()
            if lines:
                want.append("\n".join(lines))
            page += markup + rng.choice(["", "\n", "<script>no</script>"])
        assert html.extract_text(page) == "\n\n".join(want), page
