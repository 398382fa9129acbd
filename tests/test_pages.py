"""Provider pages and sanitizer: fixtures worked out by hand."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from turnloom.functions import rules
from turnloom.functions.dom import body, collapse, parse, parse_fragment
from turnloom.functions.sanitize import sanitize
from turnloom.operators import providers

LONG = "an answer that is certainly longer than forty characters"

PAGES = [
    ("claude", '<main><div class="font-user-message">Hi</div><div class="font-claude-message"><p>Hello <b>there</b></p></div></main>', [("user", "Hi", ""), ("assistant", "Hello there", "")]),
    ("claude", '<main><div class="font-user-message">Hi</div><div class="font-user-message">Hi</div><div class="font-claude-message">A</div></main>', [("user", "Hi", ""), ("assistant", "A", "")]),
    ("claude", f'<main><div class="font-claude-message">{LONG}</div><div class="font-claude-message">{LONG} and more</div></main>', [("assistant", LONG, "")]),
    ("claude", '<main><div class="font-claude-message"><div class="font-claude-message"><p>Hello</p></div></div></main>', [("assistant", "Hello", "")]),
    ("claude", '<div class="prose">A</div>', [("assistant", "A", "")]),
    ("claude", '<div class="prose">see our Privacy Policy</div>', []),
    ("claude", '<div data-turn="user">Q</div><div data-message-author-role="assistant">B</div>', [("user", "Q", ""), ("assistant", "B", "")]),
    (
        "chatgpt",
        '<section data-turn="user"><div data-message-author-role="user"><div class="whitespace-pre-wrap">Q</div></div></section><section data-turn="assistant"><button>Thought for 5s</button>'
        '<div data-message-author-role="assistant"><div class="markdown"><p>A1</p></div></div></section>',
        [("user", "Q", ""), ("assistant", "A1", "Thought for 5s")],
    ),
    (
        "chatgpt",
        '<section data-turn="assistant"><div data-message-author-role="assistant"><p>long transient text</p></div><div data-message-author-role="assistant" data-turn-start-message="true"><p>short</p></div></section>',
        [("assistant", "short", "")],
    ),
    ("chatgpt", '<div data-message-author-role="user"><div class="whitespace-pre-wrap">Q</div></div><div data-message-author-role="assistant"><div class="markdown">A1</div></div>', [("user", "Q", ""), ("assistant", "A1", "")]),
    ("chatgpt", '<textarea><section data-turn="user"><div data-message-author-role="user">Q</div></section></textarea>', [("user", "Q", "")]),
    ("gemini", '<share-viewer><share-turn-viewer><div class="query-text"><p class="query-text-line">Q</p></div><message-content><div class="markdown-main-panel"><p>A</p></div></message-content></share-turn-viewer></share-viewer>', [("user", "Q", ""), ("assistant", "A", "")]),
    ("gemini", '<share-turn-viewer><p class="query-text-line">Q</p><div class="markdown-main-panel">The report is done</div></share-turn-viewer>', [("user", "Q", "")]),
    ("gemini", '<div class="query-text">Q1</div><div class="markdown-main-panel">A1</div><div class="query-text">Q2</div><div class="markdown-main-panel">A2</div>', [("user", "Q1", ""), ("user", "Q2", ""), ("assistant", "A1", ""), ("assistant", "A2", "")]),
    ("grok", '<div data-testid="user-message">u</div><div data-testid="user-message">u</div><div data-testid="assistant-message"><div class="thinking-container">hmm</div><div class="markdown">a</div></div>', [("user", "u", ""), ("user", "u", ""), ("assistant", "a", "hmm")]),
    ("qwen", '<div class="share-layout-messages"><div class="qwen-chat-message qwen-chat-message-user"><p class="user-message-content">Q</p></div></div>', [("user", "Q", "")]),
    ("qwen", '<div class="user-message">Q</div><div class="assistant-message"><div class="content">A</div></div>', [("user", "Q", ""), ("assistant", "A", "")]),
    ("qwen", '<script type="application/json">{"m":[{"role":"user","content":"Q"},{"role":"assistant","content":{"parts":["A","B"]}}]}</script>', [("user", "Q", ""), ("assistant", "A B", "")]),
    ("qwen", '<script>var s={"role":"user","content":"don\'t stop"};var t={a:1}</script>', [("user", "don", "")]),
]


@pytest.mark.parametrize("provider, html, want", PAGES)
def test_messages(provider, html, want):
    found = providers.parse_page(provider, html)["messages"]
    assert [(m["role"], m["text"], m["thought"]) for m in found] == want


@pytest.mark.parametrize(
    "html, want",
    [
        ('<a href="javascript:x" onclick="y">t</a>', "<a>t</a>"),
        ('<a href="https://e.test/" rel="nofollow">t</a>', '<a href="https://e.test/" target="_blank">t</a>'),
        ('<section><h2 id="x">T</h2><img src="i"></section>', "<h2>T</h2>"),
        ('<table><tr><td colspan="2">x</td></tr></table>', "<table><tr><td>x</td></tr></table>"),
        ("<div><div> </div></div>", "<div></div>"),
        ('<span data-tex="a^2"></span>', '<span class="tl-math tl-math-inline" role="math" data-tex="a^2">a^2</span>'),
        ("<button>x</button>", "<p>x</p>"),
        (None, "<p>x</p>"),
    ],
)
def test_sanitize(html, want):
    assert sanitize(html, "x") == want


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</div>", "<div class=x>", "<a href='http://x'>", "<a onclick=1 href=#>", "<script>", "</script>", "text", "<span>", "&lt;", "<td>", "<table>", "<li>", "<svg/>", "<math>", "</math>", "<img src=x>"]), max_size=14))
def test_sanitize_keeps_to_the_list_and_is_idempotent(parts):
    made = sanitize("".join(parts))
    tree = parse_fragment(made)
    for node in tree.walk():
        assert node.tag in rules.ALLOWED_TAGS | rules.MATHML_TAGS
        assert not any(k.startswith("on") or k == "style" for k in node.attrs)
        assert node.get("href") == "" or node.get("href").startswith(("http", "#"))
    assert sanitize(made).count("<script") == 0


def test_tree():
    tree = parse("<title>T</title><ul><li>a<li>b</ul><p>x<div>y</div><p><b>c<br><p>d")
    assert [n.text() for n in tree.all("li")] == ["a", "b"]
    assert [n.tag for n in body(tree).children if not isinstance(n, str)] == ["ul", "p", "div", "p", "p"]
    assert tree.first("title").text() == "T" and parse(None).text() == ""
    assert parse_fragment("<p>a</p><p>b</p>").text() == "ab"
    assert collapse("\xa0a\n﻿b ") == "a b"
    assert [n.text() for n in parse("<div class='a b'><i x='yz'>1</i></div><i>2</i>").all(".b > i[x^=y], div .c")] == ["1"]


def test_structured_values():
    assert providers.structured_text({"text": "", "parts": ["a", {"value": " b "}]}) == "a\nb"
    assert [c for _, c in providers.walk_json({"2": {"role": "user", "text": "b"}, "1": {"role": "user", "text": "a"}, "x": {"author": {"role": "bot"}, "content": None, "text": "c"}})] == ["a", "b", "c"]
    assert providers._loads("NaN") is None and providers._decoded('a\\nb"') == 'a\nb"'


@pytest.mark.parametrize(
    "html, want",
    [
        ("a<![ x>b", "ab"),
        ("a<![>b", "ab"),
        ("a<![]>b", "ab"),
        ("a<![foo[x]]>b", "ab"),
        ("a<![foo", "a"),
        ("a<![", "a"),
        ("a<![CDATA[ c > d ]]>b", "a d ]]>b"),
        ("a<![if !IE]>b<![endif]>c", "abc"),
        ("a<svg><text><![CDATA[ c > d ]]></text></svg>b", "a c > d b"),
        ("a<svg><text><![CDATA[c", "ac"),
        ("<!doctype html><!-- c -->a<!x>b", "ab"),
    ],
)
def test_marked_sections(html, want):
    assert body(parse(html)).text() == want
    assert parse_fragment(html).text() == want


def test_a_page_with_a_marked_section_does_not_fail_the_others():
    assert providers.parse_page("claude", '<![foo[ x><div class="font-user-message">Hi<![]></div>')["messages"][0]["text"] == "Hi"
    assert sanitize("<p>a<![ x]>b</p>") == "<p>ab</p>"
