"""Share pages made from conversation texts, with the markup of each provider, and what they hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import rules, text
from turnloom.functions.dom import parse

@dataclass(frozen=True)
class Form:
    """How a conversation is written as a share page, and what a parser is to find there. {} is a turn's
    text as markup (or as a JSON string), # the conversation's id."""

    provider: str
    link: str
    user: str
    assistant: str
    user_html: str
    assistant_html: str
    page: str = "<main>{}</main>"
    thought: str = ""
    date: str = ""
    title: str = "<title>Chat # | Shared Grok</title>"  # of pages with an odd id
    canonical: str = ""  # where the link stands if the row has none
    joint: str = "\n"
    json: bool = False  # the text stands as a JSON string
    users_first: bool = False  # all user turns are found first
    cut: str = ""  # the text ends where the pattern that finds it sees this character
    shorter: int = 0  # later copies of a turn lack so many characters


_CANONICAL = '<link rel="canonical" href="{}">'
_OG = '<meta property="og:title" content="Chat #">'
_DIV, _P, _DIV_P = "<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>"
_CHATGPT_USER = '<section data-turn="user"><div data-message-author-role="user"><div class="whitespace-pre-wrap">{}</div></div></section>'
_CHATGPT_ASSISTANT = '<section data-turn="assistant"><button>Thought for 5s</button><div data-message-author-role="assistant"><div class="markdown"><p>{}</p></div></div></section>'
_GEMINI_USER = '<share-turn-viewer><div class="query-text"><p class="query-text-line">{}</p></div></share-turn-viewer>'
_GEMINI_ASSISTANT = '<share-turn-viewer><message-content><div class="markdown-main-panel"><p>{}</p></div></message-content></share-turn-viewer>'

#: Each provider's usual markup, and markup in which only a later stage of its parser finds the messages.
FORMS = {
    "claude": Form("claude", "https://claude.ai/share/", '<div class="font-user-message"><p>{}</p></div>', '<div class="font-claude-message"><div class="font-claude-message prose"><p>{}</p></div></div>', _DIV_P, _DIV_P),
    "claude_prose": Form("claude", "https://claude.ai/share/", '<div class="font-user-message">{}</div>', '<div class="prose"><p>{}</p></div>', _DIV, _DIV_P, canonical=_CANONICAL, title='<meta property="og:title" content="Chat # | Claude"><title>Other</title>'),
    "claude_roles": Form("claude", "https://claude.ai/share/", '<div data-message-author-role="user"><p>{}</p></div>', '<div data-turn="claude"><p>{}</p></div>', _DIV_P, _DIV_P, canonical=_CANONICAL),
    "claude_bare": Form("claude", "https://claude.ai/share/", '<div class="font-user-message">{}</div>', '<div class="prose">{}</div>', _DIV, _DIV, page="<header><main>{}</main></header>", canonical=_CANONICAL),
    "claude_near": Form("claude", "https://claude.ai/share/", '<div class="font-user-message">{}</div>', '<div class="font-claude-message">{}</div>', _DIV, _DIV, shorter=3),
    "chatgpt": Form("chatgpt", "https://chatgpt.com/share/", _CHATGPT_USER, _CHATGPT_ASSISTANT, _DIV, _DIV_P, thought="Thought for 5s"),
    "chatgpt_roles": Form("chatgpt", "https://chatgpt.com/share/", '<div data-message-author-role="user"><div class="whitespace-pre-wrap">{}</div></div>', '<div data-message-author-role="assistant"><div class="markdown">{}</div></div>', _DIV, _DIV, title=_OG, canonical=_CANONICAL),
    "chatgpt_raw": Form("chatgpt", "https://chatgpt.com/share/", _CHATGPT_USER, _CHATGPT_ASSISTANT, "<div><div>{}</div></div>", "<div><div><p>{}</p></div></div>", page="<main></main><article>{}</article>", thought="Thought for 5s", title=_OG, canonical=_CANONICAL),
    "gemini": Form("gemini", "https://gemini.google.com/share/", _GEMINI_USER, _GEMINI_ASSISTANT, _P, _DIV_P, page="<share-viewer>{}</share-viewer>"),
    "gemini_lines": Form(
        "gemini", "https://gemini.google.com/share/", '<p class="query-text-line">{}</p>', '<div class="markdown-main-panel"><p>{}</p></div>', _P, _DIV_P,
        page='<p class="publish-time"> May 5, 2025</p><div class="share-landing-page_content">{}</div>', date="May 5, 2025", title='<div class="headline"><strong>Chat #</strong></div>', canonical='<a class="share-link" href="{}">link</a>', users_first=True,
    ),
    "gemini_raw": Form("gemini", "https://gemini.google.com/share/", _GEMINI_USER, _GEMINI_ASSISTANT, _DIV_P, _DIV_P, page="<share-viewer></share-viewer>{}", title=_OG, canonical=_CANONICAL),
    "grok": Form("grok", "https://grok.com/share/", '<div data-testid="user-message"><div class="markdown">{}</div></div>', '<div data-testid="assistant-message"><div class="thinking-container">hmm</div><div class="response-content-markdown"><p>{}</p></div></div>', _DIV, _DIV_P, page="{}", thought="hmm"),
    "grok_whole": Form("grok", "https://grok.com/share/", '<p data-testid="user-message">{}</p>', '<div data-testid="assistant-message"><p>{}</p></div>', _P, _DIV_P, page="{}", title='<meta name="twitter:title" content="Chat #">', canonical=_CANONICAL),
    "qwen": Form(
        "qwen", "https://chat.qwen.ai/s/", '<div class="qwen-chat-message qwen-chat-message-user"><p class="user-message-content">{}</p></div>',
        '<div class="qwen-chat-message qwen-chat-message-assistant"><span class="qwen-chat-thinking-status-card-title-text">Done</span><div class="response-message-content phase-answer"><div class="qwen-markdown">{}</div></div></div>',
        _P, _DIV, page='<div class="share-layout-date">May 5, 2025</div><div class="share-layout-messages">{}</div>', thought="Done", date="May 5, 2025",
    ),
    "qwen_generic": Form(
        "qwen", "https://chat.qwen.ai/s/", '<div data-role="human"><p>{}</p></div>', '<div class="assistant-message"><div class="bar">Copy</div><div class="markdown-body">{}</div></div>', _P, _DIV,
        page="<time>May 5, 2025</time>{}", date="May 5, 2025", title="<h1>Chat #</h1>", canonical=_CANONICAL,
    ),
    "qwen_json": Form(
        "qwen", "https://chat.qwen.ai/s/", '{"author":{"role":"human"},"content":{"parts":[{}]}}', '{"sender":"bot","text":{"value":{}}}', _P, _P,
        page='<script type="application/json">{"data":{"list":[{}]}}</script>', joint=",", json=True, canonical=_CANONICAL,
    ),
    "qwen_mined": Form("qwen", "https://chat.qwen.ai/s/", 'push({"role":"user","content":{}});', 'push({"answer":{},"role":"assistant"});', _P, _P, page="<script>load();{}</script>", json=True, canonical=_CANONICAL, cut="'", users_first=True),
}


def _fill(form: str, value: Column) -> Column:
    before, after = form.rsplit("{}", 1)
    return F.concat(F.lit(before), value, F.lit(after))


def _numbered(form: str, ident: Column) -> Column:
    before, after = form.split("#")
    return F.concat(F.lit(before), ident.cast("string"), F.lit(after))


def provider_pages(conversations: DataFrame, name: str) -> DataFrame:
    """``page_id, url, html``: each conversation as a share page of that form. Conversations with an odd id
    have a title; every turn is there twice, as captures of a page are. url is null where the page itself
    tells its link."""
    form, ident = FORMS[name], F.col("conv_id")
    turns = conversations.filter("role in ('user', 'assistant')").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    later = turns.withColumn("turn", F.col("turn") + 1000)
    if form.shorter:
        later = later.withColumn("text", F.when(F.length("text") > 50, F.expr(f"substring(text, 1, length(text) - {form.shorter})")).otherwise(F.col("text")))
    turns = turns.unionByName(later)
    if form.json:  # as a JSON string, in which no tag can end
        value = F.to_json(F.struct(F.col("text").alias("t")))
        value = F.replace(F.substring(value, F.lit(6), F.length(value) - 6), F.lit("</"), F.lit("<\\/"))
    else:
        value = text.escape_html("text")
    turns = turns.select("conv_id", "turn", F.when(F.col("role") == "user", _fill(form.user, value)).otherwise(_fill(form.assistant, value)).alias("part"))
    made = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda t: t["part"]), form.joint).alias("turns"))
    link = F.concat(F.lit(form.link), ident.cast("string"))
    head = F.when(ident % 2 == 1, _numbered(form.title, ident)).otherwise(F.lit(""))
    head = F.concat(head, _fill(form.canonical, link)) if form.canonical else head
    html = F.concat(F.lit("<!doctype html><html><head>"), head, F.lit("</head><body><nav>Sign in</nav>"), _fill(form.page, F.col("turns")), F.lit("</body></html>"))
    return made.select(ident.alias("page_id"), (F.lit(None).cast("string") if form.canonical else link).alias("url"), html.alias("html"))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;')"


def _filled(form: str, value: str) -> str:
    before, after = form.split("{}")
    return f"'{before}' || {value} || '{after}'"


def provider_sql(name: str, collapse: Callable[[str], str], key: Callable[[str], str], columns: str = "page_id, provider, title, date, url, n_messages, body", more: str = "") -> str:
    """SQL for the conversations that such pages hold. ``kept`` has their messages, ``made`` a row each;
    more: further common table expressions."""
    form = FORMS[name]
    noise = {"qwen": [f"v = '{p}' OR starts_with(v, '{p} ')" for p in rules.NOISE_PREFIXES + rules.NOISE_PREFIXES_QWEN], "grok": []}.get(form.provider, [f"contains(v, '{p}')" for p in rules.NOISE_PARTS.get(form.provider, ())])
    drop = " OR ".join(noise) or "false"
    once = "QUALIFY row_number() OVER (PARTITION BY page_id, role, md5(k) ORDER BY pos) = 1" if form.provider != "grok" else ""
    raw = "coalesce(text, '')" if not form.cut else f"split_part(coalesce(text, ''), '{form.cut.replace(chr(39), chr(39) * 2)}', 1)"
    inside = f"regexp_replace({raw}, '^[{rules.SPACE_CLASS_SQL}]+|[{rules.SPACE_CLASS_SQL}]+$', '', 'g')" if form.json else raw
    html = f"CASE WHEN role = 'user' THEN {_filled(form.user_html, _escaped(inside))} ELSE {_filled(form.assistant_html, _escaped(inside))} END"
    later = "" if form.shorter else " UNION ALL SELECT page_id, pos + 1000, role, text, html FROM t"
    order = "role = 'assistant', pos" if form.users_first else "pos"
    return f"""WITH t AS (SELECT conv_id AS page_id, turn AS pos, role, {collapse(raw)} AS text, {html} AS html FROM conversations WHERE role IN ('user', 'assistant')),
twice AS (SELECT * FROM t{later}),
m AS (SELECT *, {key('text')} AS k, lower(text) AS v, CASE WHEN role = 'assistant' THEN '{form.thought}' ELSE '' END AS thought FROM twice),
kept AS (SELECT * FROM m WHERE v <> '' AND NOT ({drop}) {once}),
c AS (SELECT page_id, count(*) AS n_messages, md5(string_agg(role || '|' || text || '|' || html || '|' || thought, chr(10) ORDER BY {order})) AS body,
    arg_min(text, CASE WHEN role = 'user' THEN pos ELSE pos + 1000000 END) AS f FROM kept GROUP BY page_id),
made AS (SELECT page_id, '{form.provider}' AS provider, CASE WHEN page_id % 2 = 1 THEN 'Chat ' || page_id WHEN length(f) > 78 THEN left(f, 75) || '...' ELSE f END AS title,
    '{form.date or "Thursday, February 29, 2024"}' AS date, '{form.link}' || page_id AS url, n_messages, body, NULL::VARCHAR AS error FROM c){more}
SELECT {columns} FROM made"""


def walked_scripts(conversations: DataFrame, value: str) -> DataFrame:
    """``page_id, script, type, value``: each conversation as one object in a script. Its turns (their text
    by the given expression) have integer keys that fall if even, else keys that are none; they stand in
    17 lists each fifth turn but one, in 18 each fifth, so that they lie 18 and 19 values deep."""
    turn = F.col("turn")
    turns = conversations.filter("role in ('user', 'assistant')").select("conv_id", "turn", "role", F.to_json(F.struct(F.expr(value).alias("t"))).alias("json"))
    quoted = F.substring("json", F.lit(6), F.length("json") - 6)
    said = F.when(F.col("role") == "user", '"role":"human"').otherwise('"author":{"type":"bot"}')
    content = F.when(turn % 3 == 0, F.concat(F.lit('"content":'), quoted)).when(turn % 3 == 1, F.concat(F.lit('"text":{"z":1,"parts":['), quoted, F.lit("]}"))).otherwise(F.concat(F.lit('"content":null,"answer":[{"text":""},{"value":'), quoted, F.lit("}]")))
    deep = F.when(turn % 5 == 3, 17).when(turn % 5 == 4, 18).otherwise(0)
    key = F.when(turn % 2 == 0, (100_000 - turn).cast("string")).otherwise(F.concat(F.lit("k"), turn.cast("string")))
    part = F.concat(F.lit('"'), key, F.lit('":'), F.repeat(F.lit("["), deep), F.lit("{"), said, F.lit(","), content, F.lit("}"), F.repeat(F.lit("]"), deep))
    made = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda t: t["part"]), ",").alias("parts"))
    return made.select(F.col("conv_id").alias("page_id"), F.lit(0).alias("script"), F.lit("application/json").alias("type"), F.concat(F.lit("{"), F.col("parts"), F.lit("}")).alias("value"))


def dom_summary(pages: DataFrame) -> DataFrame:
    """``page_id, n_elements, n_noise, text``: of each page's tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                tree = parse(html)
                found.append((page_id, sum(1 for _ in tree.walk()), len(tree.all(rules.NOISE_NODES)), tree.text()))
            yield pd.DataFrame(found, columns=["page_id", "n_elements", "n_noise", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, n_elements long, n_noise long, text string")
