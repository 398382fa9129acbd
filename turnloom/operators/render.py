"""Conversations to printable HTML, as column expressions over markup that is already safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.functions.sanitize import MATH

STYLES = """
.paper{max-width:210mm;margin:auto;font:11pt/1.5 sans-serif;color:#222}
.paper .title{font-size:16pt;font-weight:600}.paper .subtitle{color:#666;font-size:9pt}
.message{margin:5mm 0;break-inside:avoid-page}.message.user{text-align:right}
.bubble{display:inline-block;text-align:left;background:#f0f0ee;border-radius:4mm;padding:2mm 4mm;white-space:pre-wrap}
.bubble.small{border-radius:9mm}.thought{color:#777;font-size:9pt}
.tl-math-display{display:block;text-align:center}pre{white-space:pre-wrap;background:#f6f6f4;padding:3mm}
table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:1mm 2mm}
@media print{@page{size:A4;margin:12mm}}
"""


def render_message(m: Column) -> Column:
    """A user's text in a bubble (its markup, where that holds math), an assistant's markup as it is."""
    shown = F.when(text.blank(m["text"]), F.trim(text.strip_tags(m["html"]))).otherwise(m["text"])
    rich = F.coalesce(m["html"], F.lit(""))
    bubble = F.when(rich.contains(f'class="{MATH}'), rich).otherwise(text.escape_html(shown))
    small = F.when(text.small_bubble(shown), F.lit(" small")).otherwise(F.lit(""))
    user = F.concat(F.lit('<div class="message user"><div class="bubble'), small, F.lit('">'), bubble, F.lit("</div></div>"))
    thought = F.when(F.coalesce(m["thought"], F.lit("")) != "", F.concat(F.lit('<div class="thought"><span>'), text.escape_html(m["thought"]), F.lit("</span></div>"))).otherwise(F.lit(""))
    body = F.when(rich == "", F.concat(F.lit("<p>"), text.escape_html(m["text"]), F.lit("</p>"))).otherwise(rich)
    assistant = F.concat(F.lit('<div class="message assistant"><div class="copy">'), thought, body, F.lit("</div></div>"))
    return F.when(m["role"] == "user", user).otherwise(assistant)


def render_messages(messages: Column | str) -> Column:
    return F.array_join(F.transform(messages, render_message), "\n")


def render_template(title: Column, date: Column, provider: Column, messages: Column) -> Column:
    """Title, date and provider over the messages."""
    head = F.concat(F.lit('<div class="paper"><header><div class="title">'), text.escape_html(title), F.lit('</div><div class="subtitle">'), text.escape_html(date), F.lit(" · "), text.escape_html(F.upper(provider)), F.lit('</div></header><div class="chat">'))
    return F.concat(head, render_messages(messages), F.lit("</div></div>"))


def render_styles() -> str:
    return f"<style>{STYLES}</style>"


def render(conversations: DataFrame, standalone: bool = False) -> DataFrame:
    """conversations (title, date, provider, messages) with ``document``; rows without messages have none."""
    inner = render_template(F.col("title"), F.col("date"), F.col("provider"), F.col("messages"))
    if standalone:
        inner = F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), text.escape_html("title"), F.lit(f"</title>{render_styles()}</head><body>"), inner, F.lit("</body></html>"))
    return conversations.withColumn("document", F.when(F.size("messages") > 0, inner))
