"""What is captured of a live share page, from its stored markup: turns that are cleaned one by one and
put together to a document, or a snapshot of the messages of a page.

Each page is read to a tree within an Arrow batch; identity, first-wins and assembly of turns are
DataFrame operators (``text.turn_key``, ``messages.first_wins``, ``synthetic_pages``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnloom.functions import rules, text
from turnloom.functions.batches import sliced
from turnloom.functions.dom import Node, parse, parse_fragment
from turnloom.functions.sanitize import remove_noise
from turnloom.operators.messages import first_wins

TURNS = "page_id long, pos int, turn_id string, container_id string, test_id string, turn string, text string, html string"
_HEAD = pa.schema([(name, pa.string()) for name in ("title", "canonical", "og_title", "og_description", "lang")])


def outer(node: Node) -> str:
    return f"{node.open_tag()}{node.html()}</{node.tag}>"


def clean_clone(node: Node, selector: str = rules.TURN_NOISE_NODES) -> str:
    """The markup of a node without the interface parts inside it; the node itself always stays."""
    return outer(remove_noise(node.copy(), selector))


@F.pandas_udf(StringType())
def clean_turns(html: pd.Series) -> pd.Series:
    """Column form of ``clean_clone``, for markup of whole turns."""
    return html.map(lambda h: None if h is None else "".join(clean_clone(n) if isinstance(n, Node) else n for n in parse_fragment(h).children))


def page_turns(pages: DataFrame) -> DataFrame:
    """The turns with text of pages (page_id, html), in their order, cleaned, with what they are known by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, at = [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                turns = [(n, t) for n in parse(html).all(rules.TURN_NODES) if (t := n.text())]
                found += [{"turn_id": n.get("data-turn-id"), "container_id": n.get("data-turn-id-container"), "test_id": n.get("data-testid"), "turn": n.get("data-turn"), "text": t, "html": clean_clone(n)} for n, t in turns]
                at += [(i, k) for k in range(len(turns))]
            names = ("turn_id", "container_id", "test_id", "turn", "text", "html")
            rows = batch.column("page_id").take(pa.array([i for i, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array([k for _, k in at], pa.int32()), *(pa.array([f[n] for f in found], pa.string()) for n in names)], names=["page_id", "pos", *names])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, TURNS)


def page_heads(pages: DataFrame) -> DataFrame:
    """``page_id, title, canonical, og_title, og_description, lang`` of pages (page_id, url, html); the
    page's own link stands for a missing canonical one."""

    def value(tree: Node, selector: str, name: str) -> str:
        node = tree.first(selector)
        return "" if node is None else node.get(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                tree = parse(html)
                title = tree.first("title")
                rows.append({
                    "title": "" if title is None else title.text(), "canonical": value(tree, "link[rel=canonical]", "href") or url or "", "lang": tree.get("lang") or "en",
                    "og_title": value(tree, "meta[property='og:title']", "content"), "og_description": value(tree, "meta[property='og:description']", "content"),
                })
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *pa.RecordBatch.from_pylist(rows, _HEAD).columns], names=["page_id", *_HEAD.names])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, " + ", ".join(f"{n} string" for n in _HEAD.names))


def captured(turns: DataFrame) -> DataFrame:
    """Turns (as of ``page_turns``, of one capture or several with later ``pos``): of those known by the
    same key in a page the first."""
    key = text.turn_key("turn_id", "container_id", "test_id", "turn", "text")
    return first_wins(turns.withColumn("_key", key), ["page_id", "_key"], ["pos"]).drop("_key")


def synthetic_pages(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """``page_id, html``: a document of each page's captured turns, with its title and links. A page
    without any turn has a document without turns."""
    made = turns.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda t: t["html"]), "\n").alias("body"))
    return with_heads(made, heads)


def with_heads(bodies: DataFrame, heads: DataFrame) -> DataFrame:
    """``page_id, html``: a document of each page's head and, if it has any, body (page_id, body)."""
    quoted = text.escape_attribute
    page = F.concat(
        F.lit('<!doctype html><html lang="'), F.col("lang"), F.lit('"><head><title>'), text.escape_title("title"), F.lit('</title><link rel="canonical" href="'), quoted("canonical"),
        F.lit('"><meta property="og:title" content="'), quoted("og_title"), F.lit('"><meta property="og:description" content="'), quoted("og_description"),
        F.lit('"></head><body><main data-provider="chatgpt">'), F.coalesce("body", F.lit("")), F.lit("</main></body></html>"),
    )
    return heads.join(bodies, "page_id", "left").select("page_id", page.alias("html"))


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def snapshot_of(html: str | None, url: str | None = "") -> str:
    """A page of nothing but the shared messages, cleaned, with title, date and link; '' where the page
    holds no messages."""
    tree = parse(html)
    root = tree.first(".share-layout-messages")
    if root is None:
        return ""
    text_at = lambda s: "" if (n := tree.first(s)) is None else n.raw_text().strip()
    link = tree.first("link[rel=canonical]")
    title, date = text_at(".share-layout-title") or text_at("title"), text_at(".share-layout-date")
    canonical = (link.get("href") if link is not None else "") or url or ""
    head = f'<title>{_quoted(title)}</title><link rel="canonical" href="{_quoted(canonical)}">'
    top = f'<div class="share-layout-title">{_quoted(title)}</div><div class="share-layout-date">{_quoted(date)}</div>'
    return f'<!doctype html><html lang="{_quoted(tree.get("lang") or "en")}"><head>{head}</head><body>{top}{clean_clone(root, rules.SNAPSHOT_NOISE_NODES)}</body></html>'


@F.pandas_udf(StringType())
def snapshot(html: pd.Series, url: pd.Series) -> pd.Series:
    """Column form of ``snapshot_of``."""
    return pd.Series([snapshot_of(h, u) for h, u in zip(html, url)], dtype=object)
