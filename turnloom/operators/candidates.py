"""One provider's parser in relational form: candidates from the tree step, all decisions as columns.

The tree step finds what could be a message, for every stage of the parser, with its place and extent in
the tree, its texts and its safe markup. Which candidates count, which stage is asked, which of several
near copies stays and in what order messages stand is decided in the JVM, by expressions over a page's
candidates: gates ask whether an earlier stage has a role, an ordered fold drops what is like a survivor,
and survivors are put in order of the page. Candidates stay in their page's row, so nothing is shuffled;
``candidate_rows`` gives them as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.functions.batches import sliced
from turnloom.functions.dom import Node, body, parse
from turnloom.functions.sanitize import message, remove_noise
from turnloom.operators import providers
from turnloom.operators.nodes import numbered

_FIELDS = [("stage", "int"), ("pos", "int"), ("role", "string"), ("walled", "boolean"), ("nid", "int"), ("first", "int"), ("last", "int"), ("whole", "string"), ("inner", "string"), ("key", "string"), ("html", "string"), ("text", "string"), ("thought", "string")]
CANDIDATE = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">"
PAGE = f"page_id long, provider string, url string, titles array<string>, dates array<string>, candidates array<{CANDIDATE}>"
_ARROW = pa.list_(pa.struct([(n, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in _FIELDS]))


def _stages(root: Node) -> Iterator[tuple[int, Node, list[tuple[str, Node]]]]:
    """Each stage's number, tree, and nodes with the role that they would have."""
    yield 1, root, [(providers._claude_role(n), n) for n in root.all("[class*=font-user-message], [class*=font-claude-message]")]
    yield 2, root, [("assistant", n) for n in root.all(".prose, [data-test-render=true], [class*=markdown]") if n.closest("[class*=font-user-message]") is None]
    named = [((n.get("data-message-author-role") or n.get("data-turn")).lower(), n) for n in root.all("[data-message-author-role], [data-turn]")]
    yield 3, root, [("user" if "user" in v else "assistant" if re.search("assistant|claude", v) else "", n) for v, n in named]
    bare = remove_noise(root.copy())
    yield 4, bare, [("assistant", n) for n in bare.all(".prose, [data-test-render=true]")] + [("user", n) for n in bare.all("[class*=font-user-message]")]


def page_candidates(document: Node) -> list[dict]:
    """All stages' candidates of a page that have a role."""
    found: list[dict] = []
    for stage, root, nodes in _stages(document.first("main") or body(document)):
        _, place, last = numbered(root)
        for role, node in nodes:
            if not role:
                continue
            own, below = providers._CLAUDE_CONTENT[role]
            content = node if node.matches(own) else next((m for s in below if (m := node.first(s)) is not None), node)
            made, inner = message(role, content), content.text()
            first = place[id(content)]
            found.append({
                "stage": stage, "pos": len(found), "role": role, "walled": node.closest(providers._WALLS) is not None, "nid": place[id(node)], "first": first, "last": last[first],
                "whole": node.text(), "inner": inner, "key": providers.key_of(made["text"] or inner), "html": made["html"], "text": made["text"], "thought": made["thought"],
            })
    return found


def with_candidates(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) to ``page_id, provider, url, titles, dates, candidates``."""
    known = providers.RULES["claude"]
    texts = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for html, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist()):
                document = parse(html)
                links = [providers._value(document, s, "href") for s in known.links]
                rows.append((next(filter(None, [url or "", *links]), ""), [providers._value(document, s, a) for s, a, _ in known.titles], [providers._value(document, s, "") for s in known.dates], page_candidates(document)))
            url, titles, dates, found = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), texts, texts, _ARROW)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(["claude"] * len(rows)), url, titles, dates, found], names=["page_id", "provider", "url", "titles", "dates", "candidates"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, PAGE)


def candidate_rows(pages: DataFrame) -> DataFrame:
    """One row per candidate: ``page_id, stage, pos, role, walled, nid, first, last, ...``."""
    return with_candidates(pages).select("page_id", F.inline("candidates"))


def _has(candidates: Column, stages: tuple[int, ...], role: str | None = None) -> Column:
    return F.exists(candidates, lambda c: c["stage"].isin(*stages) & (F.lit(True) if role is None else c["role"] == role))


def gated(candidates: Column) -> Column:
    """Of candidates that are clean those whose stage is asked: plain assistant markup only where the first
    stage has no assistant, role attributes for the roles that it lacks, bare markup where nothing was found."""
    clean = lambda c: ~c["walled"] & ~text.noise_part(c["whole"], "claude") & ~text.noise_part(c["inner"], "claude") & (c["key"] != "")
    has = lambda good: F.struct(_has(good, (1,), "user").alias("user"), _has(good, (1,), "assistant").alias("assistant"))
    asked = lambda c, has: (c["stage"] == 1) | ((c["stage"] == 2) & ~has["assistant"]) | ((c["stage"] == 3) & F.when(c["role"] == "user", ~has["user"]).otherwise(~has["assistant"]))
    bare = lambda good: F.filter(good, lambda c: c["stage"] == 4)
    first = lambda good: text.let(has(good), lambda has: F.filter(good, lambda c: asked(c, has)))
    return text.let(F.filter(candidates, clean), lambda good: text.let(first(good), lambda found: F.when(F.size(found) > 0, found).otherwise(bare(good))))


def near_keys(one: Column, two: Column, least: int = 40) -> Column:
    """Equal keys, or two of over ``least`` characters of which one holds the other."""
    return (one == two) | ((F.length(one) > least) & (F.length(two) > least) & (F.contains(one, two) | F.contains(two, one)))


def _holds(outer: Column, inner: Column) -> Column:
    return (outer["first"] <= inner["first"]) & (inner["last"] <= outer["last"])


def folded(candidates: Column) -> Column:
    """Survivors of candidates in order. One that is like a survivor is dropped, unless it is the cleaner
    content inside of it: then it takes the survivor's place and keeps its position."""

    def like(kept: Column, new: Column) -> Column:
        nested = (kept["first"] != new["first"]) & (_holds(kept, new) | _holds(new, kept))
        return (kept["role"] == new["role"]) & (near_keys(kept["key"], new["key"]) | nested)

    def step(kept: Column, new: Column) -> Column:
        cleaner = lambda k: (F.length(new["text"]) > 0) & (F.length(new["text"]) <= F.length(k["text"])) & _holds(k, new)
        instead = lambda at: F.transform(kept, lambda k, i: F.when((i + 1 == at) & cleaner(k), new.withField("nid", k["nid"])).otherwise(k))
        at = F.array_position(F.transform(kept, lambda k: like(k, new)), True)
        return text.let(at, lambda at: F.when(at == 0, F.concat(kept, F.array(new))).otherwise(instead(at)))

    return F.aggregate(candidates, F.filter(candidates, lambda c: F.lit(False)), step)


def in_order(survivors: Column) -> Column:
    """Survivors in order of the page; of equal texts of a role the first that survived."""
    first = F.filter(survivors, lambda c, i: ~F.exists(F.slice(survivors, 1, i), lambda o: (o["role"] == c["role"]) & (o["key"] == c["key"])))
    placed = F.transform(first, lambda c, i: F.struct(c["nid"].alias("nid"), i.alias("i"), F.struct(*(c[n].alias(n) for n in ("role", "html", "text", "thought"))).alias("message")))
    return F.transform(F.array_sort(placed), lambda c: c["message"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """Claude pages to ``page_id, provider, url, titles, dates, messages``, the rows of ``providers.parse_pages``."""
    found = text.let(text.let(gated(F.col("candidates")), folded), in_order)
    return with_candidates(pages).select("page_id", "provider", "url", "titles", "dates", found.alias("messages"))


def near_duplicate_survivors(pairs: DataFrame, rows: DataFrame, scope: list[str], ident: str, key: str) -> DataFrame:
    """Of rows with unique ids within a scope those that survive an ordered fold, in order of id: a row goes
    if an earlier survivor has the same key, or one of them holds the other (``pairs`` of ids, of which
    b's key holds a's). Dropped rows drop nothing themselves, so the fold is not transitive.

    Equal keys are settled first, by a window. Rows that are in no pair survive as they are. Only the rest
    is folded, per scope, so what meets in one place are the different texts of a scope that are near to others.
    """
    first = rows.groupBy(*scope, key).agg(F.min(ident).alias(ident))
    near = pairs.select(*scope, F.explode(F.array("a", "b")).alias(ident)).distinct()
    near = first.join(near, [*scope, ident])
    alone = first.join(near.select(*scope, ident), [*scope, ident], "left_anti").select(*scope, ident)
    fold = F.aggregate("_rows", F.filter("_rows", lambda r: F.lit(False)), lambda kept, new: F.when(F.exists(kept, lambda k: near_keys(k["key"], new["key"])), kept).otherwise(F.concat(kept, F.array(new))))
    folded_ = near.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("id"), F.col(key).alias("key")))).alias("_rows")).select(*scope, F.explode(F.transform(fold, lambda r: r["id"])).alias(ident))
    return alone.unionByName(folded_)
