"""Connected components of a table of links, by alternating stars, all in DataFrames.

Each round links every node's larger neighbours to its smallest one, then every node's smaller
neighbours. Rows halve distances per round, so a few rounds do; each is written to the shared
folder. Neither links nor components ever meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from turnloom.llm.common import cut


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """links, written, with their number and a sum over them, which are taken while they are written."""
    seen = Observation()
    links = cut(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("key")))
    return links, (seen.get["n"], seen.get["key"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of links (a, b: long); a component is its smallest node."""
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, now = _written(links)
    before = None
    # done when a round changes nothing: every node has one link, to a node that has no smaller neighbour itself
    while now[0] and now != before:
        before = now
        # large star: all larger neighbours of a node, and the node, go to the smallest neighbour
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # both sides are dealt out by the key already: a broadcast would only pass them through the driver
        low = both.groupBy("a").agg(F.min("b").alias("m")).hint("merge")
        large = both.filter("b > a").join(low, "a").select(F.least("m", "a").alias("a"), "b").distinct()
        # small star: all smaller neighbours of a node, and the node, go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m")).hint("merge")
        small = large.join(low, "b").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("b"), F.col("m").alias("a"))
        links, now = _written(small.filter("a <> b").select("a", "b").distinct())
    roots = links.select("a").distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots.select("a", F.col("a").alias("component")))


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after further links (a, b), which may name nodes that parts has not. Only the
    components that links join are worked on."""
    to = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    joined = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    above = cut(components(joined))
    known = parts.join(above.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return known.union(above.join(parts.select("node"), "node", "left_anti").select("node", "component"))
