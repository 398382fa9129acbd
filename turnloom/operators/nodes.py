"""Page trees as rows: interval-encoded nodes, selectors as columns, and containment in the JVM.

The tree step writes one row per element: its number in document order, its parent's, the last number below
it, tag and attributes. Everything about nodes that needs no markup is then DataFrame code: a selector
without combinators is a condition on a row, "inside of" is a running maximum in document order (intervals
nest, so a node is inside a match just if an earlier match reaches it), "the first match below" is the next
match in document order if it is not past the node's end, and what stands above a node is read by place.
Windows and arrays are per page, so a task holds the nodes of one page at a time, never its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import rules, text
from turnloom.functions.batches import sliced
from turnloom.functions.dom import Node, parse, parse_selector

NODES = "page_id long, nid int, parent int, last int, tag string, attrs map<string,string>"
#: How far up a hint counts.
HINT_DEPTH = 4


def numbered(root: Node) -> tuple[list[Node], dict[int, int], list[int]]:
    """A tree's elements in document order, root first, each one's number by identity, and the last
    number below each."""
    nodes = [root, *root.walk()]
    place = {id(n): i for i, n in enumerate(nodes)}
    last = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        above = place[id(nodes[i].parent)]
        last[above] = max(last[above], last[i])
    return nodes, place, last


def node_table(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) to one row per element. Pages without markup have html, head and body."""
    kind = pa.schema([("page_id", pa.int64()), ("nid", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                nodes, place, last = numbered(parse(html))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([page_id] * len(nodes), pa.int64()), pa.array(range(len(nodes)), pa.int32()), pa.array([None, *(place[id(n.parent)] for n in nodes[1:])], pa.int32()),
                        pa.array(last, pa.int32()), pa.array([n.tag for n in nodes]), pa.array([list(n.attrs.items()) for n in nodes], kind.field("attrs").type),
                    ],
                    schema=kind,
                )

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODES)


def _attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _test(tag: str, cls: str, ident: str, name: str, op: str, value: str) -> Column:
    if tag:
        return F.col("tag") == tag
    if cls:
        return F.array_contains(F.split(_attribute("class"), r"\s+"), cls)
    if ident:
        return _attribute("id") == ident
    if not name:
        return F.lit(True)
    have = _attribute(name)
    if not op:
        return have.isNotNull()
    return {"=": have == value, "^=": have.startswith(value), "*=": have.contains(value), "$=": have.endswith(value), "~=": F.array_contains(F.split(have, r"\s+"), value)}[op]


def matching(selector: str) -> Column:
    """Whether a node's own tag and attributes match one of a list of selectors without combinators."""
    found = F.lit(False)
    for chain in parse_selector(selector):
        if len(chain) > 1:
            raise ValueError(f"selector with a combinator: {selector}")
        one = F.lit(True)
        for test in chain[0][1]:
            one = one & F.coalesce(_test(*test), F.lit(False))
        found = found | one
    return found


def inside(nodes: DataFrame, name: str, condition: Column) -> DataFrame:
    """nodes with ``name``: whether the node, or one above it, meets the condition."""
    upto = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn(name, F.coalesce(F.max(F.when(condition, F.col("last"))).over(upto) >= F.col("nid"), F.lit(False)))


def first_below(nodes: DataFrame, name: str, condition: Column) -> DataFrame:
    """nodes with ``name``: the number of the first node below that meets the condition, or null."""
    after = Window.partitionBy("page_id").orderBy(F.desc("nid")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.min(F.when(condition, F.col("nid"))).over(after)
    return nodes.withColumn(name, F.when(following <= F.col("last"), following))


def without_noise(nodes: DataFrame, selector: str = rules.NOISE_NODES) -> DataFrame:
    """The nodes that are not inside of interface noise."""
    return inside(nodes, "_noise", matching(selector)).filter("not _noise").drop("_noise")


def role_by_ancestor(nodes: DataFrame, hints: tuple[str, ...], depth: int = HINT_DEPTH) -> DataFrame:
    """``page_id, nid, role``: the role that a node's hint attributes tell, read as one string, or those
    of the nearest of up to ``depth`` nodes above it; '' without any."""
    given = F.array_join(F.filter(F.array(*(_attribute(h) for h in hints)), lambda v: F.length(v) > 0), " ")
    own = nodes.select("page_id", F.struct("nid", "parent", text.normalize_role(given).alias("role")).alias("node"))
    page = own.groupBy("page_id").agg(F.array_sort(F.collect_list("node")).alias("n"))
    # numbers are places in the list: what stands above is read, not joined
    role, above = F.col("node.role"), F.col("node.parent")
    found = page.select("page_id", "n", F.explode("n").alias("node"))
    for k in range(depth):
        found = found.withColumn(f"_{k}", F.get("n", above))
        role, above = F.when(role != "", role).otherwise(F.coalesce(F.col(f"_{k}.role"), F.lit(""))), F.col(f"_{k}.parent")
    return found.select("page_id", "node.nid", role.alias("role"))
