"""Messages in JSON that pages carry in scripts, as rows. A script's JSON is found by expressions, read once
and walked outside in by a small helper, so the work is in proportion to its length, however deep it is
nested. Nothing is shuffled before the messages of a page meet to drop repeats.

Results follow the order in which scripts list keys: integer keys first, ascending, then as written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import rules, text
from turnloom.functions.batches import sliced
from turnloom.functions.dom import SPACES, parse
from turnloom.operators import providers
from turnloom.operators.messages import first_wins

_SCRIPTS = "page_id long, script int, type string, value string"


def page_scripts(pages: DataFrame) -> DataFrame:
    """``page_id, script, type, value``: the scripts with text of pages (page_id, html), in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(i, k, s.get("type"), s.raw_text()) for i, html in enumerate(batch.column("html").to_pylist()) for k, s in enumerate(parse(html).all("script"))]
            at, number, kinds, values = zip(*found) if found else ((), (), (), ())
            columns = [batch.column("page_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "script", "type", "value"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, _SCRIPTS)


def json_texts(scripts: DataFrame) -> DataFrame:
    """``page_id, script, at`` of scripts (page_id, script, type, value): what may be a script's JSON text,
    all of it or what stands between its first and last brace; null if it is longer than counts."""
    rows = scripts.select("page_id", "script", "type", F.btrim("value", F.lit(SPACES)).alias("whole"))
    all_of_it = (F.coalesce("type", F.lit("")) == "application/json") | F.col("whole").rlike(r"^[{\[]")
    counts = F.length("whole") <= rules.MAX_SCRIPT
    return rows.select("page_id", "script", F.when(counts, F.when(all_of_it, F.col("whole")).otherwise(F.regexp_extract("whole", r"(?s)(\{.*\})", 1))).alias("at"))


_WALKED = "page_id long, script int, path array<int>, role string, text string"


def _said(value: str) -> str:
    """value without halves of surrogate pairs, which escapes in JSON may make and UTF-8 has not."""
    return value.encode("utf-8", "replace").decode()


def _found(at: str | None, depth: int) -> list[tuple[tuple[int, ...], str, str]]:
    """Path, role and text of a JSON text's objects that have both; none if it is no JSON."""
    try:
        walked = providers.walk_paths(None if at is None else providers._loads(at), depth)
        return [(path, _said(role), _said(providers.structured_text(content).replace("\0", ""))) for path, role, content in walked]
    except RecursionError:
        return []


def _settled(rows: DataFrame, whole: int) -> DataFrame:
    """rows, whose columns after the first ones are worked out before what follows: filters on them are not
    pushed down, where each use of a column would work it out anew."""
    first, made = rows.columns[:whole], rows.columns[whole:]
    return rows.select(*first, F.explode(F.array(F.struct(*made))).alias("_row")).select(*first, *(f"_row.{c}" for c in made))


def walk(scripts: DataFrame, depth: int = rules.MAX_DEPTH) -> DataFrame:
    """``page_id, script, path, role, text`` of every object with a role and a content in scripts
    (page_id, script, type, value), to a depth of values. ``path`` sorts objects outside in, in the order
    that scripts list them. Roles and texts are as written, white space at a text's ends and NULs apart.

    Scripts that are null, empty, too long, or no JSON have no rows, nor have those with values nested
    about a thousand deep; objects nested deeper than depth have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(i, *f) for i, at in enumerate(batch.column("at")) for f in _found(at.as_py(), depth)]
            at, paths, roles, texts = zip(*found) if found else ((), (), (), ())
            at = pa.array(at, pa.int64())
            columns = [batch.column("page_id").take(at), batch.column("script").take(at), pa.array(map(list, paths), pa.list_(pa.int32())), pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "script", "path", "role", "text"])

    rows = json_texts(scripts).select(F.col("page_id").cast("long"), F.col("script").cast("int"), "at").mapInArrow(run, _WALKED)
    return rows.withColumn("text", F.btrim("text", F.lit(SPACES)))


def json_messages(scripts: DataFrame) -> DataFrame:
    """``page_id, script, path, role, text``: the walk's objects that are messages. Unknown roles, texts
    that are empty, noise, or longer than counts go; of one role's equal texts in a page the first stays."""
    found = _settled(walk(scripts).withColumn("role", text.normalize_role("role")), 3)
    found = found.filter((F.col("role") != "") & (F.col("text") != "") & (F.length("text") <= rules.MAX_TEXT) & ~text.noise_prefix("text", qwen=True))
    keyed = found.withColumn("_key", F.md5(text.dedupe_key("text")))
    return first_wins(keyed, ["page_id", "role", "_key"], ["script", "path"]).drop("_key")
