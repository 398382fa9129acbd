"""Substring dedup in bytes by prefix doubling over sampled positions.

Positions are ranked by ever longer strings that start there. A rank is the fingerprint of the pair of
ranks at a position and at an offset from it; Spark sorts the positions by them, equal ones of an earlier
document decide, and positions whose rank no other document has drop out before the offset grows:

1. 16 bytes (offset 8), at the sampled positions only. Equal strings of 50 bytes are sampled at the same
   place, so where no other document has the 16 bytes, and 17 more on one side, nothing repeats.
2. 84 bytes: the pair of the 50 bytes that begin 34 before the position and of the 50 at it (offset 34).
   These are all bytes of all strings sampled there. Where an earlier document has the pair, all of it
   repeats, past the threshold; where all documents with the 16 bytes have the same pair, none is left to
   compare.
3. 50 bytes (offset 18 between two of 32) at every single position that is left: at the edges of repeated
   passages.

Full doubling (``doubled``) ranks every byte and sorts them all again at each offset. It gives the same
rows, and is what the sampled form is tested against; it shuffles some two hundred times its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import cut, slices
from turnloom.llm.sampling import GRAM, LENGTH, SIDE, Units, apart, candidates, covered, hot_grams, later, numbered, pair, wanted

REACH = LENGTH - GRAM
SCHEMA = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: State of a pair: another row shares the left side, or the right; the gram is a hot one; an earlier
#: document of the same task has the pair. Above these bits is how far the pair reaches from its place.
LEFT, RIGHT, HOT, KNOWN, REACH_BIT = 1, 2, 4, 8, 4


def _short(names: np.ndarray) -> pa.Array:
    """Names in 32 bits: what is compared has 64 bits of one kind and these of the other."""
    return pa.array(names.astype(np.uint32).view(np.int32))


def _long_pairs(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            u = Units.of_bytes(texts)
            places, text, grams, state = wanted(part, u)
            begin = np.maximum(places - REACH, u.first[text])
            end = np.minimum(places + LENGTH, (u.first + u.counts)[text])
            # texts end in gaps of zeros: how far the strings go is part of their rank
            size = ((places - begin) << 8 | end - places).astype(np.uint64)
            one, two = (pair(pair(u.at(places - REACH, LENGTH, k), u.at(places, LENGTH, k), k), size, k) for k in (0, 1))
            row, order = (part.column(c).to_numpy()[text] for c in ("row", "ord"))
            known = later([one, two, grams], order)
            common = np.isin(grams, hot)
            # rows that are decided go anywhere; those of hot grams by their pair, not by the gram
            deal = np.where(known, apart(row, places), np.where(common, one, grams))
            yield pa.RecordBatch.from_pydict({
                "deal": pa.array(deal.view(np.int64)), "one": pa.array(one.view(np.int64)), "two": _short(two), "ord": pa.array(order), "row": pa.array(row),
                "place": pa.array(places - u.first[text]), "state": pa.array((state | HOT * common | KNOWN * known | (end - places) << REACH_BIT).astype(np.int32)),
            })

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        u = Units.of_bytes(texts)
        lists = part.column("edges")
        counts = lists.value_lengths().fill_null(0).to_numpy()
        listed = lists.flatten()
        places = listed.field("place").to_numpy() + np.repeat(u.first, counts)
        starts, least = u.minimizers()
        if not len(places) or not len(starts):
            continue
        sort = np.argsort(places)
        at = sort[np.minimum(np.searchsorted(places, least, sorter=sort), len(places) - 1)]
        state = listed.field("state").to_numpy()[at]
        # a string that holds a whole side of its sampled position repeats only where that side does
        before, after = least - starts, REACH - (least - starts)
        starts = starts[(places[at] == least) & ((before < SIDE) | (state & LEFT > 0)) & ((after < SIDE) | (state & RIGHT > 0))]
        text = u.text_of(starts)
        one, two = u.at(starts, LENGTH), u.at(starts, LENGTH, 1)
        row, order = (part.column(c).to_numpy()[text] for c in ("row", "ord"))
        known = later([one, two], order)
        one, two = np.where(known, apart(row, starts), one), np.where(known, 0, two)
        starts = starts - u.first[text]
        # one that is decided has its start below zero
        yield pa.RecordBatch.from_pydict({"one": pa.array(one.view(np.int64)), "two": _short(two), "ord": pa.array(order), "row": pa.array(row), "start": pa.array(np.where(known, -1 - starts, starts))})


def repeated(rows: DataFrame) -> DataFrame:
    """``row, spans``: of rows (row, doc_id, ord, text) the stretches that an earlier document has too."""
    lists = candidates(rows, Units.of_bytes)
    hot = hot_grams(lists)
    pairs = rows.select("row", "ord", "text").join(lists, "row").mapInArrow(_long_pairs(hot), "deal long, one long, two int, ord long, row long, place long, state int")
    pairs = pairs.repartition("deal")
    group, same = Window.partitionBy("deal"), Window.partitionBy("deal", "one", "two")
    pairs = pairs.withColumn("several", (F.min("one").over(group) != F.max("one").over(group)) | (F.col("state").bitwiseAND(HOT) > 0))
    pairs = pairs.withColumn("again", (F.col("ord") > F.min("ord").over(same)) | (F.col("state").bitwiseAND(KNOWN) > 0))
    ranked = cut(pairs.filter("again or several").select("row", "place", "state", "again"))

    edges = ranked.filter("not again").groupBy("row").agg(F.collect_list(F.struct("place", "state")).alias("edges"))
    single = rows.select("row", "ord", "text").join(edges, "row").mapInArrow(_single, "one long, two int, ord long, row long, start long")
    single = single.withColumn("low", F.min("ord").over(Window.partitionBy("one", "two"))).filter("start < 0 or ord > low")
    start = F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start"))
    single = cut(single.select("row", start.alias("begin"), (start + LENGTH).alias("end")))
    whole = ranked.filter("again").select("row", F.greatest(F.col("place") - REACH, F.lit(0)).alias("begin"), (F.col("place") + F.shiftright("state", REACH_BIT)).alias("end"))
    spans = whole.unionByName(single)
    return spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _all_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        zero = pa.array([0] * len(texts), pa.int64())
        yield pa.RecordBatch.from_pydict({
            "row": part.column("row"), "doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(texts.offsets).astype(np.int64)),
            "n_removed": zero, "n_spans": zero, "kept_sha256": [hashlib.sha256(texts.text(i)).hexdigest() for i in range(len(texts))],
        })


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        gone = covered(part.column("spans"), texts.offsets, len(texts.data))
        counts, spans, digests = [], [], []
        for a, b in zip(texts.offsets, texts.offsets[1:]):
            drop = gone[a:b]
            counts.append(int(drop.sum()))
            spans.append(int(np.count_nonzero(drop[1:] & ~drop[:-1])) + int(len(drop) > 0 and drop[0]))
            digests.append(hashlib.sha256(texts.data[a:b][~drop].tobytes()).hexdigest())
        yield pa.RecordBatch.from_pydict({
            "row": part.column("row"), "doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(texts.offsets).astype(np.int64)),
            "n_removed": pa.array(counts, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": digests,
        })


def _result(rows: DataFrame, spans: DataFrame) -> DataFrame:
    touched = cut(rows.select("row", "doc_id", "text").join(spans, "row").mapInArrow(_kept, SCHEMA))
    others = rows.select("row", "doc_id", "text").mapInArrow(_all_kept, SCHEMA)
    return touched.unionByName(others.join(touched.select("row"), "row", "left_anti")).drop("row")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (of the bytes left).

    A byte is removed if it is covered by a string of 50 bytes that also starts in a document with a
    smaller id; strings are judged on the input and never cross documents. n_spans counts maximal
    removed runs. Null counts as the empty text. Null ids count as larger than any, rows with equal
    ids do not remove each other's bytes. Texts may be of any length. Other columns are ignored,
    whatever their names. An empty table gives an empty result. df is read several times,
    and is written once first if it is no Parquet table.
    """
    rows = numbered(df, id_col, text_col)
    return _result(rows, repeated(rows))


def doubled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same by prefix doubling over every byte: ranks of 1, 2, 4 .. 32 and 50 bytes, each the first
    place of a sorted pair of ranks. Positions whose string stands in one row only drop out each time."""
    rows = numbered(df, id_col, text_col)
    data = F.col("text").cast("binary")
    every = rows.filter(F.octet_length(data) >= LENGTH).select("row", "ord", F.hex(data).alias("digits"))
    every = every.select("row", "ord", F.explode(F.sequence(F.lit(0), F.shiftright(F.length("digits"), 1) - 1)).alias("pos"), "digits")
    ranked = cut(every.select("row", "ord", F.col("pos").cast("long").alias("pos"), F.conv(F.substring("digits", F.col("pos").cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("long").alias("rank"), F.lit(-1).cast("long").alias("rank2")))
    size = 1
    while size < LENGTH:
        offset = min(size, LENGTH - size)
        at = Window.partitionBy("row").orderBy("pos").rangeBetween(offset, offset)
        both = ranked.select("row", "ord", "pos", "rank", "rank2", F.max("rank").over(at).alias("next"), F.max("rank2").over(at).alias("next2")).filter("next is not null")
        same = Window.partitionBy("rank", "rank2", "next", "next2")
        first = F.min(F.struct("row", "pos")).over(same)
        both = both.withColumns({"first": first, "last": F.max("row").over(same), "low": F.min("ord").over(same)}).filter("first.row < last")
        ranked = cut(both.select("row", "ord", "pos", F.col("first.row").alias("rank"), F.col("first.pos").alias("rank2"), "low"))
        size += offset
    spans = ranked.filter("ord > low").groupBy("row").agg(F.collect_list(F.struct(F.col("pos").alias("begin"), (F.col("pos") + LENGTH).alias("end"))).alias("spans"))
    return _result(rows, spans)


SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(h) // 2 - 48)) AS p, h FROM docs WHERE len(h) >= 100),
keyed AS (SELECT doc_id, p, md5(substr(h, (2 * p - 1)::BIGINT, 100)) AS k FROM runs),
low AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
again AS (SELECT doc_id, p FROM keyed JOIN low USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM again),
lists AS (SELECT g.doc_id, count(*) AS n, count(*) FILTER (b.i IS NULL) AS spans FROM gone g LEFT JOIN gone b ON b.doc_id = g.doc_id AND b.i = g.i - 1 GROUP BY g.doc_id),
each AS (SELECT doc_id, i, substr(h, (2 * i - 1)::BIGINT, 2) AS x FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM docs)),
kept AS (SELECT e.doc_id, string_agg(x, '' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(l.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.t, ''))) AS kept_sha256
FROM docs d LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
